"""Breadth-first search, shortest paths, components and PageRank as vertex programs."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.blocks import NO_PATH, Blocks, Rule
from lattica.components import connected_components
from lattica.engine import Engine, VertexProgram
from lattica.graph import Graph
from lattica.session import released, settled, shared_dir

#: What is written for vertices that are not reached.
UNREACHED_DEPTH = -1
UNREACHED_DISTANCE = 2147383647
PAGE_CONST = 0.15
TOLERANCE = 0.01


def _finish(engine: Engine, result: DataFrame) -> DataFrame:
    out = settled(result, "result")
    engine.close()
    return out


def _sources(graph: Graph, source: int | Iterable[int | None] | DataFrame | None) -> DataFrame:
    """(id) of the start vertices; None, alone or among others, is the vertex of most out-edges."""
    if isinstance(source, DataFrame):
        return source.select(F.col("id").cast("long"))
    ids = [source] if source is None or isinstance(source, int) else list(source)
    ids = [graph.max_out_degree_vertex() if i is None else i for i in ids]
    return graph.spark.range(1).select(F.explode(F.array(*(F.lit(i).cast("long") for i in ids))).alias("id")) if ids else graph.spark.range(0)


def bfs(graph: Graph, source: int | Iterable[int] | DataFrame | None = None, max_iter: int = 10_000) -> DataFrame:
    """(id, depth): edges from the nearest source, -1 where there is no path. ``source`` may be one id, several, a DataFrame (id),
    or None for the vertex of most out-edges."""
    frontier = settled(_sources(graph, source).distinct().join(graph.vertices.select("id"), "id", "left_semi"), "sources")
    sources, held = [frontier], []
    edges = graph.edges.select("src", "dst").distinct().repartition("src").persist()
    depth, parts = 0, [frontier.withColumn("depth", F.lit(0))]
    seen = parts[0]
    while not frontier.isEmpty():
        depth += 1
        if depth > max_iter:
            raise RuntimeError(f"still active after {max_iter} iterations")
        near = edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = settled(near.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        parts.append(frontier)
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = settled(seen, "seen")
            held.append(seen)
    out = graph.vertices.select("id").join(seen, "id", "left").select("id", F.coalesce("depth", F.lit(UNREACHED_DEPTH)).cast("int").alias("depth"))
    out = settled(out, "result")
    edges.unpersist()
    released(*parts, *held, *sources)
    return out


def bfs_program() -> VertexProgram:
    """BFS for the engine: no gather; an active vertex without depth takes the iteration's number."""
    return VertexProgram(apply=lambda v, acc, i: ({"depth": F.when(v.depth == UNREACHED_DEPTH, F.lit(i)).otherwise(v.depth)}, v.depth == UNREACHED_DEPTH))


class _Distances(Rule):
    """Distance, and whether it became less in the last step: only then it is sent on."""

    zero, least = NO_PATH, True

    def start(self, ids, chosen):
        dist = np.where(np.isin(ids, chosen), 0, NO_PATH)
        return [dist, dist == 0], int((dist == 0).sum())

    def send(self, state, outdeg):
        return np.where(state[1], state[0], NO_PATH), None

    def apply(self, state, acc, hit, first):
        less = acc < state[0]
        return [np.where(less, acc, state[0]), less], int(less.sum())


def sssp(graph: Graph, source: int | Iterable[int] | DataFrame | None = None, directed: bool = True, default_weight: int | None = None, max_iter: int = 10_000) -> DataFrame:
    """(id, dist): the least sum of weights ``w`` from a source, 2147383647 where there is no path."""
    edges = graph.edges
    if "w" not in edges.columns:
        if default_weight is None:
            raise ValueError("no edge data available")
        edges = edges.withColumn("w", F.lit(default_weight))
    if edges.filter("w < 0 or w is null").limit(1).count():
        raise ValueError("weights must not be negative or missing")
    g = Graph(graph.vertices, edges)
    start = _sources(graph, source).distinct()
    return Blocks(g if directed else g.symmetrize(), "w").run(_Distances(), lambda state: np.where(state[0] < NO_PATH, state[0], UNREACHED_DISTANCE), "id long, dist long", max_iter=max_iter, start=start)


def min_labels(graph: Graph, max_iter: int = 10_000) -> DataFrame:
    """(id, label): the least id among a vertex and all that lead to it. On a symmetric graph these are its components."""
    program = VertexProgram(gather=lambda src, edge, dst: src.label, reduce="min", apply=lambda v, acc, i: ({"label": F.least(v.label, acc)}, acc < v.label), idempotent=True)
    state = graph.vertices.select("id", F.col("id").alias("label"))
    engine = Engine(Graph(graph.vertices, graph.edges.select("src", "dst").distinct()), program, state)
    engine.set_active(state.select("id"))
    return _finish(engine, engine.run(max_iter))


def components(graph: Graph, undirected: bool = False, max_iter: int = 10_000) -> DataFrame:
    """(id, label): ``min_labels``, or with ``undirected`` the components whatever the direction of edges, in log n rounds."""
    if not undirected:
        return min_labels(graph, max_iter)
    found = connected_components(graph.edges, folder=shared_dir(graph.spark))
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label"))


class _Ranks(Rule):
    """Rank, and whether it changed by ``tol`` or more (with ``strict``: more than it) when its vertex was last active."""

    def __init__(self, tol: float | None = None, strict: bool = False):
        self.tol, self.strict = tol, strict

    def start(self, ids, chosen):
        return [np.full(len(ids), PAGE_CONST), np.zeros(len(ids), bool)], len(ids)

    def send(self, state, outdeg):
        return state[0] / np.maximum(outdeg, 1), None if self.tol is None else state[1]

    def apply(self, state, acc, hit, first):
        new = PAGE_CONST + (1 - PAGE_CONST) * acc
        if self.tol is None:
            return [new, state[1]], len(new)
        on, moved = hit | first, np.abs(new - state[0])
        far = on & ((moved > self.tol) if self.strict else (moved >= self.tol))
        return [np.where(on, new, state[0]), far], int(far.sum())


class _Pushed(Rule):
    """Rank and residual."""

    def __init__(self, tol: float):
        self.tol = tol

    def start(self, ids, chosen):
        return [np.zeros(len(ids)), np.full(len(ids), PAGE_CONST)], len(ids) * (PAGE_CONST > self.tol)

    def send(self, state, outdeg):
        return np.where(state[1] > self.tol, (1 - PAGE_CONST) * state[1] / np.maximum(outdeg, 1), 0.0), None

    def apply(self, state, acc, hit, first):
        rank, residual = state
        on = residual > self.tol
        left = np.where(on, 0.0, residual) + acc
        return [np.where(on, rank + residual, rank), left], int((left > self.tol).sum())


def pagerank(graph: Graph, tol: float = TOLERANCE, strict: bool = False, max_iter: int = 10_000) -> DataFrame:
    """(id, rank): 0.15 + 0.85 * sum of rank / out-degree over in-edges, unnormalised. All vertices start active; a change of ``tol`` or
    more (with ``strict``: more than it) activates the out-neighbours, others keep their rank."""
    return Blocks(graph).run(_Ranks(tol, strict), lambda state: state[0], "id long, rank double", max_iter=max_iter)


def pagerank_fixed(graph: Graph, iterations: int) -> DataFrame:
    """(id, rank) after so many rounds in which every vertex is active."""
    return Blocks(graph).run(_Ranks(), lambda state: state[0], "id long, rank double", steps=iterations)


def pagerank_delta(graph: Graph, tol: float = 1e-4, max_iter: int = 10_000) -> DataFrame:
    """(id, rank) by pushing changes: vertices with a residual above ``tol`` add it to their rank and send 0.85 / out-degree of it on.
    Ranks differ from the fixed point by what residuals are left."""
    return Blocks(graph).run(_Pushed(tol), lambda state: state[0] + state[1], "id long, rank double", max_iter=max_iter)
