"""Rounds over all edges on blocks of vertices held as arrays: sums and minima over in-edges for PageRank and shortest paths.

Ids are cut into ranges of about ``BLOCK_EDGES`` in-edges. A block's row has its vertices, its in-edges (place of the source in what the
block receives, place of the destination in the block) and, for each block that it leads to, the places of the vertices that block needs.
Rows are dealt once, a block a partition, and kept. A step sends each block one array from each block that has something to say, so
a value crosses once for each block that needs it, not once an edge, and nothing is sorted, hashed or joined by vertex.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.session import is_settled, released, settled, ship

#: In-edges and vertices of a block, unless a range of 1/BUCKETS of the ids has more; blocks at most, which then grow.
BLOCK_EDGES = 1_000_000
MOST_BLOCKS = 1024
BUCKETS = 4096
NO_PATH = 1 << 62

#: A row for block ``b``: what block ``k`` sends, a start vertex (k = START, its id in ``n``) or its state (k = STATE, how many changed in ``n``).
ROWS = "b int, k int, n long, data binary"
STATE, START, OWN = -1, -2, -3


def _table(rows: list[tuple[int, int, int, object]]) -> pa.Table:
    b, k, n, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    packed = [pickle.dumps(x, protocol=5) for x in data]
    return pa.table({"b": pa.array(b, pa.int32()), "k": pa.array(k, pa.int32()), "n": pa.array(n, pa.int64()), "data": pa.array(packed, pa.binary())})


def _rows(t: pa.Table) -> list[tuple[int, int, bytes | None]]:
    """(k, n, data) in the order of k, which is that of ids."""
    return sorted(zip(t["k"].to_pylist(), t["n"].to_pylist(), t["data"].to_pylist(), strict=True), key=lambda r: r[:2])


class Cut:
    """Which block an id is in: blocks are numbered in the order of ids; ``labels`` go to a partition each when dealt by hash."""

    def __init__(self, low: int, width: int, block: np.ndarray, labels: list[int]):
        self.low, self.width, self.block, self.labels = low, width, block, labels
        self.number = {x: k for k, x in enumerate(labels)}

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.block[np.clip((ids - self.low) // self.width, 0, len(self.block) - 1)]

    def label(self, column: str) -> Column:
        table = ",".join(str(self.labels[k]) for k in self.block)
        place = f"least(greatest(floor(({column} - {self.low}L) / {self.width}L), 0), {len(self.block) - 1})"
        return F.expr(f"element_at(cast(split('{table}', ',') as array<int>), cast({place} as int) + 1)")


class Rule:
    """What vertices start with, send and become. States are arrays over a block's vertices."""

    zero: float | int = 0.0
    least = False

    def start(self, ids: np.ndarray, chosen: np.ndarray) -> tuple[list[np.ndarray], int]:
        raise NotImplementedError

    def send(self, state: list[np.ndarray], outdeg: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """A value for each vertex, and whether it activates its out-neighbours."""
        raise NotImplementedError

    def apply(self, state: list[np.ndarray], acc: np.ndarray, hit: np.ndarray, first: bool) -> tuple[list[np.ndarray], int]:
        """The new state and how many vertices changed."""
        raise NotImplementedError


def _received(rule: Rule, own: tuple, got: dict[int, tuple], n: int) -> tuple[np.ndarray, np.ndarray]:
    """What each vertex gathers, and whether a changed one leads to it."""
    _, _, ins, place, to, w, _ = own
    acc, hit = np.full(n, rule.zero), np.zeros(n, bool)
    if not got or not len(to):
        return acc, hit
    parts = [got.get(k, (None, None)) for k, _ in ins]
    values = np.concatenate([np.full(m, rule.zero) if v is None else v for (v, _), (_, m) in zip(parts, ins, strict=True)])[place]
    if rule.least:
        values = np.where(values < rule.zero, values + w, rule.zero)
        begin = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])  # in-edges are in the order of their destinations
        acc[to[begin]] = np.minimum.reduceat(values, begin)
    else:
        acc = np.bincount(to, weights=values, minlength=n)
    if any(f is not None for _, f in parts):
        hit[to[np.concatenate([np.zeros(m, bool) if f is None else f for (_, f), (_, m) in zip(parts, ins, strict=True)])[place]]] = True
    return acc, hit


def _step(cut: Cut, rule: Rule, first: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def step(topology: pa.Table, rows: pa.Table) -> pa.Table:
        label, own = topology["b"][0].as_py(), pickle.loads(topology["data"][0].as_py())
        ids, outdeg, outs, k = own[0], own[1], own[6], cut.number[topology["b"][0].as_py()]
        got = {s: (n, data) for s, n, data in _rows(rows) if s != START}
        if STATE not in got:
            chosen = np.array([n for s, n, _ in _rows(rows) if s == START], np.int64)
            state, changed = rule.start(ids, chosen)
        else:
            state = pickle.loads(got.pop(STATE)[1])
            acc, hit = _received(rule, own, {s: pickle.loads(data) for s, (_, data) in got.items()}, len(ids))
            state, changed = rule.apply(state, acc, hit, first)
        values, flags = rule.send(state, outdeg)
        out = [(label, STATE, changed, state)]
        # places of -1 are sources that aren't vertices: they have nothing to say
        values, flags = np.append(values, np.asarray(rule.zero, values.dtype)), None if flags is None else np.append(flags, False)
        for to, places in outs:
            v, f = values[places], None if flags is None else flags[places]
            if np.any(v != rule.zero) or (f is not None and f.any()):
                out.append((cut.labels[to], k, 0, (v, f)))
        return _table(out)

    return step


class Blocks:
    """The blocks of a graph, with edge weights if ``weight`` names a column; ``run`` steps over them."""

    def __init__(self, graph: Graph, weight: str | None = None):
        ship(graph.spark)
        self.spark = graph.spark
        self._edges = graph.edges if is_settled(graph.edges) else settled(graph.edges, "edges")
        w = [F.col(weight).cast("long").alias("w")] if weight else []
        edges = self._edges.filter("src is not null and dst is not null").select("src", "dst", *w)
        self.cut = cut = self._cut(graph.vertices, edges)
        self.n = len(cut.labels)
        dealt = edges.repartition(self.n, cut.label("dst")).mapInArrow(self._asks(), ROWS)
        asked = settled(dealt, "blocks")
        vertices = graph.vertices.select(cut.label("id").alias("b"), "id")
        made = asked.repartition(self.n, "b").groupBy("b").cogroup(vertices.repartition(self.n, "b").groupBy("b")).applyInArrow(self._made(), "b int, data binary")
        self._made_rows = settled(made, "blocks")
        released(asked)
        self.topology = self._made_rows.repartition(self.n, "b").sortWithinPartitions("b").persist()
        self.topology.count()  # how it lies is known to later plans once it is made

    def _cut(self, vertices: DataFrame, edges: DataFrame) -> Cut:
        low, high = vertices.agg(F.min("id"), F.max("id")).first()
        low, high = (0, 0) if low is None else (low, high)
        width = (high - low) // BUCKETS + 1
        bucket = lambda c: F.expr(f"cast(least(greatest(floor(({c} - {low}L) / {width}L), 0), {(high - low) // width}) as int)").alias("i")
        load = np.zeros((high - low) // width + 1, np.int64)
        for rows, c in ((edges, "dst"), (vertices, "id")):
            for i, n in rows.groupBy(bucket(c)).count().collect():  # BUCKETS rows at most
                load[i] += n
        total = int(load.sum())
        blocks = min(MOST_BLOCKS, total // BLOCK_EDGES + 1)
        block = np.unique((np.cumsum(load) - load) * blocks // max(total, 1), return_inverse=True)[1].astype(np.int32)
        n = int(block.max()) + 1
        home = self.spark.range(30 * n + 100).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("p")).agg(F.min("x").alias("x"))
        found = {p: x for p, x in home.collect()}
        spare = iter(range(30 * n + 100, 31 * n + 100))
        return Cut(low, width, block, [found[p] if p in found else next(spare) for p in range(n)])

    def _asks(self):
        """From the edges into a block: its in-edges, and for each block they come from the ids it needs with the edges from each."""
        cut = self.cut

        def asks(batches):
            kept = [b for b in batches if b.num_rows]
            if not kept:
                return
            t = pa.Table.from_batches(kept)
            columns = {c: t[c].to_numpy() for c in t.column_names}
            home = cut.of(columns["dst"])
            for k in np.unique(home):
                here = home == k
                src, dst, w = (columns[c][here] if c in columns else None for c in ("src", "dst", "w"))
                order = np.argsort(dst, kind="stable")
                src, dst, w = src[order], dst[order], None if w is None else w[order]
                need, place, edges = np.unique(src, return_inverse=True, return_counts=True)
                ends, to = np.unique(dst, return_inverse=True)
                source = cut.of(need)
                bounds = np.flatnonzero(np.r_[True, source[1:] != source[:-1], True])
                rows = [(int(source[i]), i, j) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                ins = [(s, int(j - i)) for s, i, j in rows]
                out = [(cut.labels[k], OWN, 0, (ends, ins, place.astype(np.int32), to.astype(np.int32), w))]
                out += [(cut.labels[s], int(k), 0, (need[i:j], edges[i:j])) for s, i, j in rows]
                yield from _table(out).to_batches()

        return asks

    def _made(self):
        def made(asked: pa.Table, vertices: pa.Table) -> pa.Table:
            ids = np.sort(vertices["id"].to_numpy())
            label = (asked if asked.num_rows else vertices)["b"][0].as_py()
            outdeg, outs = np.zeros(len(ids), np.int64), []
            ends, ins, place, to, w = np.zeros(0, np.int64), [], np.zeros(0, np.int32), np.zeros(0, np.int32), None

            def places(of: np.ndarray) -> np.ndarray:
                at = np.searchsorted(ids, of)
                return np.where((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == of), at, -1).astype(np.int32) if len(ids) else np.full(len(of), -1, np.int32)

            for k, _, data in _rows(asked):
                if k == OWN:
                    ends, ins, place, to, w = pickle.loads(data)
                else:
                    need, edges = pickle.loads(data)
                    at = places(need)
                    outdeg[at[at >= 0]] += edges[at >= 0]
                    outs.append((k, at))
            to = places(ends)[to] if len(to) else to
            there = to >= 0  # others lead to ids that aren't vertices
            own = (ids, outdeg, ins, place[there], to[there], None if w is None else w[there], outs)
            return pa.table({"b": pa.array([label], pa.int32()), "data": pa.array([pickle.dumps(own, protocol=5)], pa.binary())})

        return made

    def _stepped(self, rows: DataFrame, rule: Rule, first: bool) -> tuple[DataFrame, int]:
        """The rows after a step, and how many vertices changed."""
        both = self.topology.groupBy("b").cogroup(rows.repartition(self.n, "b").groupBy("b"))
        out = settled(both.applyInArrow(_step(self.cut, rule, first), ROWS), "step")
        released(rows)
        return out, out.filter(F.col("k") == STATE).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(self, rule: Rule, result: Callable[[list[np.ndarray]], np.ndarray], schema: str, steps: int | None = None, max_iter: int = 10_000, start: DataFrame | None = None) -> DataFrame:
        """``steps`` steps, or as many as it takes until no vertex changes; (id, ``result`` of its state) as ``schema`` says."""
        start = self.spark.range(0) if start is None else start
        rows, changed = self._stepped(start.select(self.cut.label("id").alias("b"), F.lit(START).alias("k"), F.col("id").alias("n"), F.lit(None).cast("binary").alias("data")), rule, True)
        done = 0
        while changed if steps is None else done < steps:
            if steps is None and done >= max_iter:
                raise RuntimeError(f"still active after {max_iter} iterations")
            rows, changed = self._stepped(rows, rule, done == 0)
            done += 1
        name = schema.split()[2]

        def unpacked(topology: pa.Table, state: pa.Table) -> pa.Table:
            own = pickle.loads(topology["data"][0].as_py())
            return pa.table({"id": own[0], name: result(pickle.loads(state["data"][0].as_py()))})

        both = self.topology.groupBy("b").cogroup(rows.filter(F.col("k") == STATE).repartition(self.n, "b").groupBy("b"))
        out = settled(both.applyInArrow(unpacked, schema), "result")
        self.topology.unpersist()
        released(rows, self._made_rows)
        return out
