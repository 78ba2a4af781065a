"""Graphs as DataFrames: vertices (id, ...) and directed edges (src, dst, ...), parallel edges kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.primitives import exclusive_scan


def edge_count_by(edges: DataFrame, end: str) -> DataFrame:
    """(id, n): edges at each ``end`` (src or dst) that has any."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Graph:
    """Vertices are the dense ids 0 .. n-1 where ``from_edges`` makes them; edges may carry columns such as ``w``."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame, n_vertices: int | None = None) -> Graph:
        """The graph of an edge list; without ``n_vertices`` there are max(src, dst) + 1 vertices."""
        if n_vertices is None:
            top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            n_vertices = 0 if top is None else top + 1
        return Graph(edges.sparkSession.range(n_vertices), edges)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def without_self_loops(self) -> Graph:
        return Graph(self.vertices, self.edges.filter("src <> dst"))

    def reverse(self) -> Graph:
        swapped = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
        return Graph(self.vertices, self.edges.select(*(swapped.get(c, F.col(c)) for c in self.edges.columns)))

    def symmetrize(self) -> Graph:
        """Each edge in both directions (a self loop twice)."""
        return Graph(self.vertices, self.edges.unionByName(self.reverse().edges))

    def out_degrees(self) -> DataFrame:
        """(id, degree) of every vertex."""
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def _degrees(self, end: str) -> DataFrame:
        return self.vertices.select("id").join(edge_count_by(self.edges, end), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))

    def max_out_degree_vertex(self) -> int:
        """The vertex of most out-edges, the least of several."""
        top = self.out_degrees().agg(F.max_by("id", F.struct("degree", F.negative("id")))).first()[0]
        if top is None:
            raise ValueError("the graph has no vertices")
        return top

    def csr_offsets(self) -> DataFrame:
        """(id, offset) for the ids 0 .. n: where each vertex's out-edges begin if edges are ordered by src."""
        return self._offsets(self.out_degrees())

    def csc_offsets(self) -> DataFrame:
        return self._offsets(self.in_degrees())

    def _offsets(self, degrees: DataFrame) -> DataFrame:
        end = degrees.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("id")).withColumn("degree", F.lit(0).cast("long"))
        return exclusive_scan(degrees.unionByName(end), "id", "degree", "offset").select("id", "offset")

    def csr(self) -> DataFrame:
        """(id, neighbours): the sorted out-neighbours of each vertex, empty where there are none."""
        return self._adjacency("src", "dst")

    def csc(self) -> DataFrame:
        return self._adjacency("dst", "src")

    def _adjacency(self, by: str, other: str) -> DataFrame:
        lists = self.edges.groupBy(F.col(by).alias("id")).agg(F.array_sort(F.collect_list(other)).alias("neighbours"))
        return self.vertices.select("id").join(lists, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>")))

    def collapse(self, weight: str | None = None) -> Graph:
        """One edge for each (src, dst): its least ``weight``, or the number of parallel edges as ``multiplicity``."""
        value = F.min(weight).alias(weight) if weight else F.count("*").alias("multiplicity")
        return Graph(self.vertices, self.edges.groupBy("src", "dst").agg(value))

    def replicate(self, copies: int) -> Graph:
        """Disjoint copies; copy k's ids are moved by k times the number of vertices."""
        n = self.vertices.count()
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))
        moved = lambda df, *ids: df.withColumn("_copy", copy).select(*((F.col(c) + F.col("_copy") * n).alias(c) if c in ids else F.col(c) for c in df.columns))
        return Graph(moved(self.vertices, "id"), moved(self.edges, "src", "dst"))

    @staticmethod
    def disjoint_union(parts: list[tuple[Graph, int]]) -> Graph:
        """Each graph so many times, ids moved by the vertices before."""
        out: Graph | None = None
        base = 0
        for graph, copies in parts:
            g = graph.replicate(copies)
            edges = g.edges.select((F.col("src") + base).alias("src"), (F.col("dst") + base).alias("dst"))
            vertices = g.vertices.select((F.col("id") + base).alias("id"))
            base += graph.vertices.count() * copies
            out = Graph(vertices, edges) if out is None else Graph(out.vertices.unionByName(vertices), out.edges.unionByName(edges))
        if out is None:
            raise ValueError("no graphs given")
        return out

    def ordered_edges(self, by: str = "src") -> DataFrame:
        """Edges with their position in the order of (``by``, other end), e.g. of a CSR layout."""
        other = "dst" if by == "src" else "src"
        base = self._offsets(self._degrees(by)).withColumnRenamed("id", by)
        rank = F.row_number().over(Window.partitionBy(by).orderBy(other)) - 1
        return self.edges.withColumn("_rank", rank).join(base, by).withColumn("position", F.col("offset") + F.col("_rank")).drop("_rank", "offset")
