"""Formats by file name, and conversion between them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.sources.binary import read_binary_csr, write_binary_csr
from lattica.sources.files import exists
from lattica.sources.text import read_edge_list, read_matrix_market, write_edge_list, write_matrix_market

#: Beginnings of extensions and what they mean.
EXTENSIONS = {"edge": "edges", "mtx": "mtx", "gr": "gr"}


def graph_format(path: str) -> str:
    """The format by the last extension, one of ``.gz`` left aside."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    parts = name.removesuffix(".gz").split(".")
    for start, kind in EXTENSIONS.items():
        if len(parts) > 1 and parts[-1].startswith(start):
            return kind
    raise ValueError(f"unknown graph format: {path}")


def read_graph(spark: SparkSession, path: str, values: bool = False, fmt: str | None = None) -> Graph:
    """Read a graph file; with ``values`` edges have ``w`` where the format and the file have it."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    fmt = fmt or graph_format(path)
    if fmt == "edges":
        return read_edge_list(spark, path)
    return read_matrix_market(spark, path, values) if fmt == "mtx" else read_binary_csr(spark, path, values)


def write_graph(graph: Graph, path: str, fmt: str | None = None) -> None:
    {"edges": write_edge_list, "mtx": write_matrix_market, "gr": write_binary_csr}[fmt or graph_format(path)](graph, path)


def convert(spark: SparkSession, source: str, target: str, values: bool = True) -> None:
    """Read one format and write another, with edge values where the source has them."""
    write_graph(read_graph(spark, source, values and graph_format(source) != "edges"), target)


def random_weights(graph: Graph, seed: int = 0, most: int = 100) -> Graph:
    """Edges with ``w`` in 0 .. most, the same for the same (src, dst, seed)."""
    w = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(most + 1)).cast("int")
    return Graph(graph.vertices, graph.edges.select("src", "dst", w.alias("w")))


def replicate_files(spark: SparkSession, parts: list[tuple[str, int]], target: str) -> None:
    """The disjoint union of copies of graph files."""
    write_graph(Graph.disjoint_union([(read_graph(spark, p), n) for p, n in parts]), target)
