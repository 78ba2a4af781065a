"""Edge lists and Matrix Market files: distributed line parsing, gzip read as it is."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.sources.files import write_stream

_ENDS = r"^\s*([+-]?\d+)\s+([+-]?\d+)"


def _lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return lines.filter((F.trim(F.translate("value", "\t\r\x0b\x0c", "    ")) != "") & ~F.col("value").startswith(comment))


def _parsed(lines: DataFrame, one_based: bool, values: bool) -> DataFrame:
    """(src, dst[, w]); a line without two ids, or without a value where values are asked for, is an error."""
    bad = F.raise_error(F.concat(F.lit("error parsing edge line: "), F.col("value")))
    end = lambda i: F.when(F.col("value").rlike(_ENDS), F.regexp_extract("value", _ENDS, i)).otherwise(bad).cast("long") - int(one_based)
    cols = [end(1).alias("src"), end(2).alias("dst")]
    if values:
        pattern = _ENDS + r"\s+([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
        cols.append(F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 3)).otherwise(bad).cast("float").cast("int").alias("w"))
    return lines.select(*cols)


def _graph(edges: DataFrame) -> Graph:
    """Self loops go, but the ids they name are vertices."""
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return Graph.from_edges(edges.filter("src <> dst"), 0 if top is None else top + 1)


def read_edge_list(spark: SparkSession, path: str) -> Graph:
    """Lines ``src dst`` of 0-based ids; ``#`` begins a comment line; what follows the ids is not read."""
    return _graph(_parsed(_lines(spark, path, "#"), one_based=False, values=False))


def header(spark: SparkSession, path: str) -> tuple[bool, str]:
    """(has values, symmetry) of a Matrix Market file."""
    first = spark.read.text(path).limit(1).first()
    words = (first[0] if first else "").lower().split()
    if len(words) < 5 or words[1] != "matrix":
        raise ValueError(f"not a matrix header: {first and first[0]}")
    kind, entries, symmetry = words[2:5]
    if kind != "coordinate":
        raise ValueError(f"only coordinate matrices are supported, not {kind}")
    if entries == "complex":
        raise ValueError("complex entries are not supported")
    if symmetry not in ("general", "symmetric", "skew-symmetric", "hermitian"):
        raise ValueError(f"unknown symmetry {symmetry}")
    return entries != "pattern", symmetry


def read_matrix_market(spark: SparkSession, path: str, values: bool = False) -> Graph:
    """A coordinate matrix as a graph of 0-based ids. The first line that isn't a comment gives sizes and is passed over; values are
    cut to integers; symmetric matrices give both directions, skew-symmetric ones the negative value for the second. A pattern
    file has no ``w`` even if values are asked for."""
    has_values, symmetry = header(spark, path)
    values = values and has_values
    if symmetry == "hermitian" and values:
        raise ValueError("values of Hermitian matrices are not supported")
    lines = _lines(spark, path, "%")
    first = lines.select(F.struct("_block", "_line").alias("x")).agg(F.min("x")).first()[0]  # the size line, by place
    if first is None:
        raise ValueError("no size line")
    edges = _parsed(lines.filter((F.col("_block") != first["_block"]) | (F.col("_line") != first["_line"])), one_based=True, values=values)
    if symmetry != "general":
        sign: Column = -F.col("w") if symmetry == "skew-symmetric" and values else F.col("w") if values else F.lit(None)
        back = [F.col("dst").alias("src"), F.col("src").alias("dst"), *([sign.alias("w")] if values else [])]
        there = [F.col("src"), F.col("dst"), *([F.col("w")] if values else [])]
        edges = edges.select(F.inline(F.array(F.struct(*there), F.struct(*back))))
    return _graph(edges)


def _text(rows: DataFrame, columns: list[str]) -> Iterator[bytes]:
    for row in rows.select(F.concat_ws(" ", *columns).alias("v")).toLocalIterator():
        yield row[0].encode() + b"\n"


def _joined(parts: Iterator[bytes], size: int = 1 << 16) -> Iterator[bytes]:
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p)
        if n >= size:
            yield b"".join(held)
            held, n = [], 0
    yield b"".join(held)


def write_matrix_market(graph: Graph, path: str) -> None:
    """One file, 1-based, ``integer general`` or ``pattern general``, in the order of (src, dst)."""
    values = "w" in graph.edges.columns
    n, m = graph.vertices.count(), graph.edges.count()
    cols = ["src", "dst"] + ["w"] * values
    rows = graph.edges.orderBy(*cols).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), *cols[2:])

    def parts() -> Iterator[bytes]:
        yield f"%%MatrixMarket matrix coordinate {'integer' if values else 'pattern'} general\n{n} {n} {m}\n".encode()
        yield from _text(rows, cols)

    write_stream(graph.spark, path, _joined(parts()))


def write_edge_list(graph: Graph, path: str) -> None:
    """One file of 0-based ``src dst`` lines in order."""
    write_stream(graph.spark, path, _joined(_text(graph.edges.orderBy("src", "dst"), ["src", "dst"])))
