"""Binary CSR files: version, size of edge data, vertices, edges (64-bit each), ending offsets (64-bit), ends of edges (32-bit,
padded to 8 bytes), edge data (32-bit); all little-endian. Gzip is seen from its first bytes."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.sources.files import write_stream

_STEP = 1 << 20  # edges of an output batch


def _parts(content: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]:
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    version, edge_size, n, m = struct.unpack_from("<4Q", content)
    if version != 1:
        raise ValueError(f"version {version} is not supported")
    if edge_size not in (0, 4):
        raise ValueError(f"edge data of {edge_size} bytes is not supported")
    ends = np.frombuffer(content, "<u8", n, 32)
    dst = np.frombuffer(content, "<u4", m, 32 + 8 * n)
    data = np.frombuffer(content, "<i4", m, 32 + 8 * n + 4 * (m + m % 2)) if edge_size else None
    return n, m, ends, dst, data


def _edges(values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                n, m, ends, dst, data = _parts(content)
                if values and data is None:
                    raise ValueError("the file has no edge values")
                for a in range(0, m, _STEP):
                    b = min(a + _STEP, m)
                    src = np.searchsorted(ends, np.arange(a, b), "right").astype(np.int64)
                    cols = [pa.array(src), pa.array(dst[a:b].astype(np.int64))] + ([pa.array(data[a:b])] if values else [])
                    yield pa.RecordBatch.from_arrays(cols, ["src", "dst", "w"][: len(cols)])

    return run


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content").to_pylist():
            n, _, ends, _, _ = _parts(content)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(np.concatenate([[0], ends]).astype(np.int64))], ["id", "offset"])


def _size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content").to_pylist():
            head = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            yield pa.RecordBatch.from_arrays([pa.array([struct.unpack_from("<4Q", head)[2]], pa.int64())], ["n"])


def read_binary_csr(spark: SparkSession, path: str, values: bool = False) -> Graph:
    """A graph; self loops stay. A file is read by one task, so it can't exceed what a binary column holds (2 GB)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    n = files.mapInArrow(_size, "n long").agg(F.max("n")).first()[0]
    edges = files.mapInArrow(_edges(values), "src long, dst long, w int" if values else "src long, dst long")
    return Graph(spark.range(n or 0), edges)


def read_binary_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(id, offset) for the ids 0 .. n: the file's row offsets, with the leading 0."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_offsets, "id long, offset long")


def _packed(column: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(column).to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary())], ["b"])

    return run


def write_binary_csr(graph: Graph, path: str) -> None:
    """One file; edges in the order of (src, dst, w). Sections are streamed through the driver in batches."""
    values = "w" in graph.edges.columns
    edges = graph.edges.orderBy("src", "dst", *["w"] * values).persist()
    n, m = graph.vertices.count(), edges.count()
    ends = graph.csr_offsets().filter("id > 0").orderBy("id")

    def section(rows: DataFrame, column: str, kind: str) -> Iterator[bytes]:
        for row in rows.select(column).mapInArrow(_packed(column, kind), "b binary").toLocalIterator():
            yield bytes(row[0])

    def parts() -> Iterator[bytes]:
        yield struct.pack("<4Q", 1, 4 if values else 0, n, m)
        yield from section(ends, "offset", "<u8")
        yield from section(edges, "dst", "<u4")
        if m % 2:
            yield b"\0" * 4
        if values:
            yield from section(edges, "w", "<i4")

    write_stream(graph.spark, path, parts())
    edges.unpersist()
