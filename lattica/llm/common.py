"""Shared pieces: scratch tables in the cluster's shared folder, checked broadcasts, Bloom filters."""

from __future__ import annotations

import contextlib
import ctypes
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import shared_dir

#: Rows up to which a table of short fixed-width rows may be broadcast (about 16 to 64 bytes each).
BROADCAST_ROWS = 200_000
#: Bytes that a broadcast table's rows may have in all.
BROADCAST_BYTES = 16 << 20
#: Bits of a Bloom filter at most: 16 MB. Beyond its capacity it only lets more rows through.
BLOOM_BITS = 1 << 27
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Scratch files in a ``file:`` folder get no checksum file beside them: Hadoop's local file systems start a process (chmod) for each
#: file they make, and while one starts, the executor's memory counts twice for whoever looks at it.
_NO_CHECKSUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: The folder of each table that ``written`` made, until ``unwritten`` deletes it.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def written(df: DataFrame, name: str, codec: str = "zstd", batch: int | None = None, sweep: bool = False, rows: int | None = None, each: int = 50_000) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    ``batch`` is the number of rows that Python workers get at once meanwhile, for rows of texts or sketches. ``sweep`` lets
    the driver collect its garbage afterwards: Spark deletes a job's shuffle files when nothing refers to them any more, and a
    small driver heap may else take long to find that out. ``rows``, where it is known, is how many rows there are at most: the last
    stage then has a task, and the table a file, for every ``each`` of them at most, and not one for each shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df = df if rows is None else df.coalesce(max(4, rows // each))
    before = spark.conf.get(_BATCH)
    if batch is not None:
        spark.conf.set(_BATCH, batch)
    try:
        df.write.options(**_NO_CHECKSUMS).option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    if sweep:
        spark.sql("SELECT 1").collect()  # the listeners hold what ended last
        time.sleep(0.1)
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers of this session get that many rows at once at most from now on: texts of some kilobytes, held by JVM and worker."""
    if int(spark.conf.get(_BATCH)) > rows:
        spark.conf.set(_BATCH, rows)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow; at the end of a task its Python worker gives the system what it has freed. Workers stay for the next
    tasks and, idle, for a minute, beside the JVM of whatever stage comes next."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError, TypeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return lean


def unwritten(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        _, path = _PATHS.pop(id(df), (None, None))
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened until none is among ``taken`` (case doesn't count in SQL)."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, row_bytes: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it was measured to be small; else as it is, for a shuffle join.

    Rows are counted, no more than must be. Rows with strings, binaries or arrays are weighed too: all of them together may have
    ``BROADCAST_BYTES``, told from the lengths of such columns; ``row_bytes`` sets the rest of a row.
    """
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    lists = [c for c, kind in df.dtypes if kind.startswith("array<")]
    head = df.limit(limit + 1)
    weight = F.lit(row_bytes or 16 * len(df.columns)).cast("long")
    for c in wide:
        weight = weight + F.coalesce(F.octet_length(F.col(f"`{c}`")).cast("long"), F.lit(0))
    for c in lists:
        weight = weight + F.greatest(F.size(F.col(f"`{c}`")), F.lit(0)).cast("long") * 16
    n, size = head.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and size <= BROADCAST_BYTES else df


def tokens_of(col: str | Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased; null or blank gives an empty array."""
    c = F.col(col) if isinstance(col, str) else col
    low = F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def build_bloom(df: DataFrame, col: str, rows: int, max_bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter (two probes) of a column of 64-bit hashes as an array of 64-bit words.

    The bits are set by a grouped aggregation, so what reaches the driver is the bitmap alone,
    ``max_bits`` / 64 rows at most whatever the size of ``df``.
    """
    bits = min(max_bits, 1 << max(13, int(np.ceil(np.log2(max(1, rows) * 16)))))
    x = F.col(col)
    probes = df.select(F.explode(F.array(x.bitwiseAND(bits - 1), F.shiftrightunsigned(x, 32).bitwiseAND(bits - 1))).alias("b"))
    words = probes.groupBy(F.shiftright("b", 6).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("w"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()  # toPandas makes a Python row of each
    out[got["i"].to_numpy()] = got["w"].to_numpy()
    return out.view(np.uint64)


def bloom_has(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Membership of 64-bit ``hashes`` in the filter; no false negatives."""
    h = hashes.astype(np.int64).view(np.uint64)
    mask = np.uint64(len(bloom) * 64 - 1)
    out = np.ones(len(h), bool)
    for p in (h & mask, (h >> np.uint64(32)) & mask):
        out &= (bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


NO_ID = -(1 << 63)


def keyed(docs: DataFrame, d: str = "_d", t: str = "_t", text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with a column of the doc_id (a null as the least long) and one of the text's hash, by which joins can name a row, and the
    columns' names: ``d`` and ``t``, lengthened where ``docs`` has them."""
    d, t = fresh(docs.columns, d, t)
    return docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), t: F.xxhash64(text)}), d, t


def without(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``names`` (_d, _t), a table of few or many distinct rows, names."""
    rows, d, t = keyed(docs)
    gone = checked_broadcast(names.select(F.col("_d").alias(d), F.col("_t").alias(t)))
    return rows.join(gone, [d, t], "left_anti").select(*(f"`{c}`" for c in docs.columns))


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column computed once a row: a generator that Catalyst doesn't merge into later lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def sheltered(df: DataFrame, *used: str, more: dict[str, Column] | None = None) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with all columns but the ``used`` ones renamed to u0__, u1__, ..., which no operator uses itself, and a function that
    gives a result the columns of ``df`` again (those it has, in order) and then those named, lengthened by ``_`` where ``df`` has such
    a column. ``more`` has columns of ``df`` to be computed besides."""
    inner = {c: c if c in used else f"u{i}__" for i, c in enumerate(df.columns)}

    def restored(out: DataFrame, *added: str) -> DataFrame:
        names = fresh(df.columns, *added)
        return out.select(*(F.col(k).alias(c) for c, k in inner.items() if k in out.columns), *(F.col(a).alias(n) for a, n in zip(added, names, strict=True)))

    return df.select(*(F.col(f"`{c}`").alias(k) for c, k in inner.items()), *(v.alias(k) for k, v in (more or {}).items())), restored
