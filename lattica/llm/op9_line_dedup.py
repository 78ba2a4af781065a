"""Line dedup: a key of at least ``min_chars`` code points that at least ``min_docs`` documents hold stays in the largest doc_id alone.

Lines become (128-bit key hash, document, position) rows, range-partitioned by hash *and* document, so a key that a
third of all lines share is spread over many partitions, and sorted within partitions (secondary sort by document and
position). One pass streams each partition with memory for one batch. The first and the last key of a partition may go
on in a neighbour: for those alone a summary row is written (two a partition), and their verdict comes from the sum of the
summaries. The result is one zlib-compressed keep bitmap per changed document; texts are read again only to apply it.

Defined cases: a null or empty text is one empty line; a null doc_id is one document, smaller than all others; rows
that share a doc_id are one document, and each of its texts gets its own bitmap; equal rows get equal results; an empty
table gives an empty result; other columns, whatever their names, are carried along by ``apply_bitmaps`` and otherwise not looked at (a
column named as one of its two results keeps its name, and the result's gets a ``_``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import NO_ID, checked_broadcast, keyed, sheltered, written

SPACE = " \t\n\x0b\x0c\r"
_DROP, _OPEN, _EDGE = 0, 1, 2
_STREAM = "kind byte, h long, g long, d long, t long, pos int"


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return F.btrim(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(SPACE))


def _stream(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros((5, 0), np.int64)  # rows h, g, d, t, pos; pos -1: only stands for a document that was seen
        first_key = None

        def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], kind, np.int8)), *map(pa.array, rows[:4]), pa.array(rows[4].astype(np.int32))], ["kind", "h", "g", "d", "t", "pos"])

        def summary(run_rows: np.ndarray) -> np.ndarray:
            x = run_rows[:, :1].copy()
            x[4] = len(np.unique(run_rows[2]))
            return x

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "g", "d", "t", "pos")])
            rows = np.concatenate([carry, rows], axis=1)
            if not rows.shape[1]:
                continue
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            start = np.flatnonzero(new)
            other = new.copy()
            other[1:] |= rows[2, 1:] != rows[2, :-1]
            docs = np.add.reduceat(other.astype(np.int64), start)
            run_of = np.cumsum(new) - 1
            if first_key is None:
                first_key = (rows[0, 0], rows[1, 0])
            is_first = (rows[0, start] == first_key[0]) & (rows[1, start] == first_key[1])
            done = np.ones(len(start), bool)
            done[-1] = False  # the last run may go on
            settled = done | (docs >= min_docs)
            real = rows[4] >= 0
            drop = settled[run_of] & (docs >= min_docs)[run_of] & (rows[2] != rows[2, start][run_of]) & real & ~is_first[run_of]
            if drop.any():
                yield out(_DROP, rows[:, drop])
            pending = is_first[run_of] & real & settled[run_of]
            if pending.any():
                yield out(_OPEN, rows[:, pending])
            if is_first[0] and len(start) > 1:
                yield out(_EDGE, summary(rows[:, : start[1]]))
            carry = rows[:, start[-1] :]
            if settled[-1]:  # its rows are out; min_docs rows stand for the documents seen
                carry = carry[:, np.flatnonzero(other[start[-1] :])[:min_docs]].copy()
                carry[4] = -1
        if carry.shape[1]:
            rest = carry[:, carry[4] >= 0]
            if rest.shape[1]:
                yield out(_OPEN, rest)
            yield out(_EDGE, summary(carry))

    return run


def _pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        maps = []
        for n, drop in zip(batch.column("n").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            keep = np.ones(-(-n // 8) * 8, np.uint8)  # lines behind the last dropped one stay
            keep[drop] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), pa.array(maps, pa.binary())], ["d", "t", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """(d, t, keep): for each text that loses lines its document, its xxhash64 and the zlib-compressed bits of the lines it keeps."""
    spark = docs.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("d"), F.xxhash64("text").alias("t"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keys = base.select("d", "t", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    rows = keys.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "d", "t", "pos")
    ranged = rows.repartitionByRange(n, F.col("h"), F.col("g"), F.col("d").desc()).sortWithinPartitions("h", "g", F.col("d").desc(), "t", "pos")
    streamed = written(ranged.mapInArrow(_stream(min_docs), _STREAM), "line-verdicts")
    edges = streamed.filter(F.col("kind") == _EDGE).groupBy("h", "g").agg(F.sum("pos").alias("docs"), F.max("d").alias("largest")).filter(F.col("docs") >= min_docs)
    late = streamed.filter(F.col("kind") == _OPEN).join(checked_broadcast(edges), ["h", "g"]).filter("d < largest").select("d", "t", "pos")
    drops = streamed.filter(F.col("kind") == _DROP).select("d", "t", "pos").unionByName(late)
    per_text = drops.groupBy("d", "t").agg(F.array_distinct(F.collect_list("pos")).alias("drop"), (F.max("pos") + 1).alias("n"))
    return written(per_text.mapInArrow(_pack, "d long, t long, keep binary"), "line-bitmaps")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, keeps, n_lines, n_dropped = batch.column("text").to_pylist(), batch.column("keep").to_pylist(), [], []
        for i, (text, keep) in enumerate(zip(texts, keeps, strict=True)):
            n_lines.append(1 if text is None else text.count("\n") + 1)
            n_dropped.append(0)
            if keep is not None:
                lines = text.split("\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
                kept = [x for x, b in zip(lines, np.concatenate([bits, np.ones(len(lines) - len(bits), np.uint8)]), strict=True) if b]
                texts[i] = "\n".join(kept)
                n_dropped[-1] = len(lines) - len(kept)
        cols = [batch.column(c) for c in batch.schema.names if c not in ("text", "keep")]
        names = [c for c in batch.schema.names if c not in ("text", "keep")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "text", "line_dedup_lines", "line_dedup_dropped"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text``, and the columns line_dedup_lines and line_dedup_dropped."""
    inner, restored = sheltered(docs, "doc_id", "text")
    b = checked_broadcast(bitmaps).select(F.col("d").alias("_d"), F.col("t").alias("_t"), "keep")
    joined = keyed(inner)[0].join(b, ["_d", "_t"], "left").drop("_d", "_t")
    others = [f for f in inner.schema if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "text string, line_dedup_lines long, line_dedup_dropped long"])
    out = joined.select(*(f"`{f.name}`" for f in others), "text", "keep").mapInArrow(_apply, schema)
    return restored(out, "line_dedup_lines", "line_dedup_dropped")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.col("line_dedup_lines").alias("n_lines"), F.col("line_dedup_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         lower_ascii AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) t,
       LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line) u,
       LATERAL (SELECT translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii) v
), hot AS (
  SELECT key, max(doc_id) AS largest FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (h.key IS NOT NULL AND l.doc_id <> h.largest) AS dropped
  FROM lines l LEFT JOIN hot h ON l.key = h.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
