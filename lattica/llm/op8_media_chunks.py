"""Media columns: payloads in a lossless container, cut by content, stored once per chunk digest, and rebuilt from ordered chunk lists.

A payload is stored as an 8-bit mono WAV file. The file is cut where a rolling gear hash of the last 64 bytes has its top bits
zero, between a least and a greatest chunk length, so equal passages give equal chunks wherever they stand. Chunks are
named by SHA-256 and deduplicated by Spark: a grouped count of digests finds the shared ones, a Bloom filter of bounded size tells
writers which chunks may be shared, and only those leave their row: the rest of a file stays in the row it came from, so
texts that share nothing cross no shuffle at all. The filter's false positives only cost a stored chunk; nothing is decided by it.

Store: a table of files (row, ordered chunk list, own chunks) and a table of shared chunks (digest, bytes), both Parquet in the
shared folder. Reading back joins the lists' missing digests with the shared chunks, puts the chunks in order, checks every digest
and the file's digest, decodes the samples and computes the features from them.

Defined cases: a null or empty text is one block of padding; equal rows are stored each as a list of the same chunks; a null
doc_id is carried along; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textarrays as ta
from lattica.llm.common import bloom_has, build_bloom, checked_broadcast, written

UNIT = 192
RATE = 8000
LEAST, MASK_BITS, MOST = 512, 11, 16384
#: References that a chunk must have at least to be copied.
HOT = 1000
_GEAR = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wav(samples: bytes) -> bytes:
    """The samples as an unsigned 8-bit mono WAV file."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + pad


def samples_of(file: bytes) -> bytes:
    """The samples of a file of ``wav``."""
    riff, _, wave, fmt, _, kind, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", file)
    if (riff, wave, fmt, kind, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data") or len(file) != 44 + n + n % 2:
        raise ValueError("not a file of the store")
    return file[44 : 44 + n]


def cuts(file: np.ndarray) -> list[int]:
    """Ends of the chunks of a file.

    The gear hash of position i is the sum of gear[byte i - k] << k; a shift by 64 bits ends what a byte contributes, and
    the top MASK_BITS bits are those that depend on the most bytes. The sum is built by doubling: windows of 1, 2, 4 ... 64 bytes.
    """
    n = len(file)
    if n <= LEAST:
        return [n]
    h = _GEAR[file]
    for k in (1, 2, 4, 8, 16, 32):
        h[k:] += h[:-k] << np.uint64(k)
    marks = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1
    out, at, i = [], 0, 0
    while n - at > LEAST:
        i += int(np.searchsorted(marks[i:], at + LEAST))
        end = int(marks[i]) if i < len(marks) else n
        at = min(end, at + MOST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def _files(column: pa.Array) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(bytes of the text, the file, its chunks) of every row."""
    data, offsets = ta.buffers(column)
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        text = raw[a:b]
        file = wav(text + b" " * (UNIT if a == b else -(b - a) % UNIT))
        ends = cuts(np.frombuffer(file, np.uint8))
        yield b - a, file, [file[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = [_short(hashlib.sha256(c).digest()) for _, _, chunks in _files(batch.column("text")) for c in chunks]
        yield pa.RecordBatch.from_arrays([pa.array(short, pa.int64())], ["short"])


def _file_rows(bloom: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = {c: [] for c in ("row", "n_bytes", "media_sha256", "digests", "lengths", "own")}
            for n_bytes, file, chunks in _files(batch.column("text")):
                names = [hashlib.sha256(c).digest() for c in chunks]
                away = bloom_has(bloom, np.array([_short(d) for d in names], np.int64))
                out["row"].append(row)
                out["n_bytes"].append(n_bytes)
                out["media_sha256"].append(hashlib.sha256(file).hexdigest())
                out["digests"].append(b"".join(names))
                out["lengths"].append([0 if x else len(c) for c, x in zip(chunks, away, strict=True)])  # 0: with the shared chunks
                out["own"].append(b"".join(c for c, x in zip(chunks, away, strict=True) if not x))
                row += 1
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["doc_id", *out])

    return run


def _shared_rows(bloom: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, bytes] = {}  # a chunk that repeats within a batch leaves it once
            for _, _, chunks in _files(batch.column("text")):
                names = [hashlib.sha256(c).digest() for c in chunks]
                away = bloom_has(bloom, np.array([_short(d) for d in names], np.int64))
                seen |= {d: zlib.compress(c, 6) for d, c, x in zip(names, chunks, away, strict=True) if x and d not in seen}
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["digest", "packed"])

    return run


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the store: (files, shared chunks)."""
    texts = docs.select("doc_id", "text")
    counted = texts.select("text").mapInArrow(_digests, "short long").groupBy("short").agg(F.count("*").alias("n"))
    shared = written(counted.filter("n > 1").select("short"), "shared-digests")
    bloom = build_bloom(shared, "short", shared.count())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    files = written(texts.mapInArrow(_file_rows(bloom), f"doc_id {id_type}, row long, n_bytes long, media_sha256 string, digests binary, lengths array<int>, own binary"), "files")
    chunks = texts.select("text").mapInArrow(_shared_rows(bloom), "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))
    return files, written(chunks, "chunks", codec="none")


def _missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, at, digests = [], [], []
        for row, lengths, names in zip(batch.column("row").to_pylist(), batch.column("lengths").to_pylist(), batch.column("digests").to_pylist(), strict=True):
            for i, n in enumerate(lengths):
                if not n:
                    rows.append(row)
                    at.append(i)
                    digests.append(names[32 * i : 32 * i + 32])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(digests, pa.binary())], ["row", "at", "digest"])


def features(samples: np.ndarray) -> str:
    """Frames of one unit: count, mean and deviation of the samples, mean zero crossings about 128, loudest frame."""
    frames = samples.reshape(-1, UNIT).astype(np.float64) - 128
    energy = np.sqrt((frames**2).mean(axis=1))
    crossings = (np.diff(np.signbit(frames).astype(np.int8), axis=1) != 0).sum(axis=1).mean()
    return f"{len(frames)},{frames.mean():.4f},{frames.std():.4f},{crossings:.4f},{energy.max():.4f},{int(energy.argmax())}"


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature", "n_chunks")}
        for names, lengths, own, got, whole in zip(*(batch.column(c).to_pylist() for c in ("digests", "lengths", "own", "got", "media_sha256")), strict=True):
            fetched = {x["at"]: zlib.decompress(x["packed"]) for x in got or []}
            parts, at = [], 0
            for i, n in enumerate(lengths):
                part = own[at : at + n] if n else fetched[i]
                at += n
                if hashlib.sha256(part).digest() != names[32 * i : 32 * i + 32]:
                    raise ValueError("a chunk differs from its digest")
                parts.append(part)
            file = b"".join(parts)
            if hashlib.sha256(file).hexdigest() != whole:
                raise ValueError("a file differs from its digest")
            samples = samples_of(file)
            out["payload_bytes"].append(len(samples))
            out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
            out["tail_crc32"].append(zlib.crc32(samples[-16:]))
            out["media_bytes"].append(len(file))
            out["feature"].append(features(np.frombuffer(samples, np.uint8)))
            out["n_chunks"].append(len(lengths))
        types = {"payload_sha256": pa.string(), "feature": pa.string()}
        cols = {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "media_sha256": batch.column("media_sha256")} | {c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()}
        yield pa.RecordBatch.from_arrays([cols[c] for c in _RESULT], list(_RESULT))


_RESULT = {"doc_id": "", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "n_chunks": "long"}


def read_back(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every file rebuilt and verified, with its features."""
    whole = F.forall("lengths", lambda n: n > 0)
    schema = ", ".join(f"{c} {t or files.schema['doc_id'].dataType.simpleString()}" for c, t in _RESULT.items())
    here = files.filter(whole).withColumn("got", F.lit(None).cast("array<struct<at:int,packed:binary>>"))
    apart = files.filter(~whole)
    refs = apart.select("row", "lengths", "digests").mapInArrow(_missing, "row long, at int, digest binary")
    got = fetched(refs, chunks).groupBy("row").agg(F.collect_list(F.struct("at", "packed")).alias("got"))
    return here.unionByName(apart.join(got, "row")).mapInArrow(_rebuilt, schema)


def fetched(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``refs`` (row, at, digest) with the chunks' bytes.

    A chunk that a quarter of a task's references or more name is copied, once for each such quarter, and its references are dealt to the
    copies, so no task has all of them; there are at most 4 such chunks, and 8 copies, for each shuffle partition.
    """
    parts = max(2, int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = written(refs.groupBy("digest").agg(F.count("*").alias("n")), "references")
    least = max(HOT, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
    hot = checked_broadcast(counts.filter(F.col("n") >= least).select("digest", F.ceil(F.col("n") / least).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    salted = refs.join(hot, "digest", "left").withColumn("copy", F.pmod(F.xxhash64("row", "at"), copies).cast("int")).drop("copies")
    copied = chunks.join(hot, "digest", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return salted.join(copied, ["digest", "copy"]).drop("copy")


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(*store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
