"""Best-fit packing of tokenised documents into sequences by bin completion.

A piece of ``capacity`` tokens is a sequence by itself, so what has to be packed are lengths below the capacity: at
most ``capacity`` - 1 different ones. Tokenising writes the pieces once; a grouped count gives the histogram of lengths
(bounded by the capacity, whatever the corpus), and the driver solves the histogram, not the pieces: around the largest
length left it enumerates the undominated fillings of the rest of a sequence, applies the chosen filling as often as the
counts allow, and branches with a bound on the waste; best-fit decreasing gives the first incumbent. Each filling that is
applied uses up one length, so there are at most ``capacity`` patterns. The pieces get a rank within their length (task-
local ranks plus per-task offsets, no global sort), and a rank leads to its pattern, copy and offset by binary search.

Defined cases: a null or empty text has the end token alone; equal rows are packed each; a null doc_id is carried along;
an empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lattica.llm.common import checked_broadcast, trimmed, written

#: Steps of one branch-and-bound search at most, and the numbers of fillings looked at for each in the searches that follow one
#: another until the lower bound is met; the incumbent stands beyond them.
NODES, WIDTHS = 4000, (2, 4, 1, 3, 8)
Pattern = tuple[int, dict[int, int]]  # copies, {length: how many in each}


# ---- packing of a histogram -------------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the larger of the volume bound and Martello and Toth's L2."""
    size = np.arange(len(counts))
    best = -(-int((counts * size).sum()) // capacity)
    for k in range(0, capacity // 2 + 1):
        big, mid = counts[capacity - k + 1 :].sum(), counts[capacity // 2 + 1 : capacity - k + 1]
        mid_size = size[capacity // 2 + 1 : capacity - k + 1]
        low = int((counts[k : capacity // 2 + 1] * size[k : capacity // 2 + 1]).sum())
        free = int((mid * (capacity - mid_size)).sum())
        best = max(best, int(big + mid.sum()) + max(0, -(-(low - free) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over groups of equally filled sequences."""
    groups: dict[int, list[list]] = {}  # room left: [copies, contents]
    done: list[Pattern] = []
    for s in range(len(counts) - 1, 0, -1):
        n = int(counts[s])
        while n:
            room = next((r for r in range(s, capacity + 1) if groups.get(r)), 0)
            if not room:
                per = capacity // s
                copies, rest = divmod(n, per)
                for c, q in ((copies, per), (1, rest)):
                    if c and q:
                        groups.setdefault(capacity - q * s, []).append([c, {s: q}])
                n = 0
                continue
            group = groups[room][-1]
            per = min(room // s, n)
            c = min(group[0], n // per)
            group[0] -= c
            if not group[0]:
                groups[room].pop()
            groups.setdefault(room - per * s, []).append([c, group[1] | {s: per}])
            n -= c * per
    for gs in groups.values():
        done += [(c, what) for c, what in gs]
    return done


def fillings(room: int, counts: np.ndarray, sizes: np.ndarray, slack: int, width: int) -> list[tuple[int, dict[int, int]]]:
    """(waste, filling) of undominated fillings of ``room``, least waste first, fewer and larger pieces before others.

    A filling is dominated if another piece still fits, if one of its pieces can be exchanged for a larger one that
    is there, or two of them for a single one. Fillings that waste more than ``slack`` are cut off.
    """
    found: list[tuple[int, int, dict[int, int]]] = []
    steps = 0
    fit = sizes[sizes <= room]
    listed = fit.tolist()

    def there(low: int, high: int, what: dict[int, int]) -> bool:
        return any(counts[y] > what.get(y, 0) for y in listed[bisect_left(listed, low) : bisect_right(listed, high)])

    def undominated(what: dict[int, int], waste: int) -> bool:
        flat = [s for s, q in what.items() for _ in range(min(q, 2))]
        if waste and any(there(a + 1, a + waste, what) for a in what):
            return False
        return not any(there(a + b, min(a + b + waste, room), what) for i, a in enumerate(flat) for b in flat[i + 1 :])

    def grow(left: int, what: dict[int, int], top: int) -> None:
        nonlocal steps
        steps += 1
        if len(found) >= 4 * width or steps > 60 * width:
            return
        top = bisect_right(listed, min(left, top))
        usable = [s for s in listed[max(0, top - 3 * width) : top][::-1] if counts[s] > what.get(s, 0)]
        if not usable:
            if left <= slack and undominated(what, left):
                found.append((left, sum(what.values()), dict(what)))
            return
        for s in usable:
            q = what.get(s, 0)
            what[s] = q + 1
            grow(left - s, what, s)
            if q:
                what[s] = q
            else:
                del what[s]
            if left - s == 0 and found:
                break

    grow(room, {}, room)
    found.sort(key=lambda x: (x[0], x[1]))
    return [(w, f) for w, _, f in found[:width]]


def sequences(patterns: list[Pattern]) -> int:
    return sum(c for c, _ in patterns)


def complete(counts: np.ndarray, capacity: int, nodes: int = NODES, widths: tuple[int, ...] = WIDTHS) -> list[Pattern]:
    """Patterns that pack the histogram: bin completion, with best-fit decreasing as the first incumbent.

    A depth-first search seldom leaves the subtree of its first choices, so searches of other widths, whose first choices differ, follow
    one that doesn't meet the lower bound. Each has the best packing so far as its incumbent.
    """
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    for width in widths:
        if sequences(best) <= bound:
            break
        best = _search(counts, capacity, best, bound, nodes, width)
    return best


def _search(counts: np.ndarray, capacity: int, best: list[Pattern], bound: int, nodes: int, width: int) -> list[Pattern]:
    """The best packing that ``nodes`` steps of branch and bound find, or the incumbent."""
    best_n, volume = sequences(best), int((counts * np.arange(len(counts))).sum())
    left, plan, waste, seen = counts.astype(np.int64).copy(), [], 0, 0
    choices: list[list[tuple[int, dict[int, int]]]] = []

    def options() -> list[tuple[int, dict[int, int]]]:
        sizes = np.flatnonzero(left)
        s = int(sizes[-1])
        left[s] -= 1
        slack = (best_n - 1) * capacity - volume - waste  # a packing that beats the incumbent wastes no more
        out = fillings(capacity - s, left, np.flatnonzero(left), max(slack, 0), width) if slack >= 0 else []
        left[s] += 1
        return [(w, {**f, s: f.get(s, 0) + 1}) for w, f in reversed(out)]

    while seen < nodes and best_n > bound:
        seen += 1
        if not left.any():
            n = sequences(plan)
            if n < best_n:
                best, best_n = list(plan), n
            choices.append([])
        else:
            choices.append(options())
        while choices and not choices[-1]:
            choices.pop()
            if plan and len(plan) > len(choices) - 1 and choices:
                copies, what = plan.pop()
                waste -= copies * (capacity - sum(s * q for s, q in what.items()))
                for s, q in what.items():
                    left[s] += copies * q
        if not choices:
            break
        w, what = choices[-1].pop()
        copies = min(int(left[s]) // q for s, q in what.items())
        plan.append((copies, what))
        waste += copies * w
        for s, q in what.items():
            left[s] -= copies * q
    return best


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: rows (length, first rank, first sequence, pieces in each, offset)."""
    rows, rank, base = [], {}, 0
    for copies, what in patterns:
        at = 0
        for s, q in sorted(what.items(), reverse=True):
            rows.append((s, rank.get(s, 0), base, q, at))
            rank[s] = rank.get(s, 0) + copies * q
            at += s * q
        base += copies
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) | a[:, 1], "first": a[:, 1], "base": a[:, 2], "per": a[:, 3], "offset": a[:, 4]}


# ---- Spark ----------------------------------------------------------------------------------------------------------


def tokenizer(path: str, ranks: str | None):
    """text -> uint32 ids of the tokenizers file at ``path``; ``ranks`` is the same vocabulary for the faster library."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    plain = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks is None:
        return plain
    import public_tokenizers
    import tiktoken

    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: plain(text) if any(s in text for s in special) else np.array(fast.encode_ordinary(text), np.uint32)


def _pieces(path: str, ranks: str | None, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = tokenizer(path, ranks), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids_of, out = batch.column("doc_id"), {c: [] for c in ("row", "piece", "start", "length", "crc", "k")}
            for row, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                cut = len(ids) % capacity if len(ids) > capacity else 0
                starts = [*([0] if cut else []), *range(cut, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    out["row"].append(row)
                    out["piece"].append(piece)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["crc"].append(zlib.crc32(ids[a:b].tobytes()))
                    out["k"].append(seen[b - a])
                    seen[b - a] += 1
            n = len(out["row"])
            yield pa.RecordBatch.from_arrays(
                [ids_of.take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(np.array(out["k"], np.int64))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"],
            )

    return run


def _placed(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy().astype(np.int64)
            i = np.searchsorted(table["key"], (length << 44) | rank, "right") - 1
            copy, slot = np.divmod(rank - table["first"][i], table["per"][i])
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(table["base"][i] + copy), pa.array(table["offset"][i] + slot * length)], [*names, "sequence_id", "offset"])

    return run


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack(docs: DataFrame, capacity: int = 1024, end: int = 2, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    if path is None:
        path, ranks = default_tokenizer()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, k long"
    pieces = written(docs.select("doc_id", "text").mapInArrow(trimmed(_pieces(path, ranks, capacity, end)), schema), "pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = per_task.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*")).collect():  # capacity rows at most
        counts[length] = n
    whole, counts[capacity] = int(counts[capacity]), 0
    patterns = [(whole, {capacity: 1})] * bool(whole) + (complete(counts, capacity) if counts.any() else [])
    ranked = pieces.join(checked_broadcast(before), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("rank"))
    out = T.StructType([f for f in ranked.schema if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_placed(places(patterns)), out)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
