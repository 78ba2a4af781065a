"""Language-model scores by a probabilistic suffix tree over words.

The tree's states are contexts of any number of words. With c(sw) the training occurrences of the word (or end) w after the context
s - where they are at least two without the first word of s, and none otherwise -, c(s) their sum, B(s) the number of different
words after s, and Q the distribution of the longest retained proper suffix of s,

    P(w | s) = (c(sw) + B(s) Q(w)) / (c(s) + B(s)),      P(w) = (c(w) + 1) / (N + V + 1)  without a context.

Each distribution sums to one; a word not in training has the mass of one unknown symbol. A context is retained if it diverges from
that suffix: its occurrences times the Kullback-Leibler divergence of its next-symbol distribution from Q, each occurrence judged by
the others (leaving one out, so what occurs once speaks against a context), is ``min_gain`` nats or more. A word is scored in the longest
retained suffix of what is before it. Counts are exact and cover all training texts; two occurrences can make a state in a
corpus of any size, and there is no greatest depth: a context s is lengthened while the sum over the w with c(sw) >= 2 of
c(sw) log 1 / P(w | s) reaches ``min_gain``, which no longer context can gain otherwise, and, from two words on, if it is
retained. So all contexts of one and two words are tried; what only three or more words together tell, and the last two don't, is not
found. (The test takes log Q in steps of 0.001.)

Tokens lie in blocks, a row each. At a level every block sends what it counted after each context, compressed, to the partition
of the context; the partition sums the blocks' counts, judges the context, and sends the counts of what was asked back to the
blocks. So the corpus is never exploded into rows, and a level takes two shuffles of a few bytes for each different
continuation of a block. What occurred once at one level isn't sent at the next, only how often that was so. A context that has more than
half a partition's share of all occurrences is dealt to several partitions by the next symbol, and judged from their sums.

Words and contexts are told apart by 64-bit hashes of the words alone; above them all is exact. ``block_tokens`` bounds the memory of
a task that walks a block (about 200 bytes a token), and ``parts`` (spark.sql.shuffle.partitions) that of one that counts (about 100
bytes for each different continuation); on a corpus of 10^12 tokens and more ``block_tokens`` should grow with its square root.

Defined cases: a null or empty text has the end token alone; rows that share a doc_id are scored each; a null doc_id is taken
as the text "" for the split; an empty table gives an empty result; with nothing to train on all tokens are unknown; a text longer
than a block is a block; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm import textarrays as ta
from lattica.llm.common import unwritten, written

#: The end token's hash; 2**-64 odds that a word has it.
END = np.uint64(0x3C6EF372FE94F82B)
BLOCK_TOKENS = 600_000
_RETAINED, _GROWS, _SPREAD = 1, 2, 4
_STATE_BEFORE = 1 << 20
_ROW = "kind int, block long, part int, payload binary, a long, b long"
_NAMES = ["kind", "block", "part", "payload", "a", "b"]
_BLOCK, _SHIP, _STATE, _MORE = -1, 0, 1, 2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers (in as few bytes as they need) or floats, compressed byte plane by byte plane."""
    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype != np.float64:
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        head += [a.dtype.itemsize * (-1 if a.dtype == np.float64 else 1), len(a)]
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(1).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 16 * n].view(np.int64).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for size, length in head.tolist():
        width = abs(size)
        a = np.ascontiguousarray(raw[at : at + width * length].reshape(width, length).T).view(np.float64 if size < 0 else f"<u{width}").ravel()
        out.append(a if size < 0 or width == 8 else a.astype(np.int64))
        at += width * length
    return out


def _row(kind: int, block: int, part: int, payload: bytes | None, a: int | None = None, b: int | None = None) -> pa.RecordBatch:
    cols = zip((kind, block, part, payload, a, b), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cols], _NAMES)


# ---- blocks -------------------------------------------------------------------------------------------------------


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with the end tokens, tokens of each row) of runs of rows."""
    data, offsets = ta.buffers(batch.column("text"))
    for a, b, raw, off in ta.chunks(data, offsets):
        words, first = ta.word_hashes(raw, off)
        yield a, b, np.insert(words, first[1:], END), np.diff(first) + 1


def held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _blocks(block_tokens: int, parts: int, id_type: pa.DataType):
    """Rows of kind -1, a block each, and of kind 0, the different words of a block with their counts for each range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 28
        tokens, sizes, ids, held_tokens = [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            words, local = np.unique(np.concatenate(tokens), return_inverse=True)
            docs, n = pa.concat_arrays(ids), np.concatenate(sizes)
            held = np.array([held_out(i) for i in docs.to_pylist()], np.uint8)
            count = np.bincount(local[np.repeat(held == 0, n)], minlength=len(words))
            lists = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            yield with_ids(_row(_BLOCK, name, 0, pack(local, n, held)), lists)
            for p, at in _by_part(((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), parts):
                yield with_ids(_row(_SHIP, name, p, pack(words[at], count[at])), pa.nulls(1, pa.list_(id_type)))

        def with_ids(row: pa.RecordBatch, lists: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*row.columns, lists.cast(pa.list_(id_type))], [*_NAMES, "ids"])

        for batch in batches:
            for a, b, t, n in _tokens(batch):
                tokens.append(t)
                sizes.append(n)
                ids.append(batch.column("doc_id").slice(a, b - a))
                held_tokens += len(t)
                if held_tokens >= block_tokens:
                    yield from block()
                    tokens, sizes, ids, held_tokens, name = [], [], [], 0, name + 1
        if tokens:
            yield from block()

    return run


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places in order) of the parts that occur."""
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(at)).tolist():
        yield p, order[at[p] : at[p + 1]]


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, list[np.ndarray]]]]]:
    """(part, [(block, arrays)]) of rows sorted by part."""
    part, held = None, []
    for batch in batches:
        for p, block, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "payload")), strict=True):
            if part is not None and p != part:
                yield part, held
                held = []
            part = p
            held.append((block, unpack(payload)))
    if held:
        yield part, held


def _count_words(parts: int):
    """Sends each block the count and the id of its words; frequent words have small ids. A row -1 has the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _parts_of(batches):
            words, of = np.unique(np.concatenate([x[0].astype(np.uint64) for _, x in held]), return_inverse=True)
            count = np.bincount(of, np.concatenate([x[1] for _, x in held]).astype(np.float64), len(words)).astype(np.int64)
            ids = np.empty(len(words), np.int64)
            ids[np.argsort(-count, kind="stable")] = np.arange(len(words))
            ids = ids * parts + part
            if ids.max() >= 1 << 32:
                raise ValueError("more than 2**32 different words")
            yield _row(_SHIP, -1, part, None, int(count.sum()), int((count > 0).sum()))
            at = 0
            for block, x in held:
                here = of[at : at + len(x[0])]
                at += len(x[0])
                yield _row(_SHIP, block, part, pack(count[here], ids[here]))

    return run


# ---- contexts -----------------------------------------------------------------------------------------------------


def _judged(n: np.ndarray, q: np.ndarray, of: np.ndarray, ones: np.ndarray, c: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, room if retained, room if not) of contexts from their entries (n, q, context) and the number of other words that occur
    once; c and b are the contexts' sums."""
    size = len(c)
    some = n >= 1
    n, q, of = n[some].astype(np.float64), q[some], of[some]
    cc, bb = c[of].astype(np.float64), b[of].astype(np.float64)
    less = bb - (n == 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = n * np.log((n - 1 + less * q) / (cc - 1 + less) / q)
        single = ones * np.log((b - 1) / (c + b - 1.0))
    enough = _occurs_twice(c, b)
    gain = np.bincount(of, np.where(enough[of], terms, 0.0), size) + np.where((ones > 0) & enough, single, 0.0)
    many = n >= 2
    kept = np.bincount(of, np.where(many, -n * np.log((n + bb * q) / (cc + bb)), 0.0), size)
    return gain, kept, np.bincount(of, np.where(many, -n * np.log(q), 0.0), size)


def _occurs_twice(c: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (c >= 2) | (b >= 2)


def _numbered(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the different numbers of x, all below n, in order; the place of each among them)."""
    has = np.zeros(n, bool)
    has[x] = True
    return np.flatnonzero(has), (np.cumsum(has) - 1)[x]


def _narrow(part: np.ndarray) -> np.ndarray:
    """Partition numbers in 16 bits where they fit: NumPy sorts those by counting."""
    return part.astype(np.uint16) if not len(part) or part.max() < 1 << 16 else part


def _hash(cols: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        h = ta.mix(h * np.uint64(0xD6E8FEB86659FD93) + c.astype(np.uint64) + np.uint64(1))
    return h


def _dense(cols: list[np.ndarray]) -> np.ndarray:
    """The rows' places among the distinct rows."""
    if len(cols) == 1:
        return np.unique(cols[0], return_inverse=True)[1]
    out = np.unique(cols[0].astype(np.uint64) << np.uint64(32) | cols[1].astype(np.uint64), return_inverse=True)[1]
    for c in cols[2:]:
        out = np.unique(out.astype(np.uint64) << np.uint64(32) | c.astype(np.uint64), return_inverse=True)[1]
    return out


def _judge(level: int, min_gain: float):
    """Sums the blocks' counts, judges the contexts and answers; the parts of contexts that are spread go out as rows -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _parts_of(batches):
            whole = [np.concatenate([x[i] for _, x in held]) for i in range(level + 7)]
            cols, (ones, runs, spread, word, count, log_q, _) = whole[:level], whole[level:]
            ctx = _dense(cols)
            size = int(ctx.max()) + 1
            first = np.empty(size, np.int64)
            first[ctx] = np.arange(len(ctx))
            of = np.repeat(ctx, runs)
            entry, of_entry = np.unique(of.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), return_inverse=True)
            n = np.bincount(of_entry, count.astype(np.float64), len(entry)).astype(np.int64)
            q = np.ones(len(entry))
            q[of_entry] = np.exp(-log_q / 1000.0)
            of_n = (entry >> np.uint64(32)).astype(np.int64)
            single = np.bincount(ctx, ones.astype(np.float64), size).astype(np.int64)
            c = np.bincount(of_n, n.astype(np.float64), size).astype(np.int64)
            b = np.bincount(of_n, n >= 1, size).astype(np.int64) + single
            gain, kept, loose = _judged(n, q, of_n, single, c, b)
            retained = (gain >= min_gain) & _occurs_twice(c, b)
            grows = np.where(retained, kept, loose if level == 1 else 0.0) >= min_gain
            flags = np.where(retained, _RETAINED, 0) | np.where(grows, _GROWS, 0)
            many = spread[first] > 0
            flags[many] = _SPREAD
            for i in np.flatnonzero(many).tolist():
                e = slice(*np.searchsorted(of_n, [i, i + 1]))
                yield _row(_SHIP, -2, part, pack(n[e], q[e], single[i : i + 1]), int(_hash([x[first[i] : first[i] + 1] for x in cols]).view(np.int64)[0]))
            tell = (flags & _RETAINED) > 0
            at = at_entry = 0
            for block, x in held:
                here, asked = ctx[at : at + len(x[0])], of_entry[at_entry : at_entry + len(x[level + 3])]
                at, at_entry = at + len(here), at_entry + len(asked)
                yield _row(_SHIP, block, part, pack(flags[here], np.where(tell, c, 0)[here], np.where(tell, b, 0)[here], n[asked]))

    return run


def _spread_contexts(rows: DataFrame, level: int, min_gain: float) -> dict[int, tuple[int, int, int]]:
    """{hash: (flags, c, b)} of the contexts that were spread; one for each half partition's share of all occurrences at most."""
    if rows.isEmpty():
        return {}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [unpack(x) for x in batch.column("payload").to_pylist()]
            c = [int(n.sum()) for n, _, _ in got]
            b = [int((n >= 1).sum() + one[0]) for n, _, one in got]
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(c, pa.int64()), pa.array(b, pa.int64())], ["a", "c", "b"])

    def agg(f, schema: str):
        names = schema.replace(" long", "").replace(" double", "").split(", ")
        return {r["a"]: tuple(r[x] for x in names[1:]) for r in rows.select("a", "payload").mapInArrow(f, schema).groupBy("a").agg(*(F.sum(x).alias(x) for x in names[1:])).collect()}

    total = agg(sums, "a long, c long, b long")

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in zip(batch.column("a").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                n, q, one = unpack(x)
                c, b = (np.array([v], np.int64) for v in total[a])
                got = _judged(n, q, np.zeros(len(n), np.int64), one, c, b)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), *(pa.array(v.astype(np.float64)) for v in got)], ["a", "gain", "kept", "loose"])

    out = {}
    for a, (gain, kept, loose) in agg(gains, "a long, gain double, kept double, loose double").items():
        retained = gain >= min_gain
        out[a] = ((_RETAINED if retained else 0) | (_GROWS if (kept if retained else loose if level == 1 else 0.0) >= min_gain else 0), *total[a])
    return out


class Block:
    """A block's tokens and, level by level, the places whose contexts are still looked at.

    Of a place: pos, ctx (its context among the block's), q (the probability so far), known (whether it counts as
    none here, having occurred less than twice before). Of a context: cols (its words' ids, the last word first) and most (occurrences it has at most).
    """

    def __init__(self, docs: int, names: np.ndarray, local: np.ndarray, n: np.ndarray, held: np.ndarray, count: np.ndarray, ids: np.ndarray):
        """Of ``docs`` documents those in ``names``; ids ascend."""
        self.docs, self.names, self.token, self.n, self.held, self.count, self.ids = docs, names, local, n, held, count, ids
        self.doc = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(local)) - np.repeat(np.cumsum(n) - n, n)
        self.train = np.repeat(held == 0, n)
        self.level = 1

    @classmethod
    def whole(cls, body: bytes, answers: list[tuple[int, list[np.ndarray]]]) -> Block:
        local, n, held = unpack(body)
        answers = sorted(answers, key=lambda x: x[0])
        count, ids = (np.concatenate([x[i] for _, x in answers]) for i in range(2))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        return cls(len(n), np.arange(len(n)), rank[local], n, held, count[order], ids[order])

    def start(self, total: int, distinct: int) -> None:
        self.p0 = (self.count + 1) / (total + distinct + 1)
        pos = np.flatnonzero(self.place >= 1)
        pos = pos[self.count[self.token[pos - 1]] >= 2]
        words, self.ctx = _numbered(self.token[pos - 1], len(self.ids))
        self.pos, self.q, self.cols, self.most = pos, self.p0[self.token[pos]], [self.ids[words]], self.count[words]
        self.known = self.count[self.token[pos]] < 2

    def _places(self, pos: np.ndarray) -> list[np.ndarray]:
        return [np.diff(pos, prepend=0), self.ctx, self.known.astype(np.uint8), self.q.astype(np.float32).view(np.uint32), self.most, *self.cols]

    def _placed(self, step: np.ndarray, ctx: np.ndarray, known: np.ndarray, q: np.ndarray, most: np.ndarray, *cols: np.ndarray) -> Block:
        self.pos, self.ctx, self.known, self.most, self.cols = np.cumsum(step), ctx, known > 0, most, list(cols)
        self.q, self.level = q.astype(np.uint32).view(np.float32).astype(np.float64), len(cols)
        return self

    def places(self) -> bytes:
        return pack(*self._places(self.pos))

    def state(self) -> bytes:
        """The places and the documents that have some."""
        names, _ = _numbered(self.doc[self.pos], len(self.n))
        has = np.zeros(len(self.n), bool)
        has[names] = True
        use = np.repeat(has, self.n)
        words, local = _numbered(self.token[use], len(self.ids))
        return pack(np.array([self.docs]), self.names[names], local, self.n[names], self.held[names], self.count[words], self.ids[words], *self._places((np.cumsum(use) - 1)[self.pos]))

    @classmethod
    def resumed(cls, blob: bytes) -> Block:
        docs, *parts = unpack(blob)
        return cls(int(docs[0]), *parts[:6])._placed(*parts[6:])

    def _entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries as context and token, their places' entries, places that ask) in order."""
        ask = np.flatnonzero(~self.known)
        key, of = np.unique(self.ctx[ask] * len(self.ids) + self.token[self.pos[ask]], return_inverse=True)
        return key, of, ask

    def _dealt(self, block: int, key: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entry's part, records as part and context, the record that tells each context's flags, how many parts)."""
        size = len(self.most)
        times = -(-self.most // share)
        base = (_hash(self.cols) % np.uint64(self.parts)).astype(np.int64)
        of = key // len(self.ids)
        part, home = base[of], base * size + np.arange(size)
        if (times > 1).any():
            home = ((base + block % times) % self.parts) * size + np.arange(size)
            many = np.flatnonzero(times[of] > 1)
            word = ta.mix(self.ids[key[many] % len(self.ids)].astype(np.uint64))
            part[many] = (part[many] + (word % times[of[many]].astype(np.uint64)).astype(np.int64)) % self.parts
            records = np.unique(np.concatenate([home, part[many] * size + of[many]]))
            return part, records, np.searchsorted(records, home), times
        order = np.argsort(_narrow(base), kind="stable")
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        return part, home[order], place, times

    def ship(self, block: int, parts: int, share: int) -> Iterator[pa.RecordBatch]:
        self.parts, size = parts, len(self.most)
        key, of, ask = self._entries()
        part, records, home, times = self._dealt(block, key, share)
        count = np.bincount(of, self.train[self.pos[ask]], len(key)).astype(np.int64)
        log_q = np.zeros(len(key), np.int64)
        log_q[of] = np.rint(-1000 * np.log(self.q[ask])).astype(np.int64)
        ones = np.zeros(len(records), np.int64)
        ones[home] = np.bincount(self.ctx, self.known & self.train[self.pos], size).astype(np.int64)
        ctx = records % size
        order = np.argsort(_narrow(part), kind="stable")
        of_key = key // len(self.ids)
        record = home[of_key]
        many = np.flatnonzero(times[of_key] > 1)
        record[many] = np.searchsorted(records, part[many] * size + of_key[many])
        runs = np.bincount(record, minlength=len(records))
        word = self.ids[key % len(self.ids)]
        cut, cut_entry = np.searchsorted(records // size, np.arange(self.parts + 1)), np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            r, e = slice(cut[p], cut[p + 1]), order[cut_entry[p] : cut_entry[p + 1]]
            c = ctx[r]
            yield _row(_SHIP, block, p, pack(*(x[c] for x in self.cols), ones[r], runs[r], (times[c] > 1).astype(np.uint8), word[e], count[e], log_q[e], np.zeros(0, np.int64)))

    def apply(self, block: int, parts: int, answers: list[tuple[int, list[np.ndarray]]], share: int, spread: dict[int, tuple[int, int, int]]) -> np.ndarray:
        """Takes the answers of this level in and goes to the next; log10 of the change of each document's probability."""
        self.parts = parts
        key, of, ask = self._entries()
        part, records, home, _ = self._dealt(block, key, share)
        answers = sorted(answers, key=lambda x: x[0])
        flags, c, b = (np.concatenate([x[i] for _, x in answers])[home].astype(np.int64) for i in range(3))
        hot = np.flatnonzero(flags & _SPREAD)
        for i, h in zip(hot.tolist(), _hash([x[hot] for x in self.cols]).view(np.int64).tolist(), strict=True):
            flags[i], c[i], b[i] = spread[h]
        n_entry = np.empty(len(key), np.int64)
        n_entry[np.argsort(_narrow(part), kind="stable")] = np.concatenate([x[3] for _, x in answers])
        n = np.zeros(len(self.pos), np.int64)
        n[ask] = n_entry[of]
        use = np.flatnonzero((flags[self.ctx] & _RETAINED) > 0)
        at = self.ctx[use]
        new = (n[use] + b[at] * self.q[use]) / (c[at] + b[at])
        more = np.bincount(self.names[self.doc[self.pos[use]]], np.log10(new / self.q[use]), self.docs)
        self.q[use] = new
        # the next level: a word more, where the context grows and may have occurred twice
        seen = np.full(len(self.token), -1, np.int64)
        seen[self.pos] = n
        go = np.flatnonzero(((flags & _GROWS) > 0)[self.ctx] & (self.place[self.pos] > self.level))
        pos = self.pos[go]
        before = seen[pos - 1]
        fine = (self.count[self.token[pos - self.level - 1]] >= 2) & ((before < 0) | (before >= 2))
        go, pos, before = go[fine], pos[fine], before[fine]
        longer, ctx = np.unique(self.ctx[go] * len(self.ids) + self.token[pos - self.level - 1], return_inverse=True)
        old = longer // len(self.ids)
        most = self.most[old]
        most[ctx] = np.where(before >= 0, before, most[ctx])
        self.cols = [*(x[old] for x in self.cols), self.ids[longer % len(self.ids)]]
        self.known = n[go] < 2
        self.pos, self.ctx, self.q, self.most, self.level = pos, ctx, self.q[go], most, self.level + 1
        return more


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(block, [(kind, part, payload)]) of rows sorted by block, kind and part."""
    block, held = None, []
    for batch in batches:
        for b, *x in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "part", "payload")), strict=True):
            if block is not None and b != block:
                yield block, held
                held = []
            block = b
            held.append(tuple(x))
    if held:
        yield block, held


def _walk(level: int, parts: int, total: int, distinct: int, share: int, spread: list[dict[int, tuple[int, int, int]]]):
    """Replays what the answers say and sends what is to be counted at ``level``; kinds of rows: -1 the block, 0 its words, k the
    answers of level k, _STATE_BEFORE the places before the answers of level - 1 (at level 4) or the state (later, instead of the
    block). Of documents it tells the change by level - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks_of(batches):
            own = {kind: payload for kind, _, payload in rows if kind in (_BLOCK, _STATE_BEFORE)}
            answers: dict[int, list[tuple[int, list[np.ndarray]]]] = {}
            for kind, part, payload in rows:
                if kind not in own:
                    answers.setdefault(kind, []).append((part, unpack(payload)))
            if level > 4:
                x = Block.resumed(own[_STATE_BEFORE])
            elif level == 4 and _STATE_BEFORE not in own:
                continue
            else:
                x = Block.whole(own[_BLOCK], answers[0])
                x._placed(*unpack(own[_STATE_BEFORE])) if level == 4 else x.start(total, distinct)
            if level == 1:
                known = np.bincount(x.doc, x.count[x.token] > 0, x.docs).astype(np.int64)
                base = np.bincount(x.doc, np.log10(x.p0)[x.token], x.docs)
                yield _row(_MORE, block, -1, pack(x.n, known, x.held, base))
            for k in range(x.level, level):
                if not len(x.pos):
                    break
                more = x.apply(block, parts, answers[k], share, spread[k])
                if k == level - 1:
                    yield _row(_MORE, block, k, pack(more))
            if len(x.pos):
                yield from x.ship(block, parts, share)
                if level >= 3:
                    yield _row(_STATE, block, 0, x.state() if level > 3 else x.places())

    return run


def _summed(id_type: pa.DataType, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: pa.Array, blobs: list[bytes]) -> pa.RecordBatch:
            n, known, held, base = unpack(blobs[0])
            score = base.copy()
            for x in blobs[1:]:
                score += unpack(x)[0]
            cols = [ids, pa.array(held > 0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        block, ids, blobs = None, None, []
        for batch in batches:
            for i, (b, payload) in enumerate(zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True)):
                if b != block:
                    if blobs:
                        yield out(ids, blobs)
                    block, ids, blobs = b, batch.column("ids")[i].values, []
                else:
                    blobs.append(payload)
        if blobs:
            yield out(ids, blobs)

    return run


def score(docs: DataFrame, min_gain: float = 6.0, block_tokens: int = BLOCK_TOKENS, parts: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = parts or tasks

    def exchanged(rows: DataFrame, f, name: str) -> DataFrame:
        dealt = rows.filter(F.col("kind") == _SHIP).select(*_NAMES).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "block")
        return written(dealt.mapInArrow(f, _ROW), name, "none", batch=16, sweep=True)

    sent = written(docs.select("doc_id", "text").mapInArrow(_blocks(block_tokens, parts, to_arrow_type(id_type)), f"{_ROW}, ids array<{id_type.simpleString()}>"), "blocks-and-words", "none", batch=2048)
    answers = [exchanged(sent, _count_words(parts), "word-counts")]
    blocks = written(sent.filter(F.col("kind") == _BLOCK).select("block", "kind", "part", "payload", "ids"), "token-blocks", "none")
    unwritten(sent)
    total, distinct = (x or 0 for x in answers[0].filter("block = -1").agg(F.sum("a"), F.sum("b")).first())
    share = max(1, total // (2 * parts))
    spread: list[dict[int, tuple[int, int, int]]] = [{}]
    own, count = blocks.select("block", "kind", "part", "payload"), blocks.count()
    told, made, level, state = [], [], 1, None
    while True:
        rows = own if level < 5 else None
        if state is not None:
            before = state.select("block", F.lit(_STATE_BEFORE).alias("kind"), "part", "payload")
            rows = before if rows is None else rows.union(before)
        for k, x in enumerate(answers):
            if level <= 3 or k == level - 1 or (level == 4 and k == 0):
                rows = rows.union(x.filter("block >= 0").select("block", F.lit(k).alias("kind"), "part", "payload"))
        met = rows.repartition(tasks, "block").sortWithinPartitions("block", "kind", "part")
        out = written(met.mapInArrow(_walk(level, parts, total, distinct, share, spread), _ROW), f"level-{level}", "none", batch=16, sweep=True)
        told.append(written(out.filter(F.col("kind") == _MORE), "changes", "none", batch=16, rows=count, each=64))
        if out.filter(F.col("kind") == _SHIP).isEmpty():
            break
        answers.append(exchanged(out, _judge(level, min_gain), f"answers-{level}"))
        spread.append(_spread_contexts(answers[-1].filter("block = -2"), level, min_gain))
        if state is not None:
            unwritten(made.pop(0))
        if level >= 3:
            state = out.filter(F.col("kind") == _STATE)
            made.append(out)
            unwritten(*answers[1:level])
        else:
            unwritten(out)
        level += 1
    changes = told[0]
    for x in told[1:]:
        changes = changes.union(x)
    texts = blocks.select("block", F.lit(-2).alias("part"), F.lit(None).cast("binary").alias("payload"), "ids")
    rows = texts.union(changes.select("block", "part", "payload", F.lit(None).cast(f"array<{id_type.simpleString()}>")))
    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    final = written(rows.repartition(tasks, "block").sortWithinPartitions("block", "part").mapInArrow(_summed(to_arrow_type(id_type), total), schema), "scores", batch=16)
    unwritten(blocks, out, *made, *answers, *told)
    return final


def op5_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
