"""Near duplicates by a parity-sketch join: all links of Jaccard similarity 0.8 or more over word shingles, exactly.

A document is its set of distinct shingle hashes. Two linked sets of n <= m elements differ in at most (n + m) / 9 <=
n / 4 elements. A size band [L, 2L) deals the elements by hash to K segments; the XOR and the count of a segment's elements
are the symbol of that segment. One element changes one symbol, so the number of symbols in which two sets differ - the
Hamming distance of these parity sketches - is at most their symmetric difference. By the pigeonhole principle a set
with more than n / 4 segments of two or more elements shares such a segment with every set linked to it, and those
segments are what is joined. A set with too few of them also emits its segments of one element, then its single elements,
so the candidates are complete for every set. K is chosen so that this hardly happens. A set of a size below 1.25 L also
emits the segments of the band below, where partners of smaller bands look for it.

Candidates of a shared segment are not paired with each other. Equal sets are one node from the start; a segment's nodes
are paired with its least node, and the pairs that sizes and a one-bit parity sketch (Hamming distance of 4n to 8n bits against the
allowed difference) permit are kept. Each node's most frequent partner is verified first, which gives components. Segments that
then hold several components get another centre: first the node whose segments are the most common (in a group of copies, what is
nearest to all), then drawn ones. In what is still open, a node looks for partners in larger components: as it differs from them in at most d
segments, d + 1 of its segments hold one it shares with each, and it takes those with the fewest nodes. There it is
compared by sketches, in blocks of bounded size, and only its nearest partners are verified; components are joined and the
number of partners grows until no node has more. So every linked pair is either verified or lies in one component,
and no link between different texts is lost, while the pairs that are written down stay in proportion to the open nodes.

A segment with very many nodes doesn't meet in one task: keys that are common in a sample of the texts (one of ``SAMPLE``; it
decides where rows go, not which) have their centre known in advance, so their rows need no shuffle.

Candidates come from 64-bit hashes; pairs are verified by the shingles themselves.

Defined cases: null, empty or blank texts have no shingles and are linked with nothing; a text of fewer than five words is
one shingle; equal rows are linked if they have words; rows that share a doc_id are linked by their texts each and get one row
each; a null doc_id is linked but never a component_id unless nothing else is in the component; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.components import connected_components
from lattica.llm import textarrays as ta
from lattica.llm.common import NO_ID, bloom_has, build_bloom, checked_broadcast, fresh, keyed, shared_dir, unwritten, written

_U = np.uint64
#: Nodes of a block when a shared segment's components are compared.
BLOCK = 4096
#: Rounds of stars around other centres before components are compared.
ROUNDS = 3
#: One of so many texts is looked at to find the keys of very many nodes, and so many nodes of them make a key common at least.
SAMPLE, COMMON = 32, 32
#: Rows that a Python worker gets at once: of texts, of sketches, of pairs of texts.
TEXTS, SKETCHES, PAIRS = 2048, 2048, 512


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    data, offsets = ta.buffers(column)
    for a, b, raw, off in ta.chunks(data, offsets):
        words, first = ta.word_hashes(raw, off)
        sh, at = ta.shingles(words, first, size)
        for i in range(b - a):
            yield a + i, np.unique(sh[at[i] : at[i + 1]])


def _node(h: np.ndarray) -> int:
    """A 64-bit name of a set."""
    sums = np.array([np.add.reduce(h, dtype=_U), np.add.reduce(ta.mix(h ^ _U(0x5851F42D4C957F2D)), dtype=_U)])
    both = ta.mix(sums ^ np.array([len(h), 0], _U))
    return int(ta.mix(both[:1] + (both[1:] << _U(1))).view(np.int64)[0])


def _bits(h: np.ndarray) -> bytes:
    """The one-bit parity sketch: a power of two of 4n to 8n bits, 64 at least."""
    m = max(64, 1 << (4 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h >> _U(7)).astype(np.int64) & (m - 1), minlength=m) & 1).astype(np.uint8)).tobytes()


def _segment_count(low: int) -> int:
    return int(0.4 * 2 * low) + 2


def segment_keys(h: np.ndarray) -> np.ndarray:
    """Keys of the segments that a set emits; linked sets share at least one."""
    return segments(h)[0]


def segments(h: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(keys, spare): linked sets share a key, even if ``spare[p]`` of the set's keys of parity p are left out.

    A key's lowest bit is the parity of its band's number: of the two bands of a set one has each.
    """
    n = len(h)
    spare = [0, 0]
    if n == 0:
        return np.zeros(0, _U), spare
    low, out, allowed = 1 << (n.bit_length() - 1), [], n // 4
    for band in [low, *([low // 2] if n < 1.25 * low and low > 1 else [])]:
        k, parity = _segment_count(band), (band.bit_length() - 1) & 1
        seg = ((h >> _U(32)) * _U(k)) >> _U(32)  # h is sorted, so equal segments are neighbours
        start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        count = np.diff(np.append(start, n))
        xor = np.bitwise_xor.reduceat(ta.mix(h ^ _U(0xA24BAED4963EE407)), start)
        key = ta.mix(xor + (seg[start] * _U(0x9E3779B97F4A7C15)) ^ (_U(band) << _U(1)) ^ (count.astype(_U) << _U(50)))
        pairs = int((count >= 2).sum())
        if pairs > allowed:
            keys, spare[parity] = [key[count >= 2]], pairs - allowed - 1
        else:
            keys = [key]
            if len(start) <= allowed:
                keys.append(ta.mix(h ^ _U(band * 2 + 1)))
        out += [(x & ~_U(1)) | _U(parity) for x in keys]
    return np.concatenate(out), spare


def _sampled(size: int):
    """(key, node) of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h in _sets(batch.column("text"), size):
                keys = segment_keys(h)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), _node(h), np.int64))], ["key", "node"])

    return run


def _emit(size: int, id_type: pa.DataType, common: np.ndarray, centres: np.ndarray):
    """A row with info for every document, and a row (key, node) for each segment of its set; with the centre for common keys.

    Equal keys mark what has to meet; a document's row and one of a common key get any, so that they spread.
    """
    info_type = _info_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, None] = {}  # equal sets of a task emit once; forgetting some only costs rows
        count = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = ta.buffers(batch.column("text"))
            for a, b, raw, off in ta.chunks(data, offsets):
                words, first = ta.word_hashes(raw, off)
                sh, at = ta.shingles(words, first, size)
                keys, nodes, n, node_of, bits, spare = [], [], [], [], [], []
                for i in range(b - a):
                    h = np.unique(sh[at[i] : at[i + 1]])
                    node = _node(h) if len(h) else None
                    n.append(len(h))
                    node_of.append(node)
                    bits.append(_bits(h) if len(h) else None)
                    emitted, left = segments(h)
                    spare.append(left)
                    if len(h) and node not in recent:
                        if len(recent) > 100_000:
                            recent.clear()
                        recent[node] = None
                        keys.append(emitted.view(np.int64))
                        nodes.append(np.full(len(keys[-1]), node, np.int64))
                given = [batch.column(c).slice(a, b - a) for c in ("doc_id", "t")]
                info = pa.StructArray.from_arrays([*given, pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array([x for x, _ in spare], pa.int32()), pa.array([x for _, x in spare], pa.int32())], fields=list(info_type))
                yield pa.RecordBatch.from_arrays([pa.array(_spread(count, b - a)), pa.array(node_of, pa.int64()), pa.nulls(b - a, pa.int64()), info], ["key", "node", "centre", "info"])
                count += b - a
                if not keys:
                    continue
                k, node = np.concatenate(keys), np.concatenate(nodes)
                if len(common):
                    place = np.minimum(np.searchsorted(common, k), len(common) - 1)
                    hot = common[place] == k
                    if hot.any():
                        key, who, centre = k[hot], node[hot], centres[place[hot]]
                        yield _rows(key, who, centre, info_type)
                        k, node = k[~hot], node[~hot]
                yield _rows(k, node, None, info_type)

    return run


def _spread(first: int, n: int) -> np.ndarray:
    return ta.mix(np.arange(first, first + n).astype(_U)).view(np.int64)


def _info_type(id_type: pa.DataType) -> pa.DataType:
    return pa.struct([("doc_id", id_type), ("t", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("even", pa.int32()), ("odd", pa.int32())])


def _rows(key: np.ndarray, node: np.ndarray, centre: np.ndarray | None, info_type: pa.DataType) -> pa.RecordBatch:
    centre = pa.nulls(len(key), pa.int64()) if centre is None else pa.array(centre)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), centre, pa.nulls(len(key), info_type)], ["key", "node", "centre", "info"])


def _shared(id_type: pa.DataType):
    """Rows sorted by (key, node): those of documents and of common keys as they are, and of each other key that
    several nodes have all but the least node as (key, node, centre)."""
    info_type = _info_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_node, lead_node = None, None, 0
        for batch in batches:
            done = pc.or_(pc.is_valid(batch.column("info")), pc.is_valid(batch.column("centre")))
            if pc.any(done).as_py():
                rows = batch.filter(done)
                keep = pc.or_(pc.is_valid(rows.column("info")), pc.fill_null(pc.not_equal(rows.column("node"), rows.column("centre")), False))
                yield rows.filter(keep)
                batch = batch.filter(pc.invert(done))
            key, node = batch.column("key").to_numpy(zero_copy_only=False), batch.column("node").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last_key is None or key[0] != last_key
            same = np.zeros(len(key), bool)
            same[1:] = ~new[1:] & (node[1:] == node[:-1])
            same[0] = not new[0] and node[0] == last_node
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            centres = np.where(lead >= 0, node[np.maximum(lead, 0)], lead_node)
            take = ~new & ~same & (node != centres)
            last_key, last_node, lead_node = key[-1], node[-1], centres[-1]
            if take.any():
                yield _rows(key[take], node[take], centres[take], info_type)

    return run


def _wanted(bloom: np.ndarray):
    """The texts whose hash the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom_has(bloom, batch.column("t").to_numpy(zero_copy_only=False))))

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that sizes and one-bit sketches allow."""
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
        ok = (5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b))
        x, y = batch.column("bits_a"), batch.column("bits_b")
        for i in np.flatnonzero(ok):
            ok[i] = 9 * _distance(np.frombuffer(x[i].as_buffer(), np.uint8), np.frombuffer(y[i].as_buffer(), np.uint8)) <= n_a[i] + n_b[i]
        yield batch.filter(pa.array(ok)).select(["a", "b", "votes"])


def _distance(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two one-bit sketches, the longer one folded to the other's length."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _verify(size: int):
    """The pairs whose texts' shingles are similar enough. Hashes are compared first; a pair that they allow, by its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, list[bytes]] = {}
        for batch in batches:
            ok = []
            for (_, a), (_, b), x, y in zip(_sets(batch.column("text_a"), size), _sets(batch.column("text_b"), size), batch.column("text_a"), batch.column("text_b"), strict=True):
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good = 100 * common >= 80 * (len(both) - common)
                if good:
                    p, q = (shingle_set(_words(t.as_py(), words), size) for t in (x, y))
                    common = len(p & q)
                    good = 100 * common >= 80 * (len(p) + len(q) - common)
                ok.append(good)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _words(text: str, held: dict[str, list[bytes]]) -> list[bytes]:
    """The words of a text; the last ones of a task are remembered, since a centre comes again and again."""
    out = held.get(text)
    if out is None:
        if len(held) >= 8:
            held.clear()
        out = held[text] = text.encode().lower().split()  # of bytes, so A-Z and the six ASCII blanks only
    return out


def shingle_set(words: list[bytes], size: int) -> set[bytes]:
    """The distinct runs of ``size`` words; of fewer words the whole sequence."""
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def _near(limit: int):
    """Rows sorted by (key, block) -> (a, b, cut): the nearest nodes of larger components that sizes and sketches allow for
    each node that asks, ``limit`` at most; cut if there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None
        recent: set[tuple[int, int, bool]] = set()  # pairs come again in other segments; forgetting some only costs rows

        def out(rows: pa.RecordBatch, start: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b, cut = _pairs(rows, start, limit)
            if len(recent) > 200_000:
                recent.clear()
            new = [i for i, x in enumerate(zip(a.tolist(), b.tolist(), cut.tolist(), strict=True)) if x not in recent and not recent.add(x)]
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(cut[new])], ["a", "b", "cut"])

        for batch in batches:
            if carry is not None and carry.num_rows:
                batch = pa.concat_batches([carry, batch])
            if not batch.num_rows:
                continue
            k, x = (batch.column(c).to_numpy() for c in ("key", "block"))
            start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])]))
            carry = batch.slice(start[-1])
            if len(start) > 1:
                yield from out(batch.slice(0, start[-1]), start[:-1])
        if carry is not None and carry.num_rows:
            yield from out(carry, np.zeros(1, np.int64))

    return run


def _pairs(rows: pa.RecordBatch, start: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, comp, size, node = (rows.column(c).to_numpy() for c in ("n", "component", "size", "node"))
    asks, found_here = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "there"))
    bits = rows.column("bits")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for s, e in zip(start.tolist(), [*start[1:].tolist(), rows.num_rows], strict=True):
        if asks[s:e].any():
            rank = np.unique(np.stack([size[s:e], comp[s:e]]), axis=1, return_inverse=True)[1].ravel()
            a, b, cut = nearest(n[s:e], rank, asks[s:e], found_here[s:e], [x.as_py() for x in bits.slice(s, e - s)], limit)
            found.append((a + s, b + s, cut))
    a, b, cut = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), cut


def nearest(n: np.ndarray, rank: np.ndarray, asks: np.ndarray, there: np.ndarray, bits: list[bytes], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asking rows, partners, cut): the partners are among the rows ``there`` and of higher rank."""
    length = np.array([len(x) for x in bits])
    classes = {}
    for size in np.unique(length[there]).tolist():
        rows = np.flatnonzero((length == size) & there)
        rows = rows[np.argsort(n[rows], kind="stable")]
        whole = np.frombuffer(b"".join(bits[i] for i in rows), np.uint8).reshape(len(rows), size)
        classes[size] = rows, whole, whole[:, : size // 2] ^ whole[:, size // 2 :]
    a, b, cut = [], [], []
    for i in np.flatnonzero(asks).tolist():
        sketch, partners, distances = np.frombuffer(bits[i], np.uint8), [], []
        for size in (length[i] // 2, length[i], length[i] * 2):
            if size not in classes:
                continue
            rows, whole, half = classes[size]
            near = np.arange(np.searchsorted(5 * n[rows], 4 * n[i]), np.searchsorted(4 * n[rows], 5 * n[i], "right"))
            near = near[rank[rows[near]] > rank[i]]
            if len(near):
                x = sketch if size >= length[i] else sketch[:size] ^ sketch[size:]
                differ = np.bitwise_count((half if size > length[i] else whole)[near] ^ x).sum(axis=1, dtype=np.int64)
                good = 9 * differ <= n[rows[near]] + n[i]
                partners.append(rows[near[good]])
                distances.append(differ[good])
        if partners:
            who, far = np.concatenate(partners), np.concatenate(distances)
            take = who[np.argsort(far, kind="stable")[:limit]]
            a.append(np.full(len(take), i))
            b.append(take)
            cut.append(np.full(len(take), len(who) > limit))
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(a), np.concatenate(b), np.concatenate(cut)


def _common_keys(texts: DataFrame, size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, a node of each) that a quarter of a task's rows or more would have, as a sample shows; 4 * ``parts`` keys at most."""
    seen = texts.filter(F.pmod("t", F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled(size), "key long, node long")
    counts = written(seen.groupBy("key", "node").count().groupBy("key").agg(F.count("*").alias("nodes"), F.sum("count").alias("rows"), F.min("node").alias("centre")).filter(F.col("nodes") > 1), "sampled-keys", batch=TEXTS)
    least = max(COMMON, (counts.agg(F.sum("nodes")).first()[0] or 0) // (4 * parts))
    got = counts.filter(F.col("nodes") >= least).select("key", "centre").toArrow()
    unwritten(counts)
    order = np.argsort(got["key"].to_numpy())
    return got["key"].to_numpy()[order], got["centre"].to_numpy()[order]


def links(docs: DataFrame, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows with doc_id, t, n and node; (id, component) of all nodes that are linked with others)."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    info = f"info struct<doc_id:{id_type.simpleString()},t:bigint,n:bigint,bits:binary,even:int,odd:int>"
    common, centres = _common_keys(texts, size, parts)
    emitted = texts.mapInArrow(_emit(size, arrow_id, common, centres), f"key long, node long, centre long, {info}")
    emitted = emitted.repartition(parts, "key").sortWithinPartitions("key", "node")
    table = written(emitted.mapInArrow(_shared(arrow_id), f"key long, node long, centre long, {info}"), "shared-segments", batch=TEXTS, sweep=True)
    described = table.filter("info is not null").select("node", "info.*")
    nodes = described.filter("node is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "bits", "t", "even", "odd")))
    shared = table.filter("info is null").select("key", "node", "centre")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts are similar enough. Only texts that are needed are moved."""
        n = pairs.count()
        if not n:
            return pairs.select("a", "b")
        need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        need = written(nodes.select("node", "t").join(need, "node"), "nodes-to-verify", rows=2 * n)
        bloom = build_bloom(need, "t", need.count())
        found = texts.select("t", "text").mapInArrow(_wanted(bloom), "t long, text string").groupBy("t").agg(F.first("text").alias("text"))
        found = written(found.join(need, "t").select("node", "text"), "texts-to-verify", batch=TEXTS, rows=2 * n, each=2000)
        side = lambda c: found.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("b")
        out = written(joined.mapInArrow(_verify(size), "a long, b long"), "links", batch=PAIRS, rows=n, each=1000)
        unwritten(need, found)
        return out

    def sketched(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, votes) that sizes and sketches allow."""
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_sketched, "a long, b long, votes long")

    def named(df: DataFrame, c: str, to: str, comp: DataFrame) -> DataFrame:
        return df.join(comp.select(F.col("id").alias(c), F.col("component").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))

    def joined_up(comp: DataFrame, links: DataFrame) -> DataFrame:
        """The components after more links: only the components that the links name are looked at."""
        n = links.count()
        between = written(named(named(links, "a", "ca", comp), "b", "cb", comp).select("ca", "cb").distinct(), "links", rows=n)
        merged = written(connected_components(between, "ca", "cb", folder, rows=n), "merged", rows=2 * n)
        known = comp.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        out = written(known.union(merged.join(comp, "id", "left_anti").select("id", "component")), "components", rows=comp.count() + 2 * n)
        unwritten(between, merged, comp)
        return out

    def still_open(rows: DataFrame, comp: DataFrame) -> DataFrame:
        """(key, node, component, rows) of the segments of more than two nodes that hold several components."""
        of = named(rows.select("key", "node"), "node", "component", comp)
        mixed = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).filter("rows > 2 and lo <> hi").drop("lo", "hi")
        out = written(of.join(mixed, "key"), "open-segments", sweep=True)
        unwritten(rows)
        return out

    def around(members: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) across components with a centre of each segment: the node of the commonest segments, or a drawn one."""
        if turn == 0:
            weight = members.groupBy("node").agg(F.sum("rows").alias("weight"))
            members, chosen = members.join(weight, "node"), F.max_by(F.struct("node", "component"), F.struct("weight", "node"))
        else:
            chosen = F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn)))
        rows = members.join(members.groupBy("key").agg(chosen.alias("centre")), "key").filter("component <> centre.component")
        return rows.select(F.greatest("node", "centre.node").alias("a"), F.least("node", "centre.node").alias("b"))

    def looked_for(members: DataFrame, comp: DataFrame, limit: int) -> DataFrame:
        """(a, b, cut) of the nodes in segments still open and their nearest nodes in larger components."""
        sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
        sized = members.join(sizes, "component", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
        top = sized.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"))
        spare = nodes.select("node", F.array("even", "odd").alias("spare"))
        ranked = sized.join(top, "key").join(spare, "node").withColumn("place", F.row_number().over(Window.partitionBy("node", F.col("key").bitwiseAND(1)).orderBy(F.desc("rows"), "key")))
        asks = (F.struct("size", "component") < F.col("top")) & (F.col("place") > F.element_at("spare", (F.col("key").bitwiseAND(1) + 1).cast("int")))
        asked = written(ranked.select("key", "node", "component", "size", "rows", asks.alias("asks")), "asking-nodes")
        used = asked.join(asked.filter("asks").select("key").distinct(), "key", "left_semi")
        blocks = F.ceil(F.col("rows") / BLOCK).cast("long")
        dealt = used.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("block", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array("own"))))
        dressed = dealt.withColumn("there", F.col("block") == F.col("own")).join(nodes.select("node", "n", "bits"), "node").select("key", "node", "component", "size", "asks", "there", "block", "n", "bits")
        return dressed.repartition(parts, "key", "block").sortWithinPartitions("key", "block").mapInArrow(_near(limit), "a long, b long, cut boolean")

    # each node with the centres it shares segments with; the most frequent one first
    votes = shared.groupBy(F.col("node").alias("a"), F.col("centre").alias("b")).agg(F.count("*").alias("votes"))
    stars = written(sketched(votes), "star-pairs", batch=SKETCHES, sweep=True)
    tested = [written(stars.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("best")).select("a", F.col("best.b").alias("b")), "pairs")]
    found = verified(tested[0])
    n = found.count()
    comp = written(connected_components(found, "a", "b", folder, rows=n), "components", rows=2 * n)

    def fresh_pairs(pairs: DataFrame) -> DataFrame:
        for x in tested:
            pairs = pairs.join(x, ["a", "b"], "left_anti")
        return pairs

    # a few more rounds of stars around other centres: groups of copies close, a pair a row at most
    members = shared.select("key", "node").union(shared.select("key", F.col("centre").alias("node")).distinct())
    members = still_open(members.distinct() if len(common) else members, comp)
    for turn in range(ROUNDS):
        again = fresh_pairs(around(members, turn).groupBy("a", "b").agg(F.count("*").alias("votes")))
        pairs = written(sketched(again).select("a", "b"), "pairs", batch=SKETCHES)
        tested.append(pairs)
        linked = verified(pairs)
        if linked.isEmpty():
            break
        comp = joined_up(comp, linked)
        members = still_open(members, comp)

    # what is left: the other stars across components, and the nearest nodes of other components in segments still open
    rest = named(named(stars.select("a", "b"), "a", "ca", comp), "b", "cb", comp).filter("ca <> cb").select("a", "b")
    limit = 2
    while True:
        met = written(looked_for(members, comp, limit), "near-pairs", batch=SKETCHES)
        more = not met.filter("cut").isEmpty()
        pairs = met.select("a", "b")
        pairs = written(fresh_pairs((pairs if rest is None else pairs.union(rest)).distinct()), "pairs")
        linked = verified(pairs)
        grown = not linked.isEmpty()
        comp = joined_up(comp, linked) if grown else comp
        unwritten(met)
        if not more:
            break
        tested, rest, limit = [*tested, pairs], None, limit * 16
        members = still_open(members, comp) if grown else members
    unwritten(stars, members, found, *tested)
    return described, comp


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, first_id, first_t) of every row: t is the text's hash, the component the least doc_id that
    links lead to, the row's own included; first is the row of the component that has the least (doc_id, t), nulls last."""
    described, comp = links(docs, size)
    comp = comp.select(F.col("id").alias("node"), "component")
    rows = written(described.select("doc_id", "t", "n", "node").join(comp, "node", "left").select("doc_id", "t", "n", F.coalesce("component", "node").alias("c")), "documents-by-component")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    least = rows.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"), F.min(order).alias("first"), F.count("*").alias("members")).filter("members > 1")
    out = rows.join(checked_broadcast(least), "c", "left")
    first = lambda c: F.when(F.col("first").isNull(), F.col(c)).otherwise(F.col(f"first.{c}"))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), first("doc_id").alias("first_id"), first("t").alias("first_t"))


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` with one row of each component: the one of the least (doc_id, hash of the text), a null doc_id last. Of rows that
    have both in common and words, one stays; rows without words all stay."""
    found = near_duplicates(docs, size)
    d, t = fresh(docs.columns, "d", "t")
    name = lambda i, x: (F.coalesce(F.col(i).cast("long"), F.lit(NO_ID)).alias(d), F.col(x).alias(t))
    later = found.filter("not (doc_id <=> first_id and t = first_t)").select(*name("doc_id", "t")).distinct()
    again = found.filter("doc_id <=> first_id and t = first_t and n_shingles > 0").groupBy(*name("doc_id", "t")).count().filter("count > 1").select(d, t)
    rows, _, _ = keyed(docs, d, t)
    rest = rows.join(checked_broadcast(written(later.union(again), "later-copies")), [d, t], "left_anti").select(*docs.columns)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = rows.join(checked_broadcast(written(again, "repeated-rows")), [d, t], "left_semi").groupBy(d, t).agg(F.min_by(whole, F.xxhash64(whole)).alias("row"))
    return rest.union(one.select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def op7_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("t", "first_id", "first_t")
