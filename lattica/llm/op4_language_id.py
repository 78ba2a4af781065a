"""Language ID by Bayesian evidence fusion: text, declared language, address suffix and host priors.

    log P(l | all) = log P(text | l) + log P(declared | l) + log P(suffix | l) + log P(l | host) + constant

* Text: a naive Bayes model of hashed byte trigrams, trained on all labelled rows by grouped aggregation. Every label is a language,
  however few rows it has; the model has a row of BUCKETS floats a label (128 KB), so its size follows the number of labels, which
  for language codes is bounded, and not the corpus. Trigrams of a text depend on each other, so its log likelihood is tempered.
* Declared language (a markup attribute, or a column) and address suffix: P(value | l) estimated from the corpus, each value's
  soft counts by text alone, smoothed toward the value's overall share; a missing value is no evidence.
* Host: a prior smoothed over the hierarchy corpus - registered domain - host; each level's soft counts are shrunk toward the
  level above by ``kappa`` documents, and a row's own count is taken out.

The counts are sums with map-side combining, so a hot host is one row a task; the tables that go back to the rows are broadcast
after their rows were counted and shuffled otherwise. A row is rejected (language "und") if its text has no letters or no
language reaches ``least`` of the posterior.

Defined cases: null or blank texts are "und" with confidence 0; null declared values, suffixes and hosts are no evidence (a null
host has the corpus's prior); equal rows get equal results; ties go to the language first in the alphabet; an empty table gives
an empty result, and with no labelled rows everything is "und"; other columns, whatever their names, are carried along by
``identify`` (a result named as one of them gets a ``_``).
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textarrays as ta
from lattica.llm.common import BROADCAST_ROWS, checked_broadcast, sheltered, trimmed, written

BUCKETS = 1 << 15
#: Languages whose likelihoods are summed at once.
AT_ONCE = 8
#: Bytes of text whose trigrams are held at once, also of a longer text; the arrays over them take some 150 bytes for each with four languages.
RUN_BYTES = 1 << 17
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # what isn't a letter is a space


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs; a part of a longer row ends with the two bytes that its last trigrams reach into."""
    for a, b, raw, off in ta.chunks(data, offsets, RUN_BYTES):
        for at in range(0, max(1, len(raw)), RUN_BYTES):
            part = raw[at : at + RUN_BYTES + 2]
            yield a, b, part, np.minimum(off, len(part))


def _trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets of the trigrams, first trigram of each row, whether rows have letters) of runs of RUN_BYTES at
    most: of rows, or of a part of a longer row, whose parts come one after another. Runs of spaces are left out."""
    for a, b, raw, off in _runs(*ta.buffers(column)):
        x = _FOLD[raw].astype(np.uint32)
        lettered = np.diff(np.concatenate([[0], np.cumsum(x != 32)])[off]) > 0
        if len(x) < 3:
            yield a, b, np.zeros(0, np.int64), np.zeros(b - a + 1, np.int64), lettered
            continue
        h = (x[:-2] * np.uint32(65599) + x[1:-1]) * np.uint32(65599) + x[2:]
        h = ((h * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
        use = (x[1:-1] != 32) | ((x[:-2] != 32) & (x[2:] != 32))
        for edge in (off[1:-1] - 1, off[1:-1] - 2):  # those that reach into the next row
            use[edge[(edge >= 0) & (edge < len(use))]] = False
        at = np.concatenate([[0], np.cumsum(use)])
        yield a, b, h[use], at[np.minimum(off, len(use))], lettered


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b, h, at, _ in _trigrams(batch.column("text")):
            of = np.repeat(np.arange(b - a), np.diff(at))
            names = sorted(set(langs[a:b]))
            code = np.array([names.index(x) for x in langs[a:b]])
            counts = np.bincount(code[of] * BUCKETS + h, minlength=len(names) * BUCKETS) if len(h) else np.zeros(len(names) * BUCKETS, np.int64)
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + counts[k * BUCKETS : (k + 1) * BUCKETS]
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["lang", "bucket", "n"])


class TextModel:
    """log P(trigram | language) of hashed trigrams."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.table = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32)


def train(docs: DataFrame) -> TextModel:
    """The model of the labelled rows (text, lang) of ``docs``."""
    labelled = docs.filter("lang is not null and text is not null").select("text", F.lower("lang").alias("lang"))
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())  # as many as there are labels
    if not languages:
        return TextModel([], np.zeros((0, BUCKETS)))
    counted = labelled.mapInArrow(trimmed(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    at = {x: i for i, x in enumerate(languages)}
    counts[counted["lang"].map(at).to_numpy(int), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return TextModel(languages, counts)


def _likelihoods(model: TextModel, temper: float):
    """Replaces text by ll and _p: tempered log likelihoods, null without letters, and the posterior by text alone, then 0."""
    n_langs = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll, known = np.zeros((batch.num_rows, n_langs)), np.zeros(batch.num_rows, bool)
            for a, b, h, at, lettered in _trigrams(batch.column("text")):
                known[a:b] |= lettered
                for k in range(0, n_langs, AT_ONCE):
                    sums = np.zeros((len(h) + 1, min(AT_ONCE, n_langs - k)))
                    np.cumsum(model.table[h, k : k + AT_ONCE], axis=0, out=sums[1:], dtype=np.float64)
                    ll[a:b, k : k + AT_ONCE] += temper * (sums[at[1:]] - sums[at[:-1]])
            ll -= ll.max(axis=1, keepdims=True) if ll.size else 0
            p = np.exp(ll)
            p /= p.sum(axis=1, keepdims=True)
            p[~known] = 0.0
            out = [x.tolist() if n else None for x, n in zip(ll, known, strict=True)]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.float64())), pa.array(p.tolist(), pa.list_(pa.float64()))], [*names, "ll", "_p"])

    return run


def _total(xs: str) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def identify(rows: DataFrame, model: TextModel, declared: Column, suffix: Column, domain: Column, host: Column, temper: float = 0.1, kappa: float = 20.0, alpha: float = 2.0, least: float = 0.5) -> DataFrame:
    """``rows`` (with text) without the text, with language, confidence and text_language."""
    langs, n = model.languages, len(model.languages)
    if not n:
        inner, restored = sheltered(rows, "text")
        return restored(inner.drop("text").withColumns({"language": F.lit("und"), "confidence": F.lit(0.0), "text_language": F.lit("und")}), "language", "confidence", "text_language")
    said = {"_declared": declared, "_suffix": suffix, "_domain": domain, "_host": host}
    evidence, restored = sheltered(rows, "text", more={k: v.cast("string") for k, v in said.items()})
    kept = [c for c in evidence.columns if c != "text" and c not in said]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in evidence.schema if f.name != "text"), "ll array<double>", "_p array<double>"])
    scored = evidence.mapInArrow(trimmed(_likelihoods(model, temper)), schema)
    scored = written(scored, "text-evidence")
    each = lambda f, c, to: F.array(*(f(F.element_at(c, i + 1)) for i in range(n))).alias(to)
    sums = lambda keys: scored.filter("ll is not null").groupBy(*keys).agg(each(F.sum, "_p", "_s"))
    rows_at_most = BROADCAST_ROWS * 4 // max(n, 4)  # a row has one or two doubles a language
    hosts = written(sums(["_domain", "_host"]), "host-sums")
    total = [t or 0.0 for t in hosts.agg(each(F.sum, "_s", "t")).first()["t"]]
    share = [(t + 1.0) / (sum(total) + n) for t in total]
    numbers = lambda xs: F.array(*(F.lit(float(x)) for x in xs))

    # a row's prior from its host: sums of the host and of its domain, without the row itself
    domains = hosts.groupBy("_domain").agg(each(F.sum, "_s", "_d"))
    sites = hosts.join(domains.withColumnRenamed("_domain", "_dd"), F.expr("_domain <=> _dd")).drop("_dd")
    sites = sites.filter("_host is not null").drop("_domain")
    sites = written(sites.groupBy("_host").agg(each(F.sum, "_s", "_s"), each(F.max, "_d", "_d")), "sites")
    out = scored.join(checked_broadcast(sites, rows_at_most), "_host", "left")
    out = out.withColumns({"_own": _total("_p"), "_of_s": _total("_s"), "_of_d": _total("_d")})

    def prior(q: Column, i: Column) -> Column:
        at = lambda c: F.element_at(c, i + 1)
        from_domain = (at("_d") - at("_p") + kappa * q) / (F.col("_of_d") - F.col("_own") + kappa)
        from_host = (at("_s") - at("_p") + kappa * from_domain) / (F.col("_of_s") - F.col("_own") + kappa)
        return F.coalesce(F.log(F.greatest(from_host, F.lit(1e-6))), F.log(q))

    out = out.select(*(f"`{c}`" for c in kept), "_declared", "_suffix", "ll", F.transform(numbers(share), prior).alias("_l"))

    # what a declared value and a suffix say
    for value in ("_declared", "_suffix"):
        table = sums([value]).filter(F.col(value).isNotNull()).withColumn("_of_s", _total("_s"))
        said = F.zip_with("_s", numbers(total), lambda s, t: F.log((s + alpha * F.col("_of_s") / F.lit(float(sum(total) + 1))) / (t + alpha)))
        table = written(table.select(value, said.alias("_e")), f"evidence{value}")
        out = out.join(checked_broadcast(table, rows_at_most), value, "left").withColumn("_l", F.when(F.col("_e").isNull(), F.col("_l")).otherwise(F.zip_with("_l", "_e", lambda a, b: a + b))).drop("_e")

    final = F.zip_with("_l", "ll", lambda a, b: a + b)
    out = out.withColumn("_final", final).withColumn("_best", F.array_max("_final"))
    confidence = 1 / F.aggregate("_final", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_best")))
    names = F.array(*(F.lit(x) for x in langs))
    at = lambda scores: F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
    known = F.col("ll").isNotNull()
    out = out.withColumn("confidence", F.when(known, confidence).otherwise(0.0))
    language = F.when(known & (F.col("confidence") >= least), at(F.col("_final"))).otherwise("und")
    out = out.select(*(f"`{c}`" for c in kept), language.alias("language"), "confidence", F.when(known, at(F.col("ll"))).otherwise("und").alias("text_language"))
    return restored(out, "language", "confidence", "text_language")


#: Labels below a country's under which domains are registered.
_GENERAL = {"ac", "co", "com", "edu", "gov", "net", "org"}
_OPENING = re.compile(r"<(script|style|nav|noscript)\b|<!--", re.I)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "nav", "noscript")} | {None: re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_HTML = re.compile(r"""<html\b(?:[^>"']+|"[^"]*"|'[^']*')*""", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def declared_language(page: str) -> str | None:
    """The language that the page's first html tag outside comments declares, wherever the tag is."""
    tag = _HTML.search(_COMMENT.sub(" ", page))
    m = _LANG.search(tag[0]) if tag else None
    return m[1].lower() if m else None


def visible(page: str) -> str:
    """The page without comments and elements that aren't prose; one that is never closed stays. A closing tag that isn't found once
    isn't looked for again, so the time is linear in the page."""
    parts, at, kept, unclosed = [], 0, 0, set()
    while m := _OPENING.search(page, at):
        name = m[1].lower() if m[1] else None
        end = None if name in unclosed else _CLOSING[name].search(page, m.end())
        if end is None:
            unclosed.add(name)
            at = m.end()
        else:
            parts.append(page[kept : m.start()])
            at = kept = end.end()
    return " ".join([*parts, page[kept:]])


def _site(host: str) -> str:
    """The registered domain: two labels, three under a general label of a country (co.uk)."""
    parts = host.split(".")
    three = len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in _GENERAL
    return ".".join(parts[-3 if three else -2 :])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html) -> (page_id, declared, suffix, domain, host, text)."""
    for batch in batches:
        rows = []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            try:
                host = (urlsplit(url).hostname or None) if url else None
            except ValueError:
                host = None
            rows.append((declared_language(page) if page else None, host.rsplit(".", 1)[-1] if host else None, _site(host) if host else None, host, _html.unescape(_TAG.sub(" ", visible(page))) if page else ""))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "declared", "suffix", "domain", "host", "text"])


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    rows = pages.select("page_id", "url", "html").mapInArrow(_pages, "page_id long, declared string, suffix string, domain string, host string, text string")
    return identify(rows, model, F.col("declared"), F.col("suffix"), F.col("domain"), F.col("host"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
    return out.select("page_id", "host", "declared", "language", F.round("confidence", 6).alias("confidence"), "text_language")
