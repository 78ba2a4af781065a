"""Quality and toxicity by hierarchical empirical Bayes: classifier evidence shrunk through path and host toward the corpus.

A document classifier gives log odds: significant words (hashed; those whose presence differs between the classes by ``min_z``
standard errors) as a naive Bayes score, and a few measures of style, joined by a logistic regression. It is fitted on a
sample of labelled rows whose bound is a parameter (``sample_rows``; the rows of least hash of doc_id, so it is the same sample
on every run): naive Bayes on one half, the regression on the other. Everything else covers all rows.

Sites are a tree: corpus, host, path. The mean class probability of a host is shrunk toward the corpus, that of a path toward its
host, each by a pseudo-count estimated from the spread of the level's means (method of moments), so a sparse site says
little. A document's own share is taken out of the sums before they are applied to it. Its posterior log odds are the classifier's
plus those of its path against the corpus. All sums are grouped aggregations with map-side combining; a hot host is one row
in each task.

Defined cases: a null or blank text has no words and style measures of 0; null hosts or paths are a host or path of their own; rows that
share a doc_id are scored each, and a label counts for each of them; null labels are not used; with fewer than two classes in
the sample the classifier says the sample's mean (or 0.5); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import textarrays as ta
from lattica.llm.common import checked_broadcast, written

BUCKETS = 1 << 18
STYLE = 8
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL[[ord("."), ord(","), ord("'"), ord("-")]] = False


def _documents(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct word buckets, style measures) of every text."""
    data, offsets = ta.buffers(column)
    for a, b, raw, off in ta.chunks(data, offsets):
        words, first = ta.word_hashes(raw, off, ~_LETTER)
        buckets = (words >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)
        for i in range(b - a):
            x, w = raw[off[i] : off[i + 1]], buckets[first[i] : first[i + 1]]
            distinct, n, letters = np.unique(w), max(len(w), 1), max(int(_LETTER[x].sum()), 1)
            upper = int(((x >= 65) & (x <= 90)).sum())
            style = [int(_SYMBOL[x].sum()) / max(len(x), 1), upper / letters, len(distinct) / n, letters / n / 10, np.log1p(len(w)) / 10, int(((x >= 48) & (x <= 57)).sum()) / max(len(x), 1), int((x == 124).sum()) / n, int((x == 33).sum()) / n]
            yield distinct, np.array(style) if len(x) else np.zeros(STYLE)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, class counts of the documents that have it); bucket -1 counts documents."""
    for batch in batches:
        q, t = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("quality", "toxic"))
        half = batch.column("half").to_numpy(zero_copy_only=False)
        found, cls = [], []
        for row, (buckets, _) in enumerate(_documents(batch.column("text"))):
            if half[row] == 0:
                found.append(np.append(buckets, -1))
                cls.append(np.full(len(buckets) + 1, 2 * q[row] + t[row]))
        if found:
            b, c = np.concatenate(found), np.concatenate(cls)
            key, n = np.unique(b * 4 + c, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key // 4).astype(np.int64)), pa.array((key % 4).astype(np.int64)), pa.array(n.astype(np.int64))], ["bucket", "cls", "n"])


class Words:
    """Naive Bayes weights of the significant buckets for one label."""

    def __init__(self, pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, min_z: float):
        a, b = (pos + 0.5) / (n_pos + 1), (neg + 0.5) / (n_neg + 1)
        both = (pos + neg + 1) / (n_pos + n_neg + 2)
        z = np.abs(a - b) / np.sqrt(both * (1 - both) * (1 / (n_pos + 1) + 1 / (n_neg + 1)))
        use = (z >= min_z) & (pos + neg >= 3)
        self.weight = np.where(use, np.log(a / b), 0.0).astype(np.float32)


def _measured(words: list[Words]):
    """Rows with the array x: a naive Bayes score for each label and the style measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [[*(float(w.weight[b].sum()) for w in words), *s] for b, s in _documents(batch.column("text"))]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression by Newton steps."""
    center, scale = (x.mean(0), np.maximum(x.std(0), 1e-9)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    x = np.column_stack([(x - center) / scale, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        return w
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * center / scale).sum())


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000, min_z: float = 5.0) -> tuple[list[Words], list[np.ndarray]]:
    """The classifiers of quality and of toxicity from at most ``sample_rows`` labelled rows."""
    use = labels.filter("doc_id is not null and quality is not null and toxic is not null").select("doc_id", "quality", "toxic")
    sample = use.orderBy(F.xxhash64("doc_id"), "quality", "toxic").limit(sample_rows).withColumn("half", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int"))
    rows = written(docs.select("doc_id", "text").join(F.broadcast(written(sample, "label-sample")), "doc_id"), "labelled-texts")
    counts = rows.mapInArrow(_word_counts, "bucket long, cls long, n long").groupBy("bucket", "cls").agg(F.sum("n").alias("n")).toPandas()  # 4 * BUCKETS rows at most
    table = np.zeros((BUCKETS + 1, 4))
    table[counts["bucket"].to_numpy(np.int64), counts["cls"].to_numpy(np.int64)] = counts["n"].to_numpy()
    totals, table = table[-1], table[:-1]
    words, sides = [], ([2, 3], [1, 3])
    for yes in sides:
        no = [c for c in range(4) if c not in yes]
        words.append(Words(table[:, yes].sum(1), table[:, no].sum(1), totals[yes].sum(), totals[no].sum(), min_z))
    got = rows.filter("half = 1").mapInArrow(_measured(words), "doc_id long, quality int, toxic int, half int, x array<double>").select("quality", "toxic", "x").toPandas()  # sample_rows rows at most
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, 2 + STYLE))
    return words, [logistic(x, got[c].to_numpy(float)) for c in ("quality", "toxic")]


def _odds(weights: np.ndarray) -> Column:
    terms = [F.lit(float(weights[-1]))] + [F.lit(float(w)) * F.element_at("x", i + 1) for i, w in enumerate(weights[:-1])]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.least(F.lit(20.0), F.greatest(F.lit(-20.0), out))


def _sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def _logit(c: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c))
    return F.log(p / (1 - p))


def pseudo_count(means: DataFrame, n: str, mean: str, above: Column, center: float, groups: int = 1) -> float:
    """Documents that the level above counts for, from the spread of the means of sites around those ``above`` them (``groups`` of them),
    beyond their sampling error."""
    r = means.agg(F.sum(F.col(n) * (F.col(mean) - above) ** 2).alias("ss"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
    if not r["n"] or r["k"] <= groups:
        return 1e6
    noise = center * (1 - center)
    between = max((r["ss"] - (r["k"] - groups) * noise) / r["n"], 1e-6)
    return max(noise / between - 1, 1.0)


def combine(scored: DataFrame, names: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """``scored`` (host, path, lo_<name>) with the posterior p_<name> of each name."""
    for c in names:
        scored = scored.withColumn(f"p_{c}", _sigmoid(F.col(f"lo_{c}")))
    scored = scored.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("pn"), *(F.sum(f"p_{c}").alias(f"ps_{c}") for c in names)), "path-sums")
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), *(F.sum(f"ps_{c}").alias(f"hs_{c}") for c in names))
    sites = written(paths.join(hosts, "host"), "site-sums")
    total = sites.agg(F.coalesce(F.sum("pn"), F.lit(0)), *(F.coalesce(F.sum(f"ps_{c}"), F.lit(0.0)) for c in names)).first()
    out, n_hosts = scored.join(checked_broadcast(sites), ["host", "path"]), hosts.count()
    for i, c in enumerate(names):
        mean = total[1 + i] / total[0] if total[0] else 0.5
        k_host = pseudo_count(sites.groupBy("host").agg(F.first("hn").alias("n"), F.first(F.col(f"hs_{c}") / F.col("hn")).alias("m")), "n", "m", F.lit(float(mean)), mean)
        within = sites.select(F.col("pn").alias("n"), (F.col(f"ps_{c}") / F.col("pn")).alias("m"), (F.col(f"hs_{c}") / F.col("hn")).alias("h"))
        k_path = pseudo_count(within, "n", "m", F.col("h"), mean, n_hosts)
        own = F.col(f"p_{c}")
        host = (F.col(f"hs_{c}") - own + k_host * mean) / (F.col("hn") - 1 + k_host)
        path = (F.col(f"ps_{c}") - own + k_path * host) / (F.col("pn") - 1 + k_path)
        out = out.withColumn(f"p_{c}", _sigmoid(F.col(f"lo_{c}") + _logit(path) - F.lit(float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))))))
    return out


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample_rows: int = 40_000) -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep) of every row; keep: more likely good than not, and more likely not toxic than toxic."""
    words, weights = fit(docs, labels, sample_rows)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    measured = rows.mapInArrow(_measured(words), f"doc_id {id_type}, host string, path string, x array<double>")
    scored = written(measured.select("doc_id", "host", "path", _odds(weights[0]).alias("lo_quality"), _odds(weights[1]).alias("lo_toxic")), "classifier-scores")
    return combine(scored).select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, F.col("source"), F.col("lang"))
