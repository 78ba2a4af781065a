"""Benchmark decontamination: which documents hold at least ``threshold`` of a test item's word shingles.

Test items are partitioned by the size of their shingle sets into bands [2^i, 2^(i+1)). An item of n shingles may lack
n - ceil(threshold n) of them, so the MinHash sketch of an item is its k least shingle hashes with k = one more than what an
item of the band's upper size may lack: each document that contains enough of the item holds at least one sketch value.
Containment search is therefore complete, whatever the documents' length - a plain Jaccard MinHash would miss a short item in a
long document. Documents probe the sketches with all their shingles (no signature of the document is truncated), only candidates
are read a second time, and their shingles are compared with the items' as text.

The benchmark is small against the corpus; sketches and item shingles are broadcast after their rows were counted, and joined by
shuffling beyond that.

Defined cases: a null or blank text contains nothing and an item without words is not searched; an item of fewer than ``size``
words is one shingle and found only in a document that consists of the same words; equal items are reported each; rows that
share a doc_id are searched each and the largest share is reported; a null doc_id is reported as null; empty tables give
an empty result; other columns are not looked at (``decontaminate`` carries them along, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import NO_ID, checked_broadcast, keyed, pinned, tokens_of, without, written


def _shingles(words: Column, size: int, as_text: bool) -> Column:
    one = (lambda w: F.concat_ws(" ", w)) if as_text else F.xxhash64
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: one(F.slice(words, i, size)))
    return F.array_distinct(F.when(n >= size, runs).when(n > 0, F.array(one(words))).otherwise(F.array().cast("array<string>" if as_text else "array<bigint>")))


def shingled(df: DataFrame, size: int, as_text: bool) -> DataFrame:
    """``df`` (with a column text) and the array ``sh`` of its distinct shingles, as text or as 64-bit hashes."""
    return pinned(df, "_w", tokens_of("text")).withColumn("sh", _shingles(F.col("_w"), size, as_text)).drop("_w", "text")


def sketches(items: DataFrame, threshold: float, size: int) -> DataFrame:
    """(item, h): the k least shingle hashes of each item, k by its size band."""
    s = shingled(items, size, as_text=False).filter(F.size("sh") > 0)
    upper = F.pow(F.lit(2.0), F.length(F.bin(F.size("sh").cast("long")))) - 1
    k = F.floor(upper * (1 - threshold) + 1e-6).cast("int") + 1  # what may be missing, and one more
    return s.select("item", F.explode(F.slice(F.array_sort("sh"), F.lit(1), F.least(k, F.size("sh")))).alias("h"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(_d, _t, item, n_item, n_shared) of every document row and item with n_shared >= threshold * n_item.

    ``docs`` needs doc_id and text, ``items`` item_id and text.
    """
    texts = keyed(docs.select("doc_id", "text"))[0].drop("doc_id")
    named = items.select(F.col("item_id").alias("item"), "text").filter(F.col("text").isNotNull())
    sketch = checked_broadcast(written(sketches(named, threshold, size).distinct(), "item-sketches"))
    probes = shingled(texts, size, as_text=False).select("_d", "_t", F.explode("sh").alias("h"))
    candidates = written(probes.join(sketch, "h").select("_d", "_t").distinct(), "decontamination-candidates")
    again = texts.join(checked_broadcast(candidates), ["_d", "_t"], "left_semi")
    held = shingled(again, size, as_text=True).select("_d", "_t", F.explode("sh").alias("s"))
    sets = written(shingled(named, size, as_text=True).select("item", "sh").distinct().select("item", F.size("sh").alias("n_item"), F.hash("sh").alias("variant"), "sh"), "items")
    wanted = checked_broadcast(sets.select("item", "variant", "n_item", F.explode("sh").alias("s")))
    shared = held.join(wanted, "s").groupBy("_d", "_t", "item", "variant", "n_item").agg(F.count_distinct("s").alias("n_shared"))
    enough = shared.filter(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - 1e-6)
    return enough.groupBy("_d", "_t", "item").agg(F.max_by(F.struct("n_item", "n_shared"), F.col("n_shared") / F.col("n_item")).alias("x")).select("_d", "_t", "item", "x.n_item", "x.n_shared")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` without the rows that hold a test item."""
    bad = written(contained(docs, items, threshold, size).select("_d", "_t").distinct(), "contaminated")
    return without(docs, bad)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contained(docs, items).groupBy("_d", "item").agg(F.max_by(F.struct("n_item", "n_shared"), F.col("n_shared") / F.col("n_item")).alias("x"))
    return found.select(F.nullif("_d", F.lit(NO_ID)).alias("doc_id"), F.col("item").alias("item_id"), F.col("x.n_item").cast("long").alias("n_item_shingles"), F.col("x.n_shared").cast("long").alias("n_shared"), F.round(F.col("x.n_shared") / F.col("x.n_item"), 6).alias("containment"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item_shingles, n_shared, round(CAST(n_shared AS DOUBLE) / n_item_shingles, 6) AS containment
FROM x JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n_item_shingles
"""
