"""Five stages that turn ``documents`` into packed training sequences.

Each stage works on all rows that the one before kept, takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written as Parquet and read again. All but the last return the columns of ``documents``; a stage that changes text sets
n_chars anew. Rows are dropped by name (doc_id and hash of the text), so rows that share a doc_id are judged each.

Defined cases: null, empty and blank texts have no letters and go in the first stage; very long texts are taken whole; of equal rows,
or rows equal but for other columns, one stays after the third stage; an empty table passes all stages as an empty table; columns
beside doc_id, text, lang, source and n_chars are carried along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import op3_decontamination, op4_language_id, op6_packing, op7_parity_join, op9_line_dedup
from lattica.llm.common import keyed, sheltered, text_batches, unwritten, without, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told from text, declared language and source; texts without letters go."""
    text_batches(spark)
    model = op4_language_id.train(docs)
    none = F.lit(None).cast("string")
    rows = keyed(docs.select("doc_id", "lang", "source", "text"))[0].drop("doc_id")
    told = op4_language_id.identify(rows, model, F.lower("lang"), none, none, F.col("source"))
    return without(docs, written(told.filter("language = 'und'").select("_d", "_t").distinct(), "rejected"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that stay in a later document."""
    text_batches(spark)
    inner, restored = sheltered(docs, "doc_id", "text", "n_chars")
    out = op9_line_dedup.line_dedup(inner)
    return restored(out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id, and of several rows with it one."""
    text_batches(spark)
    return op7_parity_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item of ``benchmark``."""
    return op3_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    text_batches(spark)
    return op6_packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, before, sf_dir), f"stage-{name}")
        unwritten(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
