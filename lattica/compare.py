"""Comparison of results and timing reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.algorithms import UNREACHED_DISTANCE

#: The other system's unreached distance, and the rank report's bins and allowed shares.
OTHER_UNREACHED = 10000000
BIN_EDGES = [1e-4, 1e-3, 1e-2, 0.1, 1, 10]
ALLOWED_SHARES = [1, 1e-2, 5e-3, 5e-4, 5e-5, 5e-6, 0]


def exact_diff(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(id, left, right) where two results differ or one lacks the id."""
    j = a.select("id", F.col(value).alias("left")).join(b.select("id", F.col(value).alias("right")), "id", "full_outer")
    return j.filter("not (left <=> right)")


def tolerant_diff(a: DataFrame, b: DataFrame, value: str, tol: float = 1e-6) -> DataFrame:
    j = a.select("id", F.col(value).alias("left")).join(b.select("id", F.col(value).alias("right")), "id", "full_outer")
    return j.filter(F.col("left").isNull() | F.col("right").isNull() | (F.abs(F.col("left") - F.col("right")) > tol))


def check_distances(gold: DataFrame, test: DataFrame, value: str) -> DataFrame:
    """(id, gold, test) of the gold ids that the test result lacks or has another value for; the two unreached values are equal."""
    j = gold.select("id", F.col(value).alias("gold")).join(test.select("id", F.col(value).alias("test")), "id", "left")
    same = F.col("gold") == F.col("test")
    return j.filter(~F.coalesce(same | ((F.col("gold") == OTHER_UNREACHED) & (F.col("test") == UNREACHED_DISTANCE)), F.lit(False)))


def _bin(error: Column) -> Column:
    out = F.lit(len(BIN_EDGES))
    for i in range(len(BIN_EDGES) - 1, -1, -1):
        out = F.when(error < BIN_EDGES[i], F.lit(i)).otherwise(out)
    return out


def rank_histogram(gold: DataFrame, test: DataFrame, value: str = "rank") -> DataFrame:
    """(bin, n, share, allowed, ok): ids by decade of the difference; shares are of all ids of ``test``, those that gold lacks included."""
    j = gold.select("id", F.col(value).alias("g")).join(test.select("id", F.col(value).alias("t")), "id")
    bins = j.select(_bin(F.abs(F.col("g") - F.col("t"))).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = test.agg(F.count("*").alias("total"))  # one row; ids that gold lacks count here
    allowed = F.element_at(F.array(*(F.lit(float(x)) for x in ALLOWED_SHARES)), F.col("bin") + 1)
    return bins.join(F.broadcast(total)).select("bin", "n", (F.col("n") / F.col("total")).alias("share"), allowed.alias("allowed"), (F.col("n") / F.col("total") <= allowed).alias("ok"))


def check_ranks(gold: DataFrame, test: DataFrame, value: str = "rank") -> bool:
    return rank_histogram(gold, test, value).filter("not ok").isEmpty()


def timing_report(timings: DataFrame, base: str = "cpu", other: str = "gpu") -> DataFrame:
    """(algo, graph, <base>, <other>, ratio) from (algo, graph, system, ms); -1 where a time is missing."""
    p = timings.groupBy("algo", "graph").pivot("system", [base, other]).agg(F.first("ms"))
    ratio = F.when(F.col(base).isNotNull() & F.col(other).isNotNull() & (F.col(other) > 0), F.col(base) / F.col(other)).otherwise(-1.0)
    return p.select("algo", "graph", F.coalesce(base, F.lit(-1.0)).alias(base), F.coalesce(other, F.lit(-1.0)).alias(other), ratio.alias("ratio"))
