"""Synthetic graphs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph


def power_law(spark: SparkSession, n: int, alpha: float = 2.0, max_degree: int = 100_000_000, seed: int = 0) -> Graph:
    """n vertices whose out-degrees follow a power law of exponent ``alpha``; ends are uniform. The same for the same seed."""
    unit = lambda *c: (F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 53)) + 1) / float(1 << 53)
    degree = F.least(F.floor(F.pow(unit("id"), F.lit(-1 / (alpha - 1)))), F.lit(min(max_degree, max(n - 1, 1)))).cast("int")
    out = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), degree)).alias("k"))
    dst = F.pmod(F.xxhash64("src", "k", F.lit(seed + 1)), F.lit(n))
    return Graph(spark.range(n), out.select("src", dst.alias("dst")).filter("src <> dst"))
