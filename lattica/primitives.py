"""Data-parallel primitives on DataFrames: ranges, scans, segmented reduction, gathering, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.session import settled

REDUCERS = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def id_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    """The ids start .. end-1."""
    return spark.range(start, end)


def exclusive_scan(df: DataFrame, order: str, value: str | Column, name: str = "scan", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before, by ``order`` (unique keys).

    Range partitions are summed each; the sums (one a partition) are scanned, and a window inside each partition does the
    rest, so no task sees more than its own range.
    """
    value = F.col(value) if isinstance(value, str) else value
    n = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = settled(df.withColumn("_v", value).repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "scan")
    sums = rows.groupBy("_part").agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("_s"))
    before = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_before"))  # a row a partition
    inside = F.sum("_v").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_in")).select(*df.columns, name)


def scan_total(df: DataFrame, value: str) -> int:
    """The total that goes with a scan."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0))).first()[0]


def gather_counts(degrees: DataFrame) -> DataFrame:
    """Edges that a gather looks at: the in-degree, at least one."""
    return degrees.select("id", F.greatest("degree", F.lit(1)).alias("n"))


def scatter_counts(degrees: DataFrame, flag: str) -> DataFrame:
    """Edges that a scatter looks at: the out-degree where flagged."""
    return degrees.select("id", F.when(F.col(flag), F.col("degree")).otherwise(0).alias("n"))


def reduce_by_key(df: DataFrame, key: str, value: str, how: str = "sum", name: str = "value") -> DataFrame:
    return df.groupBy(key).agg(REDUCERS[how](value).alias(name))


def interval_gather(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """The out-edges of ``ids``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")


def compact(df: DataFrame, flag: str | Column, *columns: str) -> DataFrame:
    """The flagged rows: stream compaction of ids or other values."""
    return df.filter(flag).select(*(columns or ("id",)))


def unique_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in ascending order."""
    return df.select(column).distinct().orderBy(column)


def arg_sort(df: DataFrame, key: str, index: str) -> DataFrame:
    """``df`` with ``position``: its place in the order of (key, index)."""
    n = exclusive_scan(df.withColumn("_k", F.struct(key, index)), "_k", F.lit(1).cast("long"), "position")
    return n.drop("_k")


def by_edges(df: DataFrame, key: str, partitions: int, salt: int = 1) -> DataFrame:
    """Rows dealt to partitions by key; with ``salt`` > 1 a hub's rows go to several."""
    if salt == 1:
        return df.repartition(partitions, key)
    return df.repartition(partitions, F.col(key), F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
