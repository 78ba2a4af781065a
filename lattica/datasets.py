"""Graphs derived from the order tables: dense vertex ids, deterministic edges."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.graph import Graph
from lattica.session import settled


def part_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """In each order the part of a line leads to that of the next line; ``w`` is the first line's quantity. Directed, dense."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    edges = lines.select(F.col("l_partkey").cast("long").alias("src"), after.cast("long").alias("dst"), F.floor("l_quantity").cast("int").alias("w"))
    return Graph.from_edges(settled(edges.filter("dst is not null and src <> dst"), "edges"))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer to supplier (ids behind the customers') for returned lines of large quantity: sparse, with isolated vertices."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R' and l_quantity >= 48").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    n_customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    n_suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = edges.select(F.col("o_custkey").cast("long").alias("src"), (F.col("l_suppkey") + n_customers).cast("long").alias("dst"), F.floor("l_quantity").cast("int").alias("w"))
    return Graph.from_edges(edges, n_customers + n_suppliers)


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer's nation to supplier's nation of each order line of the first orders' status, with its count as ``w``: tiny."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = joined.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("int").alias("w"))
    return Graph.from_edges(edges.filter("src <> dst"), 25)
