"""The algorithms once more, as plain rounds over all edges without engine or frontier, to compare results with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.algorithms import PAGE_CONST, TOLERANCE, UNREACHED_DISTANCE
from lattica.graph import Graph
from lattica.session import settled


def _least(state: DataFrame, edges: DataFrame, message: Callable[[Column], Column]) -> DataFrame:
    """(id, x) when no edge lessens any x."""
    while True:
        sent = edges.join(state, edges["src"] == state["id"]).groupBy("dst").agg(F.min(message(F.col("x"))).alias("m")).withColumnRenamed("dst", "id")
        after = settled(state.join(sent, "id", "left").select("id", F.least("x", "m").alias("x"), (F.col("m") < F.coalesce("x", F.lit(1 << 62))).alias("less")), "plain")
        state = after.select("id", "x")
        if after.filter("less").isEmpty():
            return state


def sssp(graph: Graph, source: int, directed: bool = True) -> DataFrame:
    g = graph if directed else graph.symmetrize()
    start = graph.vertices.select("id", F.when(F.col("id") == source, F.lit(0)).cast("long").alias("x"))
    return _least(start, g.edges, lambda x: x + F.col("w")).select("id", F.coalesce("x", F.lit(UNREACHED_DISTANCE)).alias("dist"))


def min_labels(graph: Graph) -> DataFrame:
    return _least(graph.vertices.select("id", F.col("id").alias("x")), graph.edges, lambda x: x).select("id", F.col("x").alias("label"))


def pagerank(graph: Graph, tol: float = TOLERANCE, iterations: int | None = None) -> DataFrame:
    """With ``iterations`` all vertices take part in each; else those with an in-neighbour that changed by ``tol`` or more."""
    degree = graph.edges.groupBy("src").agg(F.count("*").alias("k")).withColumnRenamed("src", "id")
    state, done = graph.vertices.select("id", F.lit(PAGE_CONST).alias("rank"), F.lit(True).alias("on")), 0
    while (done < iterations) if iterations else not state.filter("on").isEmpty():
        out = graph.edges.join(state.join(degree, "id"), F.col("id") == F.col("src"))
        acc = out.groupBy("dst").agg(F.sum(F.col("rank") / F.col("k")).alias("acc")).withColumnRenamed("dst", "id")
        new = F.when(F.col("on"), PAGE_CONST + (1 - PAGE_CONST) * F.coalesce("acc", F.lit(0.0))).otherwise(F.col("rank"))
        moved = settled(state.join(acc, "id", "left").select("id", new.alias("new"), (F.col("on") & (F.abs(new - F.col("rank")) >= tol)).alias("far")), "plain")
        told = graph.edges.join(moved.filter("far").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(True))
        on = F.lit(True) if iterations else F.col("hit").isNotNull()
        state, done = settled(moved.join(told, "id", "left").select("id", F.col("new").alias("rank"), on.alias("on")), "plain"), done + 1
    return state.select("id", "rank")
