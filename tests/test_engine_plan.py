from pyspark.sql import functions as F

from lattica.engine import Engine, VertexProgram
from lattica.graph import Graph


def test_kept_edges_are_not_sorted_or_moved_in_a_step(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = Graph.from_edges(spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 0, 4)], "src long, dst long, w int"))
        program = VertexProgram(gather=lambda s, e, d: s.dist + e.w, reduce="min", apply=lambda v, acc, i: ({"dist": F.least(v.dist, acc)}, acc < v.dist))
        e = Engine(g, program, g.vertices.select("id", F.lit(9).cast("long").alias("dist")))
        e.set_active(g.vertices)
        plan = e.gathered()._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, x in enumerate(plan) if "InMemoryTableScan" in x)
        join = max(i for i, x in enumerate(plan[:scan]) if "SortMergeJoin" in x)
        assert not [x for x in plan[join:scan] if "Sort [" in x or "Exchange" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kept_blocks_are_not_sorted_or_moved_in_a_step(spark, monkeypatch):
    from lattica.blocks import Blocks

    monkeypatch.setattr("lattica.blocks.BLOCK_EDGES", 1)
    b = Blocks(Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")))
    rows = spark.createDataFrame([(x, 0, 0, None) for x in b.cut.labels], "b int, k int, n long, data binary")
    both = b.topology.groupBy("b").cogroup(rows.repartition(b.n, "b").groupBy("b")).applyInArrow(lambda t, r: r, rows.schema)
    plan = both._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, x in enumerate(plan) if "InMemoryTableScan" in x)
    assert not [x for x in plan[:scan] if "Sort [" in x or "Exchange" in x]
