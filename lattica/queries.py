"""A query for each operator of the library over graphs of the order tables, with the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import algorithms, compare, primitives
from lattica.datasets import nation_trade, part_flow, trade
from lattica.engine import Engine, VertexProgram
from lattica.graph import Graph
from lattica.session import settled, shared_dir
from lattica.sources import convert, read_graph, write_graph, write_results
from lattica.sources.binary import read_binary_offsets
from lattica.sources.dispatch import random_weights, replicate_files

# ---- graphs in SQL --------------------------------------------------------------------------------------------------

PART = """e AS (SELECT * FROM (SELECT CAST(l_partkey AS BIGINT) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT) AS dst,
 CAST(floor(l_quantity) AS INTEGER) AS w FROM lineitem) WHERE dst IS NOT NULL AND src <> dst),
v AS (SELECT CAST(unnest(range((SELECT max(greatest(src, dst)) + 1 FROM e))) AS BIGINT) AS id)"""
TRADE = """e AS (SELECT CAST(o_custkey AS BIGINT) AS src, CAST(l_suppkey + (SELECT count(*) FROM customer) AS BIGINT) AS dst, CAST(floor(l_quantity) AS INTEGER) AS w
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 48),
v AS (SELECT CAST(unnest(range((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier))) AS BIGINT) AS id)"""
NATION = """e AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS INTEGER) AS w
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL)"""
BOTH = "y AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)"
OUTDEG = "od AS (SELECT v.id, count(e.src) AS outdeg FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)"


def _bfs_sql(graph: str, start: str, edges: str = "e") -> str:
    return f"""WITH RECURSIVE {graph}, {BOTH}, {OUTDEG},
b(v, d) USING KEY (v) AS (SELECT id, 0 FROM ({start}) UNION
 SELECT x.dst, min(b.d) + 1 FROM b JOIN {edges} x ON x.src = b.v LEFT JOIN recurring.b r ON r.v = x.dst WHERE r.v IS NULL GROUP BY x.dst)
SELECT id, CAST(coalesce(d, -1) AS INTEGER) AS depth FROM v LEFT JOIN b ON b.v = v.id"""


def _sssp_sql(graph: str, start: str, edges: str = "e") -> str:
    return f"""WITH RECURSIVE {graph}, {BOTH}, {OUTDEG},
s(v, d) USING KEY (v) AS (SELECT id, CAST(0 AS BIGINT) FROM ({start}) UNION
 SELECT x.dst, min(s.d + x.w) FROM s JOIN {edges} x ON x.src = s.v LEFT JOIN recurring.s r ON r.v = x.dst GROUP BY x.dst, r.d HAVING r.d IS NULL OR min(s.d + x.w) < r.d)
SELECT id, CAST(coalesce(d, 2147383647) AS BIGINT) AS dist FROM v LEFT JOIN s ON s.v = v.id"""


def _cc_sql(graph: str, edges: str) -> str:
    return f"""WITH RECURSIVE {graph}, {BOTH},
l(v, c) USING KEY (v) AS (SELECT id, id FROM v UNION
 SELECT x.dst, min(l.c) FROM l JOIN {edges} x ON x.src = l.v JOIN recurring.l r ON r.v = x.dst GROUP BY x.dst, r.c HAVING min(l.c) < r.c)
SELECT v AS id, c AS label FROM l"""


def _rank_sql(graph: str, changed: str) -> str:
    return f"""WITH RECURSIVE {graph}, {OUTDEG},
m AS (SELECT src, dst, count(*) AS k FROM e GROUP BY src, dst),
r(it, id, rank, act) AS (SELECT 0, id, CAST(0.15 AS DOUBLE), TRUE FROM v UNION ALL
 (WITH g AS (SELECT m.dst AS id, sum(m.k * r.rank / od.outdeg) AS acc FROM m JOIN r ON r.id = m.src JOIN od ON od.id = m.src GROUP BY m.dst),
  st AS (SELECT r.it, r.id, r.rank AS old, CASE WHEN r.act THEN 0.15 + 0.85 * coalesce(g.acc, 0) ELSE r.rank END AS new FROM r LEFT JOIN g ON g.id = r.id),
  nx AS (SELECT DISTINCT m.dst AS id FROM m JOIN st ON st.id = m.src WHERE {changed})
  SELECT st.it + 1, st.id, st.new, nx.id IS NOT NULL FROM st LEFT JOIN nx ON nx.id = st.id WHERE EXISTS (SELECT 1 FROM r WHERE act)))
SELECT id, round(rank, 6) AS rank FROM r WHERE it = (SELECT max(it) FROM r)"""


def _fixed_sql(graph: str, n: int) -> str:
    return f"""WITH RECURSIVE {graph}, {OUTDEG},
r(it, id, rank) AS (SELECT 0, id, CAST(0.15 AS DOUBLE) FROM v UNION ALL
 (WITH g AS (SELECT e.dst AS id, sum(r.rank / od.outdeg) AS acc FROM e JOIN r ON r.id = e.src JOIN od ON od.id = e.src GROUP BY e.dst)
  SELECT r.it + 1, r.id, 0.15 + 0.85 * coalesce(g.acc, 0) FROM r LEFT JOIN g ON g.id = r.id WHERE r.it < {n}))
SELECT id, round(rank, 6) AS rank FROM r WHERE it = {n}"""


def _delta_sql(graph: str, tol: float) -> str:
    return f"""WITH RECURSIVE {graph}, {OUTDEG},
m AS (SELECT src, dst, count(*) AS k FROM e GROUP BY src, dst),
r(it, id, rank, residual) AS (SELECT 0, id, CAST(0 AS DOUBLE), CAST(0.15 AS DOUBLE) FROM v UNION ALL
 (WITH g AS (SELECT m.dst AS id, sum(0.85 * r.residual / od.outdeg * m.k) AS got FROM m JOIN r ON r.id = m.src JOIN od ON od.id = m.src WHERE r.residual > {tol} GROUP BY m.dst)
  SELECT r.it + 1, r.id, CASE WHEN r.residual > {tol} THEN r.rank + r.residual ELSE r.rank END, CASE WHEN r.residual > {tol} THEN 0 ELSE r.residual END + coalesce(g.got, 0)
  FROM r LEFT JOIN g ON g.id = r.id WHERE EXISTS (SELECT 1 FROM r WHERE residual > {tol})))
SELECT id, round(rank + residual, 6) AS rank FROM r WHERE it = (SELECT max(it) FROM r)"""


MAX_DEGREE = "SELECT id FROM od ORDER BY outdeg DESC, id LIMIT 1"
ZERO = "SELECT CAST(0 AS BIGINT) AS id"

# ---- pieces of queries ----------------------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.round("rank", 6))


def _min_engine(graph: Graph, **more) -> Engine:
    """An engine whose state is each vertex's id and whose gather takes the least of it."""
    program = VertexProgram(gather=lambda src, edge, dst: src.label, reduce="min", apply=lambda v, acc, i: ({"label": F.least(v.label, acc)}, acc < v.label), **more)
    engine = Engine(graph, program, graph.vertices.select("id", F.col("id").alias("label")))
    engine.set_active(graph.vertices)
    return engine


def _closed(engine: Engine, df: DataFrame) -> DataFrame:
    out = settled(df, "step")
    engine.close()
    return out


def gather_min(spark: SparkSession, sf: str) -> DataFrame:
    e = _min_engine(part_flow(spark, sf))
    return _closed(e, e.gathered().select("id", F.col("_acc").alias("acc")))


def gather_sum(spark: SparkSession, sf: str) -> DataFrame:
    g = part_flow(spark, sf)
    program = VertexProgram(gather=lambda src, edge, dst: edge.w.cast("long") + dst.label - src.label, reduce="sum", uses_dst=True, apply=lambda v, acc, i: ({}, F.lit(False)))
    e = Engine(g, program, g.vertices.select("id", F.col("id").alias("label")))
    e.set_active(g.vertices)
    return _closed(e, e.gathered().select("id", F.col("_acc").alias("acc")))


def gather_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices without an in-edge get the zero."""
    g = trade(spark, sf)
    program = VertexProgram(gather=lambda src, edge, dst: edge.w, reduce="max", zero=-7, apply=lambda v, acc, i: ({"top": acc}, F.lit(False)))
    e = Engine(g, program, g.vertices.select("id", F.lit(None).cast("int").alias("top")))
    e.set_active(g.vertices)
    e.gather_apply()
    return _closed(e, e.results())


def apply_changed(spark: SparkSession, sf: str) -> DataFrame:
    g = part_flow(spark, sf)
    e = _min_engine(g)
    e.set_active(0, g.vertices.count() // 2)
    e.gather_apply()
    return _closed(e, e.state.select("id", "label", F.col("_changed").alias("changed")))


def activate_frontier(spark: SparkSession, sf: str) -> DataFrame:
    g = part_flow(spark, sf)
    e = _min_engine(g)
    e.set_active(0, g.vertices.count() // 100)
    e.gather_apply()
    e.scatter_activate()
    e.next_iter()
    return _closed(e, primitives.compact(e.state, "_active"))


def set_active_range(spark: SparkSession, sf: str) -> DataFrame:
    e = _min_engine(part_flow(spark, sf))
    e.set_active(10, 40)
    return _closed(e, primitives.compact(e.state, "_active"))


def apply_without_gather(spark: SparkSession, sf: str) -> DataFrame:
    """Active vertices change by their own state alone."""
    g = trade(spark, sf)
    program = VertexProgram(gather=lambda src, edge, dst: src.label, apply=lambda v, acc, i: ({"label": v.label * 2 + i}, v.label % 2 == 1))
    e = Engine(g, program, g.vertices.select("id", F.col("id").alias("label")))
    e.set_active(0, g.vertices.count() // 2)
    e.gather_apply(have_gather=False)
    return _closed(e, e.state.select("id", "label", F.col("_changed").alias("changed")))


def sssp_gather_form(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest paths by full gathers of active vertices, not by messages of changed ones."""
    g = part_flow(spark, sf)
    program = VertexProgram(gather=lambda src, edge, dst: src.dist + edge.w, reduce="min", apply=lambda v, acc, i: ({"dist": F.least(v.dist, acc)}, acc.isNotNull() & (v.dist.isNull() | (acc < v.dist))))
    e = Engine(g, program, g.vertices.select("id", F.when(F.col("id") == 0, 0).cast("long").alias("dist")))
    e.set_active(g.vertices)
    return _closed(e, e.run().select("id", F.coalesce("dist", F.lit(algorithms.UNREACHED_DISTANCE)).cast("long").alias("dist")))


def scatter_edge_update(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of changed vertices take the difference of the ends' labels."""
    e = _min_engine(nation_trade(spark, sf), scatter=lambda src, edge, dst: {"w": (edge.w + src.label - dst.label).cast("int")})
    e.gather_apply()
    e.scatter_activate()
    return _closed(e, e.edges.select("src", "dst", "w"))


def engine_bfs(spark: SparkSession, sf: str) -> DataFrame:
    g = part_flow(spark, sf)
    e = Engine(g, algorithms.bfs_program(), g.vertices.select("id", F.lit(-1).alias("depth")))
    e.set_active(0, 1)
    return _closed(e, e.run())


def _round_trip(ext: str, values: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}.{ext}"
        write_graph(nation_trade(spark, sf), path)
        return read_graph(spark, path, values).edges

    return run


def edges_with_blanks_gz(spark: SparkSession, sf: str) -> DataFrame:
    """A gzipped edge list with comments, blank lines and more after the ids."""
    path = f"{shared_dir(spark)}/blanks-{uuid.uuid4().hex}.edges.gz"
    text = nation_trade(spark, sf).edges.select(F.concat(F.lit("# edge\n \t\n\n"), F.col("src"), F.lit("\t "), F.col("dst"), F.lit(" more")))
    text.write.option("compression", "gzip").text(path)
    return read_graph(spark, path).edges


def converted(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix converted to binary CSR, and that to a matrix again."""
    path = f"{shared_dir(spark)}/convert-{uuid.uuid4().hex}"
    write_graph(nation_trade(spark, sf), f"{path}.mtx")
    convert(spark, f"{path}.mtx", f"{path}.gr")
    convert(spark, f"{path}.gr", f"{path}-2.mtx")
    return read_graph(spark, f"{path}-2.mtx", True).edges


def replicated_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/replicate-{uuid.uuid4().hex}"
    write_graph(nation_trade(spark, sf), f"{path}.mtx")
    replicate_files(spark, [(f"{path}.mtx", 3)], f"{path}.edges")
    return read_graph(spark, f"{path}.edges").edges


def sharded_results(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/sharded-{uuid.uuid4().hex}"
    write_results(trade(spark, sf).in_degrees(), "degree", path, sharded=True)
    return spark.read.text(path)


def weighted_at_random(spark: SparkSession, sf: str) -> DataFrame:
    """Every edge keeps its ends and gets a weight in 0 .. 100."""
    return random_weights(part_flow(spark, sf)).edges.select("src", "dst", F.col("w").between(0, 100).alias("within"))


def tolerant_diff(spark: SparkSession, sf: str) -> DataFrame:
    g = part_flow(spark, sf)
    d = compare.tolerant_diff(algorithms.pagerank_fixed(g, 4), algorithms.pagerank_fixed(g, 3), "rank", 0.01)
    return d.select("id", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


def interval_gather(spark: SparkSession, sf: str) -> DataFrame:
    g = part_flow(spark, sf)
    return primitives.interval_gather(primitives.id_range(spark, 0, g.vertices.count() // 2), g.edges).select("src", "dst", "w")


def gr_offsets(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}.gr"
    write_graph(nation_trade(spark, sf), path)
    return read_binary_offsets(spark, path)


def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    from lattica.sources.results import lines

    return lines(algorithms.pagerank_fixed(nation_trade(spark, sf), 3), "rank").select("value")


def _distances(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A gold result that writes unreached as the other system does and is wrong at id 3, and one that is right."""
    d = algorithms.sssp(trade(spark, sf), 517)
    gold = d.withColumn("dist", F.when(F.col("dist") == algorithms.UNREACHED_DISTANCE, compare.OTHER_UNREACHED).when(F.col("id") == 517, 5).otherwise(F.col("dist")))
    return gold, d


def check_distances(spark: SparkSession, sf: str) -> DataFrame:
    gold, d = _distances(spark, sf)
    return compare.check_distances(gold, d, "dist").select("id", F.col("gold").cast("long").alias("gold"), F.col("test").cast("long").alias("test"))


def exact_diff(spark: SparkSession, sf: str) -> DataFrame:
    g = trade(spark, sf)
    return compare.exact_diff(algorithms.bfs(g, 517), algorithms.bfs(g.symmetrize(), 517), "depth")


def rank_histogram(spark: SparkSession, sf: str) -> DataFrame:
    g = part_flow(spark, sf)
    h = compare.rank_histogram(algorithms.pagerank_fixed(g, 4), algorithms.pagerank_fixed(g, 3))
    return h.select("bin", "n", F.round("share", 6).alias("share"), "allowed", "ok")


def timing_report(spark: SparkSession, sf: str) -> DataFrame:
    """Times made from the order table: status as algorithm, priority as graph."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    t = o.groupBy(F.col("o_orderstatus").alias("algo"), F.col("o_orderpriority").alias("graph"), F.when(F.col("o_custkey") % 2 == 0, "cpu").otherwise("gpu").alias("system")).agg(F.max("o_totalprice").alias("ms"))
    t = t.filter(~((F.col("algo") == "O") & (F.col("system") == "gpu")))
    r = compare.timing_report(t)
    return r.select("algo", "graph", F.round("cpu", 4).alias("cpu"), F.round("gpu", 4).alias("gpu"), F.round("ratio", 6).alias("ratio"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    a, p = algorithms, primitives
    return {
        "bfs_part": lambda s, d: a.bfs(part_flow(s, d), 0),
        "bfs_trade_unreached": lambda s, d: a.bfs(trade(s, d).symmetrize(), 517),
        "bfs_max_degree": lambda s, d: a.bfs(part_flow(s, d)),
        "bfs_multi_source": lambda s, d: a.bfs(trade(s, d).symmetrize(), [3, 517, 40]),
        "bfs_engine": engine_bfs,
        "sssp_part": lambda s, d: a.sssp(part_flow(s, d), 0),
        "sssp_undirected": lambda s, d: a.sssp(trade(s, d), 517, directed=False),
        "sssp_unreached": lambda s, d: a.sssp(trade(s, d), 517),
        "cc_trade_sym": lambda s, d: a.components(trade(s, d).symmetrize()),
        "cc_trade_undirected": lambda s, d: a.components(trade(s, d), undirected=True),
        "cc_directed_min_label": lambda s, d: a.components(trade(s, d)),
        "pagerank_frontier": lambda s, d: _rounded(a.pagerank(part_flow(s, d))),
        "pagerank_fixed10": lambda s, d: _rounded(a.pagerank_fixed(part_flow(s, d), 10)),
        "pagerank_tol": lambda s, d: _rounded(a.pagerank(part_flow(s, d), tol=0.05, strict=True)),
        "pagerank_delta": lambda s, d: _rounded(a.pagerank_delta(part_flow(s, d), tol=1e-4)),
        "out_degree": lambda s, d: part_flow(s, d).out_degrees(),
        "in_degree": lambda s, d: trade(s, d).in_degrees(),
        "max_out_degree": lambda s, d: s.range(1).select(F.lit(part_flow(s, d).max_out_degree_vertex()).cast("long").alias("id")),
        "csr_offsets": lambda s, d: part_flow(s, d).csr_offsets(),
        "csc_offsets": lambda s, d: trade(s, d).csc_offsets(),
        "csr_neighbours": lambda s, d: trade(s, d).csr().select("id", F.array_join("neighbours", ",").alias("neighbours")),
        "csr_positions": lambda s, d: nation_trade(s, d).ordered_edges(),
        "symmetrize": lambda s, d: trade(s, d).symmetrize().edges,
        "drop_self_loops": lambda s, d: Graph(s.range(1), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") - F.col("c_custkey") % 3).alias("dst"))).without_self_loops().edges,
        "collapse_parallel_edges": lambda s, d: part_flow(s, d).collapse("w").edges,
        "replicate_disjoint": lambda s, d: nation_trade(s, d).replicate(3).edges,
        "disjoint_union": lambda s, d: Graph.disjoint_union([(nation_trade(s, d), 2), (trade(s, d), 1)]).edges,
        "gather_min": gather_min,
        "gather_sum": gather_sum,
        "gather_zero_no_in_edges": gather_zero,
        "apply_changed": apply_changed,
        "activate_frontier": activate_frontier,
        "scatter_edge_update": scatter_edge_update,
        "set_active_range": set_active_range,
        "apply_without_gather": apply_without_gather,
        "sssp_gather_form": sssp_gather_form,
        "bfs_sources_and_max_degree": lambda s, d: a.bfs(trade(s, d).symmetrize(), [3, 517, None]),
        "in_degree_part": lambda s, d: part_flow(s, d).in_degrees(),
        "csc_offsets_part": lambda s, d: part_flow(s, d).csc_offsets(),
        "csc_neighbours": lambda s, d: trade(s, d).csc().select("id", F.array_join("neighbours", ",").alias("neighbours")),
        "symmetrize_part": lambda s, d: part_flow(s, d).symmetrize().edges,
        "cc_part_undirected": lambda s, d: a.components(part_flow(s, d), undirected=True),
        "by_edges": lambda s, d: p.by_edges(part_flow(s, d).edges, "src", 8, salt=4),
        "tolerant_diff": tolerant_diff,
        "edges_with_blanks_gz": edges_with_blanks_gz,
        "converted": converted,
        "replicated_files": replicated_files,
        "sharded_results": sharded_results,
        "weighted_at_random": weighted_at_random,
        "exclusive_scan": lambda s, d: p.exclusive_scan(part_flow(s, d).out_degrees(), "id", "degree").select("id", "scan"),
        "reduce_by_key": lambda s, d: p.reduce_by_key(part_flow(s, d).edges, "dst", "w", "max"),
        "gather_counts": lambda s, d: p.gather_counts(trade(s, d).in_degrees()),
        "scatter_counts": lambda s, d: p.scatter_counts(trade(s, d).out_degrees().withColumn("flag", F.col("id") % 2 == 0), "flag").select("id", F.col("n").cast("long").alias("n")),
        "interval_gather": interval_gather,
        "compact_if": lambda s, d: p.compact(part_flow(s, d).out_degrees(), F.col("degree") > 24),
        "unique_sorted": lambda s, d: p.unique_sorted(part_flow(s, d).edges, "dst"),
        "arg_sort": lambda s, d: p.arg_sort(trade(s, d).out_degrees(), "degree", "id").select("id", "position"),
        "check_distances": check_distances,
        "exact_diff": exact_diff,
        "rank_histogram": rank_histogram,
        "timing_report": timing_report,
        "edges_roundtrip": _round_trip("edges", False),
        "mtx_roundtrip": _round_trip("mtx", True),
        "gr_roundtrip": _round_trip("gr", True),
        "gr_offsets": gr_offsets,
        "result_lines": result_lines,
    }


def oracle_sql() -> dict[str, str]:
    deg = lambda end: f"SELECT v.id, count(e.{end}) AS degree FROM v LEFT JOIN e ON e.{end} = v.id GROUP BY v.id"
    offsets = lambda graph, end: f"WITH {graph}, d AS ({deg(end)} UNION ALL SELECT (SELECT max(id) + 1 FROM v), 0) SELECT id, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM d"
    fixed = lambda n, name: f"{name} AS ({_fixed_sql(PART, n).replace('round(rank, 6)', 'rank')})"
    bins = "CASE " + " ".join(f"WHEN x < {e} THEN {i}" for i, e in enumerate(compare.BIN_EDGES)) + f" ELSE {len(compare.BIN_EDGES)} END"
    return {
        "bfs_part": _bfs_sql(PART, ZERO),
        "bfs_trade_unreached": _bfs_sql(TRADE, "SELECT 517 AS id", "y"),
        "bfs_max_degree": _bfs_sql(PART, MAX_DEGREE),
        "bfs_multi_source": _bfs_sql(TRADE, "SELECT unnest([3, 517, 40]) AS id", "y"),
        "bfs_engine": _bfs_sql(PART, ZERO),
        "sssp_part": _sssp_sql(PART, ZERO),
        "sssp_undirected": _sssp_sql(TRADE, "SELECT 517 AS id", "y"),
        "sssp_unreached": _sssp_sql(TRADE, "SELECT 517 AS id"),
        "cc_trade_sym": _cc_sql(TRADE, "y"),
        "cc_trade_undirected": _cc_sql(TRADE, "y"),
        "cc_directed_min_label": _cc_sql(TRADE, "e"),
        "pagerank_frontier": _rank_sql(PART, "abs(st.new - st.old) >= 0.01"),
        "pagerank_fixed10": _fixed_sql(PART, 10),
        "pagerank_tol": _rank_sql(PART, "abs(st.new - st.old) > 0.05"),
        "out_degree": f"WITH {PART} {deg('src')}",
        "in_degree": f"WITH {TRADE} {deg('dst')}",
        "max_out_degree": f"WITH {PART}, {OUTDEG} {MAX_DEGREE}",
        "csr_offsets": offsets(PART, "src"),
        "csc_offsets": offsets(TRADE, "dst"),
        "csr_neighbours": f"WITH {TRADE} SELECT v.id, coalesce(string_agg(CAST(e.dst AS VARCHAR), ',' ORDER BY e.dst), '') AS neighbours FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id",
        "csr_positions": f"WITH {NATION} SELECT src, dst, w, row_number() OVER (ORDER BY src, dst) - 1 AS position FROM e",
        "symmetrize": f"WITH {TRADE}, {BOTH} SELECT src, dst, w FROM y",
        "drop_self_loops": "SELECT c_custkey AS src, c_custkey - c_custkey % 3 AS dst FROM customer WHERE c_custkey % 3 <> 0",
        "collapse_parallel_edges": f"WITH {PART} SELECT src, dst, min(w) AS w FROM e GROUP BY src, dst",
        "replicate_disjoint": f"WITH {NATION} SELECT src + 25 * k AS src, dst + 25 * k AS dst, w FROM e, (SELECT unnest(range(3)) AS k)",
        "disjoint_union": f"WITH {TRADE}, n AS (WITH {NATION} SELECT src, dst FROM e) SELECT src + 25 * k AS src, dst + 25 * k AS dst FROM n, (SELECT unnest(range(2)) AS k) UNION ALL SELECT src + 50, dst + 50 FROM e",
        "gather_min": f"WITH {PART} SELECT dst AS id, min(src) AS acc FROM e GROUP BY dst",
        "gather_sum": f"WITH {PART} SELECT dst AS id, CAST(sum(w + dst - src) AS BIGINT) AS acc FROM e GROUP BY dst",
        "gather_zero_no_in_edges": f"WITH {TRADE} SELECT v.id, CAST(coalesce(max(e.w), -7) AS INTEGER) AS top FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id",
        "apply_changed": f"WITH {PART}, g AS (SELECT dst AS id, min(src) AS acc FROM e GROUP BY dst) SELECT v.id, CASE WHEN v.id < (SELECT count(*) // 2 FROM v) THEN least(v.id, acc) ELSE v.id END AS label, coalesce(v.id < (SELECT count(*) // 2 FROM v) AND acc < v.id, FALSE) AS changed FROM v LEFT JOIN g ON g.id = v.id",
        "activate_frontier": f"WITH {PART}, c AS (SELECT dst AS id FROM e WHERE dst < (SELECT count(*) // 100 FROM v) GROUP BY dst HAVING min(src) < dst) SELECT DISTINCT e.dst AS id FROM e JOIN c ON c.id = e.src",
        "scatter_edge_update": f"WITH {NATION}, s AS (SELECT n AS id, least(n, coalesce(min(e.src), n)) AS label, coalesce(min(e.src) < n, FALSE) AS changed FROM (SELECT CAST(unnest(range(25)) AS BIGINT) AS n) LEFT JOIN e ON e.dst = n GROUP BY n) SELECT src, dst, CAST(CASE WHEN a.changed THEN w + a.label - b.label ELSE w END AS INTEGER) AS w FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst",
        "set_active_range": f"WITH {PART} SELECT id FROM v WHERE id BETWEEN 10 AND 39",
        "apply_without_gather": f"WITH {TRADE}, n AS (SELECT count(*) // 2 AS half FROM v) SELECT id, CASE WHEN id < half THEN id * 2 ELSE id END AS label, id < half AND id % 2 = 1 AS changed FROM v, n",
        "sssp_gather_form": _sssp_sql(PART, ZERO),
        "bfs_sources_and_max_degree": _bfs_sql(TRADE, "SELECT unnest([3, 517]) AS id UNION SELECT id FROM (SELECT v.id, count(y.src) AS n FROM v LEFT JOIN y ON y.src = v.id GROUP BY v.id ORDER BY n DESC, v.id LIMIT 1)", "y"),
        "in_degree_part": f"WITH {PART} {deg('dst')}",
        "csc_offsets_part": offsets(PART, "dst"),
        "csc_neighbours": f"WITH {TRADE} SELECT v.id, coalesce(string_agg(CAST(e.src AS VARCHAR), ',' ORDER BY e.src), '') AS neighbours FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id",
        "symmetrize_part": f"WITH {PART}, {BOTH} SELECT src, dst, w FROM y",
        "cc_part_undirected": _cc_sql(PART, "y"),
        "by_edges": f"WITH {PART} SELECT src, dst, w FROM e",
        "tolerant_diff": f"WITH {fixed(4, 'g')}, {fixed(3, 't')} SELECT id, round(g.rank, 6) AS \"left\", round(t.rank, 6) AS \"right\" FROM g JOIN t USING (id) WHERE abs(g.rank - t.rank) > 0.01",
        "edges_with_blanks_gz": f"WITH {NATION} SELECT src, dst FROM e",
        "converted": f"WITH {NATION} SELECT src, dst, w FROM e",
        "replicated_files": f"WITH {NATION} SELECT src + 25 * k AS src, dst + 25 * k AS dst FROM e, (SELECT unnest(range(3)) AS k)",
        "sharded_results": f"WITH {TRADE}, d AS ({deg('dst')}) SELECT concat(id, chr(9), degree) AS value FROM d",
        "weighted_at_random": f"WITH {PART} SELECT src, dst, TRUE AS within FROM e",
        "pagerank_delta": _delta_sql(PART, 1e-4),
        "exclusive_scan": f"WITH {PART}, d AS ({deg('src')}) SELECT id, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM d",
        "reduce_by_key": f"WITH {PART} SELECT dst, max(w) AS value FROM e GROUP BY dst",
        "gather_counts": f"WITH {TRADE}, d AS ({deg('dst')}) SELECT id, greatest(degree, 1) AS n FROM d",
        "scatter_counts": f"WITH {TRADE}, d AS ({deg('src')}) SELECT id, CAST(CASE WHEN id % 2 = 0 THEN degree ELSE 0 END AS BIGINT) AS n FROM d",
        "interval_gather": f"WITH {PART} SELECT src, dst, w FROM e WHERE src < (SELECT count(*) // 2 FROM v)",
        "compact_if": f"WITH {PART}, d AS ({deg('src')}) SELECT id FROM d WHERE degree > 24",
        "unique_sorted": f"WITH {PART} SELECT DISTINCT dst FROM e ORDER BY dst",
        "arg_sort": f"WITH {TRADE}, d AS ({deg('src')}) SELECT id, row_number() OVER (ORDER BY degree, id) - 1 AS position FROM d",
        "check_distances": f"WITH s AS ({_sssp_sql(TRADE, 'SELECT 517 AS id')}) SELECT id, CAST(5 AS BIGINT) AS gold, dist AS test FROM s WHERE id = 517 AND dist <> 5",
        "exact_diff": f"WITH l AS ({_bfs_sql(TRADE, 'SELECT 517 AS id')}), r AS ({_bfs_sql(TRADE, 'SELECT 517 AS id', 'y')}) SELECT l.id, l.depth AS \"left\", r.depth AS \"right\" FROM l JOIN r ON l.id = r.id WHERE l.depth <> r.depth",
        "rank_histogram": f"WITH {fixed(4, 'g')}, {fixed(3, 't')}, h AS (SELECT {bins} AS bin, count(*) AS n FROM (SELECT abs(g.rank - t.rank) AS x FROM g JOIN t ON g.id = t.id) GROUP BY 1), k AS (SELECT bin, n, n / CAST((SELECT sum(n) FROM h) AS DOUBLE) AS share, CAST({compare.ALLOWED_SHARES}[bin + 1] AS DOUBLE) AS allowed FROM h) SELECT CAST(bin AS INTEGER) AS bin, n, round(share, 6) AS share, allowed, share <= allowed AS ok FROM k",
        "timing_report": "WITH t AS (SELECT o_orderstatus AS algo, o_orderpriority AS graph, max(o_totalprice) FILTER (WHERE o_custkey % 2 = 0) AS c, CASE WHEN o_orderstatus <> 'O' THEN max(o_totalprice) FILTER (WHERE o_custkey % 2 <> 0) END AS g FROM orders GROUP BY 1, 2) SELECT algo, graph, round(coalesce(c, -1), 4) AS cpu, round(coalesce(g, -1), 4) AS gpu, round(CASE WHEN c IS NOT NULL AND g > 0 THEN c / g ELSE -1 END, 6) AS ratio FROM t",
        "edges_roundtrip": f"WITH {NATION} SELECT src, dst FROM e",
        "mtx_roundtrip": f"WITH {NATION} SELECT src, dst, w FROM e",
        "gr_roundtrip": f"WITH {NATION} SELECT src, dst, w FROM e",
        "gr_offsets": f"WITH {NATION}, d AS (SELECT n AS id, count(e.src) AS c FROM (SELECT CAST(unnest(range(26)) AS BIGINT) AS n) LEFT JOIN e ON e.src = n GROUP BY n) SELECT id, CAST(coalesce(sum(c) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM d",
        "result_lines": f"WITH v AS (SELECT CAST(unnest(range(25)) AS BIGINT) AS id), {NATION}, r AS ({_fixed_sql(NATION + ', v AS (SELECT CAST(unnest(range(25)) AS BIGINT) AS id)', 3).replace('round(rank, 6)', 'rank')}) SELECT concat(id, ' ', printf('%.6f', rank)) AS value FROM r",
    }
