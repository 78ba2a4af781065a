import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

import oracle
from lattica import algorithms as alg
from lattica import cli, compare, primitives
from lattica.components import connected_components
from lattica.engine import Engine, VertexProgram
from lattica.graph import Graph
from lattica.sources import convert, graph_format, read_graph, write_graph, write_results
from lattica.sources.binary import read_binary_offsets
from lattica.sources.dispatch import random_weights, replicate_files
from lattica.sources.synthetic import power_law

SMALL = [(0, 1, 1), (0, 2, 4), (0, 3, 1), (1, 4, 1), (2, 1, 1), (2, 4, 1), (2, 5, 1), (3, 5, 1), (3, 6, 1), (4, 6, 1), (5, 6, 1)]
PATH = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 3, 1)]


def graph(spark, edges, n=None):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, w int"), n)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_small_graph(spark):
    g = graph(spark, SMALL)
    assert column(g.out_degrees(), "degree") == [3, 1, 3, 2, 1, 1, 0]
    assert column(g.in_degrees(), "degree") == [0, 2, 1, 1, 2, 2, 3]
    assert column(g.csr_offsets(), "offset") == [0, 3, 4, 7, 9, 10, 11, 11]
    assert column(g.csc_offsets(), "offset") == [0, 0, 2, 3, 4, 6, 8, 11]
    assert column(g.csr(), "neighbours")[2] == [1, 4, 5] and column(g.csc(), "neighbours")[0] == []
    assert g.max_out_degree_vertex() == 0
    assert column(alg.bfs(g, 0), "depth") == [0, 1, 1, 1, 2, 2, 2]
    assert column(alg.sssp(g, 0), "dist") == [0, 1, 4, 1, 2, 2, 2]
    assert column(alg.components(g), "label") == [0] * 7
    assert [round(x, 6) for x in column(alg.pagerank(g), "rank")] == [0.15, 0.247042, 0.1925, 0.1925, 0.414527, 0.286354, 0.827562]


def test_frontier_sizes(spark):
    g = graph(spark, SMALL)
    e = Engine(g, alg.bfs_program(), g.vertices.select("id", F.lit(-1).alias("depth")))
    e.set_active(0, 1)
    assert column(e.run(), "depth") == [0, 1, 1, 1, 2, 2, 2] and e.frontier_sizes == [1, 3, 4, 1]
    ranks, sizes = oracle.pagerank(5, PATH)
    assert ranks == pytest.approx([0.15, 0.2775, 0.385875, 2.155984, 1.974106], abs=1e-6) and len(sizes) == 27


@pytest.mark.parametrize("sparse, bound", [(0.0, 10), (2.0, 10_000), (2.0, 0)])
def test_frontiers_of_all_kinds_run_the_same_steps(spark, monkeypatch, sparse, bound):
    monkeypatch.setattr("lattica.engine.BROADCAST_IDS", bound)
    r = random.Random(3)
    edges = [(r.randrange(30), r.randrange(40), 1) for _ in range(90)]
    g = graph(spark, edges, 40)
    program = VertexProgram(gather=lambda s, e, d: s.rank / s.outdeg, zero=0.0, apply=lambda v, acc, i: ({"rank": 0.15 + 0.85 * acc}, F.abs(0.15 + 0.85 * acc - v.rank) >= 0.01))
    e = Engine(g, program, g.out_degrees().select("id", F.lit(0.15).alias("rank"), F.col("degree").alias("outdeg")), sparse=sparse)
    e.set_active(0, 40)
    ranks, sizes = oracle.pagerank(40, edges)
    assert column(e.run(), "rank") == pytest.approx(ranks) and e.frontier_sizes == sizes


def test_parallel_edges_and_isolated_vertices(spark):
    g = graph(spark, [(0, 1, 1), (0, 1, 1), (0, 2, 1)])
    assert column(alg.pagerank(g), "rank")[1] == pytest.approx(0.235)
    g = graph(spark, [(0, 1, 1), (3, 4, 1)])
    assert column(alg.bfs(g, 0), "depth") == [0, 1, -1, -1, -1]
    assert column(alg.components(g), "label") == [0, 0, 2, 3, 3]
    assert column(alg.components(g, undirected=True), "label") == [0, 0, 2, 3, 3]
    assert column(alg.pagerank(g), "rank") == pytest.approx([0.15, 0.2775, 0.15, 0.15, 0.2775])


def test_random_graph(spark):
    r = random.Random(1)
    n = 30
    edges = [(r.randrange(n - 4), r.randrange(n - 4), r.randrange(9)) for _ in range(50)]
    edges = [e for e in edges if e[0] != e[1]] + [edges[0]] * 2
    g = graph(spark, edges, n)
    assert column(alg.bfs(g, [0, 5]), "depth") == oracle.bfs(n, edges, [0, 5])
    assert column(alg.sssp(g, 0), "dist") == oracle.sssp(n, edges, 0)
    both = edges + [(d, s, w) for s, d, w in edges]
    assert column(alg.sssp(g, 0, directed=False), "dist") == oracle.sssp(n, both, 0)
    assert column(alg.components(g), "label") == oracle.min_labels(n, edges)
    assert column(alg.components(g, undirected=True), "label") == oracle.min_labels(n, both)
    assert column(alg.pagerank(g), "rank") == pytest.approx(oracle.pagerank(n, edges)[0], abs=1e-9)
    assert column(alg.pagerank_delta(g, 1e-3), "rank") == pytest.approx(column(alg.pagerank_fixed(g, 30), "rank"), abs=0.1)


def test_long_chain_components(spark):
    e = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in connected_components(e).collect()} == {0}
    assert connected_components(e.limit(0)).count() == 0


def test_weights_are_checked(spark):
    g = graph(spark, SMALL)
    with pytest.raises(ValueError):
        alg.sssp(Graph(g.vertices, g.edges.drop("w")), 0)
    with pytest.raises(ValueError):
        alg.sssp(graph(spark, [(0, 1, -1)]), 0)
    with pytest.raises(RuntimeError):
        alg.pagerank(graph(spark, PATH), max_iter=3)
    assert column(alg.sssp(Graph(g.vertices, g.edges.drop("w")), 0, default_weight=1), "dist") == [0, 1, 1, 1, 2, 2, 2]


def test_scatter_changes_edges_of_changed_vertices(spark):
    g = graph(spark, SMALL)
    p = VertexProgram(gather=lambda s, e, d: s.label, reduce="min", apply=lambda v, acc, i: ({"label": F.least(v.label, acc)}, acc < v.label), scatter=lambda s, e, d: {"w": e.w + 100})
    e = Engine(g, p, g.vertices.select("id", F.col("id").alias("label")))
    e.set_active(g.vertices)
    e.gather_apply()
    e.scatter_activate()
    assert {(r.src, r.dst): r.w for r in e.edges.collect()} == {(s, d): w + 100 * (s > 0) for s, d, w in SMALL}


def test_matrix_market(spark, tmp_path):
    p = str(tmp_path / "a.mtx")
    with open(p, "w") as f:
        f.write("%%MatrixMarket matrix coordinate Integer symmetric\n% c\n\n4 4 4\n1 2 2.9\n2 2 7\n3 1 5\n2 1 1\n")
    g = read_graph(spark, p, values=True)
    assert sorted((r.src, r.dst, r.w) for r in g.edges.collect()) == [(0, 1, 1), (0, 1, 2), (0, 2, 5), (1, 0, 1), (1, 0, 2), (2, 0, 5)]
    assert g.vertices.count() == 3 and column(alg.sssp(g, 0), "dist") == [0, 1, 5]
    with gzip.open(p + ".gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n1 2 3\n")
    assert sorted(tuple(r) for r in read_graph(spark, p + ".gz", values=True).edges.collect()) == [(0, 1, 3), (1, 0, -3)]
    for head in ("array real general", "coordinate complex general", "coordinate real odd"):
        q = str(tmp_path / f"{abs(hash(head))}.mtx")
        with open(q, "w") as f:
            f.write(f"%%MatrixMarket matrix {head}\n1 1 1\n1 1 1\n")
        with pytest.raises(ValueError):
            read_graph(spark, q)


def test_edge_lists(spark, tmp_path):
    p = str(tmp_path / "a.edges")
    with open(p, "w") as f:
        f.write("# c\n0 1\n5 5\n")
    g = read_graph(spark, p)
    assert g.vertices.count() == 6 and g.edges.count() == 1
    with open(p + "x", "w") as f:
        f.write("1 x\n")
    with pytest.raises(Exception, match="error parsing edge line: 1 x"):
        read_graph(spark, p + "x").edges.collect()
    with pytest.raises(FileNotFoundError):
        read_graph(spark, str(tmp_path / "none.edges"))
    assert [graph_format(x) for x in ("a.edges", "a.mtx.gz", "a.graph")] == ["edges", "mtx", "gr"]
    with pytest.raises(ValueError):
        graph_format("a.txt")


def test_binary_round_trip(spark, tmp_path):
    p, q = str(tmp_path / "a.gr"), str(tmp_path / "a.mtx")
    write_graph(graph(spark, PATH), p)
    with open(p, "rb") as f:
        raw = f.read()
    assert raw == struct.pack("<4Q", 1, 4, 5, 5) + struct.pack("<5Q", 1, 2, 3, 4, 5) + struct.pack("<6I", 1, 2, 3, 4, 3, 0) + struct.pack("<5I", *[1] * 5)
    assert column(read_binary_offsets(spark, p), "offset") == [0, 1, 2, 3, 4, 5]
    with gzip.open(p + ".gz", "wb") as f:
        f.write(raw)
    assert sorted(tuple(r) for r in read_graph(spark, p + ".gz", values=True).edges.collect()) == PATH
    convert(spark, p, q)
    assert sorted(tuple(r) for r in read_graph(spark, q, values=True).edges.collect()) == PATH
    with open(q) as f:
        assert f.readline() == "%%MatrixMarket matrix coordinate integer general\n"
    r = str(tmp_path / "r.edges")
    replicate_files(spark, [(q, 2), (p, 1)], r)
    assert read_graph(spark, r).edges.count() == 15 and read_graph(spark, r).vertices.count() == 15


def test_results_and_comparison(spark, tmp_path):
    a = spark.createDataFrame([(0, 5), (1, 10000000), (2, 7)], "id long, dist long")
    b = spark.createDataFrame([(0, 5), (1, 2147383647), (2, 8)], "id long, dist long")
    assert [r.id for r in compare.check_distances(a, b, "dist").collect()] == [2]
    assert compare.check_distances(a, b.filter("id < 2"), "dist").count() == 1
    assert sorted(r.id for r in compare.exact_diff(a, b, "dist").collect()) == [1, 2]
    ranks = spark.range(100).withColumn("rank", F.lit(1.0))
    off = ranks.withColumn("rank", F.when(F.col("id") < 2, 1.0005).otherwise(1.0))
    assert compare.check_ranks(ranks, ranks) and not compare.check_ranks(ranks, off)
    assert compare.tolerant_diff(ranks, off, "rank").count() == 2
    t = spark.createDataFrame([("bfs", "g", "cpu", 8.0), ("bfs", "g", "gpu", 2.0), ("cc", "g", "cpu", 1.0)], "algo string, graph string, system string, ms double")
    assert sorted(tuple(r) for r in compare.timing_report(t).collect()) == [("bfs", "g", 8.0, 2.0, 4.0), ("cc", "g", 1.0, -1.0, -1.0)]
    write_results(ranks.limit(2), "rank", str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).orderBy("value").collect()] == ["0 1.000000", "1 1.000000"]


def test_primitives_and_synthetic(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(20)], "id long, degree long")
    assert column(primitives.exclusive_scan(d, "id", "degree"), "scan") == [sum(j % 3 for j in range(i)) for i in range(20)]
    assert primitives.scan_total(d, "degree") == 19
    assert column(primitives.arg_sort(d, "degree", "id"), "position")[:4] == [0, 7, 14, 1]
    assert primitives.by_edges(d, "id", 4, salt=2).count() == 20
    g = power_law(spark, 500, 2.0)
    degrees = sorted(column(g.out_degrees(), "degree"))
    assert degrees[250] <= 3 and degrees[-1] > 20
    assert random_weights(g).edges.agg(F.max("w")).first()[0] <= 100


def test_command_line(spark, tmp_path, capsys):
    p, out = str(tmp_path / "g.mtx"), str(tmp_path / "o")
    write_graph(graph(spark, SMALL), p)
    assert cli.main(["bfs", "-t", "-m", p, "0", out], spark) == 0
    assert cli.main(["sssp", "-t", p, "0"], spark) == 0
    assert cli.main(["pagerank", "-d", p], spark) == 0
    assert cli.main(["connected_component", p], spark) == 0
    assert cli.main(["convert", p, str(tmp_path / "g.gr")], spark) == 0
    assert "Took" in capsys.readouterr().out
    assert [r.value for r in spark.read.text(out).orderBy("value").collect()][:2] == ["0 0", "1 1"]


def test_second_way_is_another_one_and_ids_without_gold_count(spark, tmp_path, monkeypatch):
    from lattica import algorithms, cli, compare

    p = str(tmp_path / "g.edges")
    with open(p, "w") as f:
        f.write("0 1\n1 2\n2 0\n3 4\n4 2\n")
    for name in ("pagerank", "connected_component"):
        assert cli.main([name, "-t", p], spark) == 0
    wrong = algorithms.components
    monkeypatch.setattr(algorithms, "components", lambda g: wrong(g).withColumn("label", F.col("label") + 1))
    assert cli.main(["connected_component", "-t", p], spark) == 1
    gold = spark.range(100).select("id", F.lit(1.0).alias("rank"))
    test = spark.range(300).select("id", F.when(F.col("id") < 2, 1.0005).otherwise(1.0).alias("rank"))
    assert not compare.check_ranks(gold, test.filter("id < 100")) and compare.check_ranks(gold, test) == compare.check_ranks(gold, test)
    assert compare.rank_histogram(gold, test).agg(F.sum("share")).first()[0] == pytest.approx(1 / 3)
