"""Command line: ``python -m lattica.cli bfs [-t] [-d] [-m] INPUT SOURCE [OUT]`` and so on."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import algorithms, compare, plain
from lattica.engine import Engine
from lattica.graph import Graph
from lattica.sources import convert, read_graph, write_results
from lattica.sources.dispatch import replicate_files

VALUES = {"bfs": "depth", "sssp": "dist", "connected_component": "label", "pagerank": "rank"}


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lattica")
    sub = p.add_subparsers(dest="command", required=True)
    for name in VALUES:
        c = sub.add_parser(name)
        c.add_argument("-t", dest="test", action="store_true", help="compare with a second way of computing")
        c.add_argument("-d", dest="dump", action="store_true", help="print the result")
        if name in ("bfs", "sssp"):
            c.add_argument("-m", dest="max_degree", action="store_true", help="start at the vertex of most out-edges")
        c.add_argument("input")
        if name in ("bfs", "sssp"):
            c.add_argument("source", type=int)
        if name == "sssp":
            c.add_argument("--undirected", action="store_true")
        if name == "pagerank":
            c.add_argument("--tol", type=float, default=algorithms.TOLERANCE)
            c.add_argument("--iterations", type=int)
        c.add_argument("output", nargs="?")
    c = sub.add_parser("convert")
    c.add_argument("input")
    c.add_argument("output")
    c = sub.add_parser("replicate")
    c.add_argument("parts", nargs="+", help="INPUT COPIES [INPUT COPIES ...] OUTPUT")
    return p.parse_args(argv)


def _second_way(name: str, graph: Graph, args: argparse.Namespace, source: int | None) -> DataFrame:
    """The result by full steps of the engine (BFS) or by plain rounds without it."""
    if name == "bfs":
        engine = Engine(graph, algorithms.bfs_program(), graph.vertices.select("id", F.lit(algorithms.UNREACHED_DEPTH).alias("depth")))
        engine.set_active(source, source + 1)
        return engine.run()
    if name == "pagerank":
        return plain.pagerank(graph, args.tol, args.iterations)
    return plain.sssp(graph, source, directed=not args.undirected) if name == "sssp" else plain.min_labels(graph)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments(argv)
    spark = spark or SparkSession.builder.appName("lattica").getOrCreate()
    if args.command == "convert":
        convert(spark, args.input, args.output)
        return 0
    if args.command == "replicate":
        if len(args.parts) % 2 == 0:
            print("replicate needs INPUT COPIES pairs and OUTPUT", file=sys.stderr)
            return 2
        pairs = [(args.parts[i], int(args.parts[i + 1])) for i in range(0, len(args.parts) - 1, 2)]
        replicate_files(spark, pairs, args.parts[-1])
        return 0
    name, value = args.command, VALUES[args.command]
    graph = read_graph(spark, args.input, values=name == "sssp")
    source = None
    if name in ("bfs", "sssp"):
        source = graph.max_out_degree_vertex() if args.max_degree else args.source
    began = time.perf_counter()
    if name == "bfs":
        result = algorithms.bfs(graph, source)
    elif name == "sssp":
        result = algorithms.sssp(graph, source, directed=not args.undirected)
    elif name == "connected_component":
        result = algorithms.components(graph)
    else:
        result = algorithms.pagerank_fixed(graph, args.iterations) if args.iterations else algorithms.pagerank(graph, args.tol)
    result.count()
    print(f"Took {(time.perf_counter() - began) * 1000:f} ms")
    if args.dump:
        for r in result.orderBy("id").toLocalIterator():
            print(f"{r['id']}\t{r[value]}")
    if args.output:
        write_results(result, value, args.output)
    if args.test:
        other = _second_way(name, graph, args, source)
        diff = compare.tolerant_diff(result, other, value) if value == "rank" else compare.exact_diff(result, other, value)
        if not diff.isEmpty():
            for r in diff.toLocalIterator():
                print(*r, sep="\t")
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
