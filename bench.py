"""Times the headline graph algorithms; prints one JSON line. Edges are written first and reported apart as ``load``."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lattica import algorithms as alg
    from lattica.datasets import part_flow, trade
    from lattica.graph import Graph
    from lattica.session import settled

    seconds: dict[str, float] = {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        if hasattr(out, "count"):
            out.count()
        seconds[name] = round(time.perf_counter() - began, 3)
        return out

    def load(make):
        g = make(spark, sf_dir)
        return Graph(settled(g.vertices, "vertices"), settled(g.edges, "edges"))

    part = timed("load_part", lambda: load(part_flow))
    sparse = timed("load_trade", lambda: load(trade))
    timed("bfs_part", lambda: alg.bfs(part, 0))
    timed("sssp_part", lambda: alg.sssp(part, 0))
    timed("pagerank_frontier", lambda: alg.pagerank(part))
    timed("pagerank_fixed10", lambda: alg.pagerank_fixed(part, 10))
    timed("cc_trade", lambda: alg.components(sparse.symmetrize()))
    timed("cc_trade_undirected", lambda: alg.components(sparse, undirected=True))
    total = sum(v for k, v in seconds.items() if not k.startswith("load"))
    print(json.dumps({"metric": "graph algorithms, loop time", "value": round(total, 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
