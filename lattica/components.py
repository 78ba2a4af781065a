"""Connected components of large sparse graphs: alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _settled(df: DataFrame, folder: str | None, files: int | None) -> DataFrame:
    df = df if files is None else df.coalesce(files)
    if folder is None:
        return df.checkpoint()
    path = f"{folder}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", folder: str | None = None, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(id, component) of every vertex that an edge names; component is the least id reachable, edges taken both ways.

    Each round links every vertex to the least vertex of its neighbourhood (large star: from the larger side;
    small star: from the smaller side), so paths halve and a graph of n vertices needs about log n rounds. A neighbourhood
    is never gathered: its minimum is an aggregation with map-side combining, joined back to the edges. The rounds end
    when the edges have become stars, seen from a count and a checksum. ``folder`` is a shared place for the
    intermediate tables; without it they are checkpoints. Self loops name a vertex without linking it. ``rows``, where known, is how many edges there are at
    most; a small graph then isn't written as one file for each shuffle partition.
    """
    files = None if rows is None else max(4, rows // 50_000)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    names = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    cur, mark = _settled(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, files), None
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # large: every larger neighbour of u is linked with the least vertex around u
        down = large.filter("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        star = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        cur = _settled(star.filter("u > v").distinct(), folder, files)
        got = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if got == mark:
            break
        mark = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return names.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
