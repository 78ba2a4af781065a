"""Single files on any Hadoop file system, written as a stream from the driver a chunk at a time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def write_stream(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """Write the chunks as one file; holds one chunk."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for chunk in chunks:
            stream.write(bytearray(chunk))
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
