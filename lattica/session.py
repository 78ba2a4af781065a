"""Session helpers: the shared folder, intermediate tables, and the package on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: The folder of each table that ``settled`` made, until ``released`` deletes it.
_folders: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode an own one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends here and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[id(out)] = (out, path)
    return out


def is_settled(df: DataFrame) -> bool:
    """Whether ``df`` is a table of ``settled`` that hasn't been deleted."""
    return id(df) in _folders


def released(*tables: DataFrame) -> None:
    """Delete tables of ``settled`` that nothing reads any more; others are left alone."""
    for df in tables:
        _, path = _folders.pop(id(df), (None, None))
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so Python workers find it wherever they start."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/lattica", "zip", os.path.dirname(here), os.path.basename(here)))
