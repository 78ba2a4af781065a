"""Vertex results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(result: DataFrame, value: str, sep: str = " ") -> DataFrame:
    """``id value`` lines; doubles with six decimals."""
    v = F.format_string("%.6f", F.col(value)) if dict(result.dtypes)[value] in ("double", "float") else F.col(value).cast("string")
    return result.select("id", F.concat_ws(sep, F.col("id").cast("string"), v).alias("value"))


def write_results(result: DataFrame, value: str, path: str, sharded: bool = False) -> None:
    """``id value`` lines in ascending order, or tab-separated in any order (``sharded``: no sort); a folder of part files."""
    if sharded:
        lines(result, value, "\t").select("value").write.text(path)
    else:
        lines(result, value).orderBy("id").select("value").write.text(path)
