"""Running sums over a stream of cells ``i, j, v`` (deltas add up, as in a coordinate list)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_row_sum(cells: DataFrame) -> DataFrame:
    """Row sums so far; write in update or complete mode."""
    return cells.groupBy("i").agg(F.sum("v").alias("v")).select("i", F.lit(0).cast("bigint").alias("j"), "v")


def running_col_sum(cells: DataFrame) -> DataFrame:
    return cells.groupBy("j").agg(F.sum("v").alias("v")).select(F.lit(0).cast("bigint").alias("i"), "j", "v")


def running_cells(cells: DataFrame) -> DataFrame:
    """The matrix so far, one row per cell."""
    return cells.groupBy("i", "j").agg(F.sum("v").alias("v"))
