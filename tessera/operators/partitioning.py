"""Placement of a matrix's cells over partitions, by block row, block column or a 2-D cyclic grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _block(col: str, size: int):
    return F.expr(f"{col} div {size}")


def by_row(df: DataFrame, parts: int, size: int = 1) -> DataFrame:
    return df.repartition(parts, _block("i", size))


def by_column(df: DataFrame, parts: int, size: int = 1) -> DataFrame:
    return df.repartition(parts, _block("j", size))


def by_index(df: DataFrame, parts: int, index) -> DataFrame:
    """Partition ``index % parts`` for every row, where index is a Column."""
    return df.repartitionById(parts, F.pmod(index, F.lit(parts)).cast("int"))


def grid_shape(row_blocks: int, col_blocks: int, parts: int = 64) -> tuple[int, int]:
    """A near-square grid of at most ``parts`` cells, never wider or taller than the matrix has blocks."""
    rows = max(1, min(row_blocks, math.isqrt(parts)))
    cols = max(1, min(col_blocks, parts // rows))
    return max(1, min(row_blocks, parts // cols)), cols


def block_cyclic(df: DataFrame, shape: tuple[int, int], size: int, parts: int = 64) -> DataFrame:
    """Block (r, c) goes to grid cell (r mod rows, c mod columns)."""
    rows, cols = grid_shape(-(-shape[0] // size), -(-shape[1] // size), parts)
    return by_index(df, rows * cols, F.pmod(_block("i", size), F.lit(rows)) * cols + F.pmod(_block("j", size), F.lit(cols)))
