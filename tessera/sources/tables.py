"""Sources that wrap existing data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..plans.expr import ShapeError, Source


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_coo(df: DataFrame, i="i", j="j", v="v", shape: tuple[int, int] | None = None, unique: bool = False, keep_zeros: bool = False, dense: bool = False) -> Matrix:
    """Coordinates and values. Duplicates are summed and zeros left out, as a coordinate list means;
    ``unique`` promises there are no duplicates and saves the aggregation. Rows with a null are
    ignored. Without ``shape`` one pass finds the largest indices."""
    d = df.select(_col(i).cast("bigint").alias("i"), _col(j).cast("bigint").alias("j"), _col(v).cast("double").alias("v")).dropna()
    if shape is None:
        top = d.agg(F.max("i"), F.max("j"), F.min(F.least("i", "j"))).first()
        if top[2] is not None and top[2] < 0:
            raise ShapeError("negative index")
        shape = tuple(0 if x is None else x + 1 for x in top[:2])
    if not unique:
        d = d.groupBy("i", "j").agg(F.sum("v").alias("v"))
    if not keep_zeros and not dense:
        d = d.filter("v <> 0 or isnan(v)")
    return Matrix(df.sparkSession, Source(d, tuple(shape), dense))


def from_rows(df: DataFrame, index: str | Column, values: str | Column, shape: tuple[int, int], dense: bool = False) -> Matrix:
    """One array of ncols numbers per row. A null number is zero; rows whose index or array is null are ignored; rows that
    repeat an index are summed. ``dense`` promises that every row of the matrix is there, once and without nulls."""
    number = "values" if dense else "transform(values, x -> coalesce(x, 0D))"
    rows = df.select(_col(index).cast("bigint").alias("i"), _col(values).cast("array<double>").alias("values")).dropna(subset=["i", "values"]).select("i", F.expr(number).alias("values"))
    cells = rows.select("i", F.posexplode("values").alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), "v")
    if not dense:
        return Matrix(df.sparkSession, Source(cells.groupBy("i", "j").agg(F.sum("v").alias("v")), tuple(shape)))
    return Matrix(df.sparkSession, Source(cells, tuple(shape), True, rows))


def _coordinates(spark: SparkSession, i, j, v) -> DataFrame:
    table = pa.table({"i": pa.array(np.asarray(i, np.int64).ravel()), "j": pa.array(np.asarray(j, np.int64).ravel()), "v": pa.array(np.asarray(v, np.float64).ravel())})
    return spark.createDataFrame(table, "i bigint, j bigint, v double")


def from_numpy(spark: SparkSession, a: np.ndarray, keep_zeros: bool = True) -> Matrix:
    a = np.asarray(a, dtype=np.float64)
    i, j = np.indices(a.shape)
    if not keep_zeros:
        i, j = np.nonzero(a)
    return Matrix(spark, Source(_coordinates(spark, i, j, a[i, j]), a.shape, keep_zeros))


def from_vector(spark: SparkSession, v, row: bool = False) -> Matrix:
    """A column (or a row) of the numbers of a ``pyspark.ml`` or ``pyspark.mllib`` vector or a sequence; only the active ones of a sparse vector."""
    if hasattr(v, "indices"):
        at, values, n = v.indices, v.values, v.size
    else:
        values = np.asarray(v.toArray() if hasattr(v, "toArray") else v, np.float64)
        at, n = np.arange(len(values)), len(values)
    zero, shape = np.zeros(len(at), np.int64), (1, n) if row else (n, 1)
    return Matrix(spark, Source(_coordinates(spark, zero if row else at, at if row else zero, values), shape, len(at) == n))


def from_ml(spark: SparkSession, m) -> Matrix:
    """A ``pyspark.ml.linalg`` or ``pyspark.mllib.linalg`` local matrix; stored zeros of a sparse one stay active."""
    if type(m).__name__ == "SparseMatrix":
        return from_sparse_arrays(spark, (m.numRows, m.numCols), m.colPtrs, m.rowIndices, m.values, by_row=bool(m.isTransposed))
    return from_numpy(spark, m.toArray())


def from_sparse_arrays(spark: SparkSession, shape: tuple[int, int], pointers, indices, values, by_row: bool = False) -> Matrix:
    """Compressed columns (or rows); stored zeros stay active."""
    major = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
    i, j = (major, indices) if by_row else (indices, major)
    return Matrix(spark, Source(_coordinates(spark, i, j, values), shape))


def from_parquet(spark: SparkSession, path: str, shape: tuple[int, int], dense: bool = False) -> Matrix:
    """What ``Matrix.write_parquet`` wrote; filters on i and j reach the scan."""
    return Matrix(spark, Source(spark.read.parquet(path).select("i", "j", "v"), tuple(shape), dense))
