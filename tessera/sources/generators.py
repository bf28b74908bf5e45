"""Generated matrices, built from ``spark.range`` so that they are distributed and lazy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..plans.expr import Source
from ..plans.lower import grid
from .tables import _coordinates


def _full(spark: SparkSession, nrows: int, ncols: int, v) -> Matrix:
    return Matrix(spark, Source(grid(spark, nrows, ncols).withColumn("v", v), (nrows, ncols), True))


def zeros(spark, nrows, ncols) -> Matrix:
    return _full(spark, nrows, ncols, F.lit(0.0))


def ones(spark, nrows, ncols) -> Matrix:
    return _full(spark, nrows, ncols, F.lit(1.0))


def rand(spark, nrows, ncols, low=0.0, high=1.0, seed=0) -> Matrix:
    """Uniform on [low, high)."""
    return _full(spark, nrows, ncols, F.rand(seed) * (high - low) + low)


def randn(spark, nrows, ncols, seed=0) -> Matrix:
    return _full(spark, nrows, ncols, F.randn(seed))


def speye(spark, n) -> Matrix:
    return Matrix(spark, Source(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), (n, n)))


def eye(spark, n) -> Matrix:
    return speye(spark, n).to_dense()


def spdiag(spark, values) -> Matrix:
    values = np.asarray(values, float)
    at = np.flatnonzero(values)
    return Matrix(spark, Source(_coordinates(spark, at, at, values[at]), (len(values), len(values))))


def diag(spark, values) -> Matrix:
    return spdiag(spark, values).to_dense()


def _sparse(spark, nrows, ncols, density, seed, v) -> Matrix:
    """Exactly ceil(nrows * ncols * density) active cells, one in each of as many equal strata of the
    cell range: each stratum's cell is drawn independently, so nothing is sorted or compared."""
    if not 0 <= density <= 1:
        raise ValueError(f"density {density}")
    cells = nrows * ncols
    n = int(np.ceil(cells * density))
    if not n:
        return Matrix(spark, Source(spark.range(0).selectExpr("id as i", "id as j", "0D as v"), (nrows, ncols)))
    lo, hi = f"(id * {cells} div {n})", f"((id + 1) * {cells} div {n})"
    at = spark.range(n).select("id", F.rand(seed).alias("u")).select(F.expr(f"{lo} + cast(floor(u * ({hi} - {lo})) as bigint)").alias("p"))
    return Matrix(spark, Source(at.select(F.expr(f"p div {ncols}").alias("i"), F.expr(f"p % {ncols}").alias("j"), v.alias("v")), (nrows, ncols)))


def sprand(spark, nrows, ncols, density, seed=0) -> Matrix:
    return _sparse(spark, nrows, ncols, density, seed, F.rand(seed + 1))


def sprandn(spark, nrows, ncols, density, seed=0) -> Matrix:
    return _sparse(spark, nrows, ncols, density, seed, F.randn(seed + 1))
