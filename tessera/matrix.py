"""The public handle: an immutable expression bound to a session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import conf
from .plans import expr as X
from .plans.lower import lower
from .plans.rewrite import describe, rewrite


class Matrix:
    """A distributed matrix. Operators return new matrices; ``df`` is the DataFrame ``i, j, v``.

    An absent cell is an implicit zero. ``add_scalar`` and ``power`` touch active cells only unless
    ``densify`` is set; element-wise products and quotients are over cells active on both sides.
    """

    def __init__(self, spark: SparkSession, expr: X.Expr):
        self.spark, self.expr = spark, expr

    def _new(self, e: X.Expr) -> Matrix:
        return Matrix(self.spark, e)

    # shape and plans
    nrows = property(lambda self: self.expr.nrows)
    ncols = property(lambda self: self.expr.ncols)
    shape = property(lambda self: self.expr.shape)
    dense = property(lambda self: self.expr.dense)

    def optimized(self) -> X.Expr:
        return rewrite(self.expr) if conf(self.spark, "tessera.rewrite") else self.expr

    @property
    def df(self) -> DataFrame:
        return lower(self.spark, self.optimized())

    def explain(self) -> str:
        return f"given:     {describe(self.expr)}\nrewritten: {describe(self.optimized())}"

    # selection
    def project(self, row_or_col: bool, index: int) -> Matrix:
        return self.row(index) if row_or_col else self.col(index)

    def row(self, k: int) -> Matrix:
        return self._new(X.Row(self.expr, k))

    def col(self, k: int) -> Matrix:
        return self._new(X.Col(self.expr, k))

    def selection(self, row: int, col: int) -> Matrix:
        return self._new(X.Cell(self.expr, row, col))

    # reshaping
    def transpose(self) -> Matrix:
        return self._new(X.Transpose(self.expr))

    t = transpose
    T = property(transpose)

    def vec(self) -> Matrix:
        return self._new(X.Vec(self.expr))

    def hstack(self, other: Matrix) -> Matrix:
        return self._new(X.Stack(self.expr, other.expr, True))

    def vstack(self, other: Matrix) -> Matrix:
        return self._new(X.Stack(self.expr, other.expr, False))

    # aggregates
    def row_sum(self) -> Matrix:
        return self._new(X.RowSum(self.expr))

    def col_sum(self) -> Matrix:
        return self._new(X.ColSum(self.expr))

    def sum(self) -> Matrix:
        return self._new(X.Sum(self.expr))

    def trace(self) -> Matrix:
        return self._new(X.Trace(self.expr))

    def frobenius(self) -> Matrix:
        """sqrt of the sum of squares, 1 x 1."""
        return self._new(X.MapValues(X.Sum(X.MapValues(self.expr, lambda v: v * v)), F.sqrt))

    def num_actives(self) -> Matrix:
        return self._new(X.Sum(X.MapValues(self.expr, lambda v: F.lit(1.0))))

    def num_nonzeros(self) -> Matrix:
        return self._new(X.Sum(X.MapValues(self.expr, lambda v: F.when(v != 0, 1.0).otherwise(0.0))))

    # scalars and values
    def add_scalar(self, alpha: float, densify: bool = False) -> Matrix:
        return self._new(X.AddScalar(X.Densify(self.expr) if densify else self.expr, alpha))

    def multiply_scalar(self, alpha: float) -> Matrix:
        return self._new(X.MulScalar(self.expr, alpha))

    def power(self, alpha: float, densify: bool = False) -> Matrix:
        """Element-wise power, not a matrix power."""
        return self._new(X.Power(X.Densify(self.expr) if densify else self.expr, alpha))

    def map_values(self, fn: Callable) -> Matrix:
        """``fn``: Column -> Column over active values."""
        return self._new(X.MapValues(self.expr, fn))

    def equals_scalar(self, value: float, tolerance: float = 1e-6) -> Matrix:
        return self._new(X.EqualsScalar(self.expr, value, tolerance))

    def prune(self) -> Matrix:
        """Drop stored zeros."""
        return self._new(X.MapValues(self.expr, None, lambda i, j, v: v != 0))

    to_sparse = prune

    def to_dense(self) -> Matrix:
        return self._new(X.Densify(self.expr))

    # pairs
    def add_element(self, other: Matrix) -> Matrix:
        return self._new(X.Add(self.expr, other.expr))

    def multiply_element(self, other: Matrix) -> Matrix:
        return self._new(X.Hadamard(self.expr, other.expr))

    def divide_element(self, other: Matrix) -> Matrix:
        return self._new(X.Divide(self.expr, other.expr))

    def divide_vector(self, vector: Matrix) -> Matrix:
        return self._new(X.DivideVector(self.expr, vector.expr))

    def matrix_multiply(self, other: Matrix, how: str | None = None) -> Matrix:
        if how not in (None, "coo", "blocked"):
            raise ValueError(f"how must be 'coo' or 'blocked', not {how!r}")
        return self._new(X.MatMul(self.expr, other.expr, how))

    def matrix_rank_one_update(self, x: Matrix, alpha: float = 1.0) -> Matrix:
        """self + alpha x xᵀ, for a column vector x."""
        return self._new(X.RankOne(self.expr, x.expr, alpha))

    def gemm(self, a: Matrix, b: Matrix, alpha: float = 1.0, beta: float = 1.0) -> Matrix:
        """alpha a b + beta self."""
        return a.matrix_multiply(b).multiply_scalar(alpha).add_element(self.multiply_scalar(beta))

    __matmul__ = matrix_multiply

    def __add__(self, other):
        return self.add_element(other) if isinstance(other, Matrix) else self.add_scalar(other)

    def __mul__(self, other):
        return self.multiply_element(other) if isinstance(other, Matrix) else self.multiply_scalar(other)

    def __truediv__(self, other):
        return self.divide_element(other) if isinstance(other, Matrix) else self._new(X.DivScalar(self.expr, other))

    def __sub__(self, other):
        return self + (other.multiply_scalar(-1.0) if isinstance(other, Matrix) else -other)

    __rmul__, __radd__ = multiply_scalar, add_scalar

    def __pow__(self, alpha: float):
        return self.power(alpha)

    # leaving the engine
    def rows_as_arrays(self) -> DataFrame:
        """``i, values`` with one array of ncols doubles per row that has an active cell."""
        return self._arrays("i", "j", self.ncols)

    def cols_as_arrays(self) -> DataFrame:
        return self._arrays("j", "i", self.nrows)

    def _arrays(self, key: str, at: str, n: int) -> DataFrame:
        packed = self.df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(at, "v"))).alias("m"))
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")) if n else F.array().cast("array<bigint>")
        return packed.select(key, F.transform(every, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("values"))

    def to_numpy(self, limit: int = 10**7) -> np.ndarray:
        """The whole matrix on the driver; refused above ``limit`` cells."""
        if self.expr.cells > limit:
            raise X.ShapeError(f"{self.shape} has more than {limit} cells")
        out = np.zeros(self.shape)
        got = self.df.toArrow()
        out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
        return out

    def item(self) -> float:
        if self.shape != (1, 1):
            raise X.ShapeError(f"item() of a {self.shape} matrix")
        rows = self.df.select("v").take(1)
        return rows[0][0] if rows else 0.0

    def to_ml(self):
        """A local ``pyspark.ml.linalg.DenseMatrix``."""
        from pyspark.ml.linalg import DenseMatrix

        return DenseMatrix(self.nrows, self.ncols, self.to_numpy().ravel(order="F"))

    def to_ml_sparse(self):
        """A local ``pyspark.ml.linalg.SparseMatrix`` of the cells that are not zero."""
        from pyspark.ml.linalg import SparseMatrix

        a = self.to_numpy()
        j, i = np.nonzero(a.T)
        pointers = np.searchsorted(j, np.arange(self.ncols + 1))
        return SparseMatrix(self.nrows, self.ncols, pointers.tolist(), i.tolist(), a[i, j].tolist())

    def equals(self, other: Matrix, tolerance: float = 0.0) -> bool:
        """Whether shapes agree and no cell differs by more than ``tolerance``; absent cells are zeros, NaN equals NaN."""
        if self.shape != other.shape:
            return False
        a, b = (m.df.select("i", "j", F.col("v").alias(n)) for m, n in ((self, "x"), (other, "y")))
        x, y = (F.coalesce(c, F.lit(0.0)) for c in ("x", "y"))
        same = (x == y) | (F.abs(x - y) <= tolerance)
        return a.join(b, ["i", "j"], "full").filter(~same).isEmpty()

    def foreach_active(self, fn: Callable[[int, int, float], None]) -> None:
        """Calls ``fn(i, j, v)`` on the executors for every active cell."""
        self.df.foreach(lambda r: fn(r.i, r.j, r.v))

    def write_parquet(self, path: str, mode: str = "errorifexists") -> None:
        self.df.write.mode(mode).parquet(path)

    def cut(self) -> Matrix:
        """Checkpointed copy, for loops. Needs a checkpoint folder (``spark.checkpoint.dir``)."""
        return self._new(X.Source(self.df.checkpoint(), self.shape, self.dense))

    def cached(self) -> Matrix:
        return self._new(replace(self.expr, df=self.expr.df.cache()) if isinstance(self.expr, X.Source) else X.Source(self.df.cache(), self.shape, self.dense))
