"""Lower an expression to a DataFrame ``i bigint, j bigint, v double``.

Everything but the blocked product is plain Catalyst: filters and pruned columns reach the scans,
sums combine map-side, joins are left to AQE. A side is broadcast only when its *shape* bounds it
below ``tessera.broadcast.bytes`` (an n-cell matrix has at most n rows of 24 bytes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import conf
from ..operators.blocked import blocked_product, gram
from . import expr as X

_ROW_BYTES = 24


def _coo(df: DataFrame, i, j, v) -> DataFrame:
    """i and j: columns, or SQL text."""
    at = [(F.expr(x) if isinstance(x, str) else x).cast("bigint").alias(n) for n, x in (("i", i), ("j", j))]
    return df.select(*at, v.cast("double").alias("v"))


def ieee_divide(x, y):
    """IEEE-754 quotient; ANSI mode would raise on a zero divisor."""
    nan = F.lit(float("nan"))
    return (
        F.when(y != 0, x / F.when(y != 0, y))
        .when(F.isnan(x), nan)
        .when(x > 0, F.lit(float("inf")))
        .when(x < 0, F.lit(float("-inf")))
        .otherwise(nan)
    )


def grid(spark: SparkSession, nrows: int, ncols: int) -> DataFrame:
    """All coordinates of a matrix, as one range."""
    n = nrows * ncols
    return spark.range(n).select(F.expr(f"id div {max(ncols, 1)}").alias("i"), F.expr(f"id % {max(ncols, 1)}").alias("j"))


class Lowering:
    def __init__(self, spark: SparkSession):
        self.spark, self.memo = spark, {}
        self.limit = conf(spark, "tessera.broadcast.bytes")

    def __call__(self, e: X.Expr) -> DataFrame:
        if id(e) not in self.memo:
            self.memo[id(e)] = e, getattr(self, type(e).__name__.lower())(e)
        return self.memo[id(e)][1]

    def small(self, e: X.Expr) -> bool:
        return e.cells * _ROW_BYTES <= self.limit

    def hint(self, e: X.Expr, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small(e) else df

    def source(self, e):
        return e.df

    def transpose(self, e):
        return self(e.a).select(F.col("j").alias("i"), F.col("i").alias("j"), "v")

    def row(self, e):
        return _coo(self(e.a).filter(F.col("i") == e.index), "0", "j", F.col("v"))

    def col(self, e):
        return _coo(self(e.a).filter(F.col("j") == e.index), "i", "0", F.col("v"))

    def _total(self, df):
        return _coo(df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")), "0", "0", F.col("v"))

    def cell(self, e):
        return self._total(self(e.a).filter((F.col("i") == e.row) & (F.col("j") == e.col)))

    def rowsum(self, e):
        return _coo(self(e.a).groupBy("i").agg(F.sum("v").alias("v")), "i", "0", F.col("v"))

    def colsum(self, e):
        return _coo(self(e.a).groupBy("j").agg(F.sum("v").alias("v")), "0", "j", F.col("v"))

    def sum(self, e):
        return self._total(self(e.a))

    def trace(self, e):
        return self._total(self(e.a).filter(F.col("i") == F.col("j")))

    def addscalar(self, e):
        return _coo(self(e.a), "i", "j", F.col("v") + F.lit(float(e.alpha)))

    def mulscalar(self, e):
        return _coo(self(e.a), "i", "j", F.col("v") * F.lit(float(e.alpha)))

    def divscalar(self, e):
        return _coo(self(e.a), "i", "j", ieee_divide(F.col("v"), F.lit(float(e.alpha))))

    def power(self, e):
        return _coo(self(e.a), "i", "j", F.pow("v", F.lit(float(e.alpha))))

    def mapvalues(self, e):
        df = self(e.a)
        if e.keep is not None:
            df = df.filter(e.keep(F.col("i"), F.col("j"), F.col("v")))
        return _coo(df, "i", "j", e.fn(F.col("v"))) if e.fn is not None else df

    def densify(self, e):
        if e.a.dense:
            return self(e.a)
        return self._summed(self(e.a).unionByName(grid(self.spark, *e.shape).withColumn("v", F.lit(0.0))))

    def equalsscalar(self, e):
        if e.dense and not e.a.dense:
            return self.equalsscalar(X.EqualsScalar(X.Densify(e.a), e.value, e.tolerance))
        return _coo(self(e.a), "i", "j", F.when(F.abs(F.col("v") - F.lit(float(e.value))) < F.lit(e.tolerance), 1.0).otherwise(0.0))

    def vec(self, e):
        return _coo(self(e.a), F.col("j") * F.lit(e.a.nrows).cast("bigint") + F.col("i"), "0", F.col("v"))

    @staticmethod
    def _summed(df):
        return df.groupBy("i", "j").agg(F.sum("v").alias("v"))

    def add(self, e):
        if e.a is e.b:
            return self.mulscalar(X.MulScalar(e.a, 2.0))
        return self._summed(self(e.a).unionByName(self(e.b)))

    def _zip(self, e, f):
        if e.a is e.b:
            return _coo(self(e.a), "i", "j", f(F.col("v"), F.col("v")))
        a = self(e.a)
        b = self(e.b).select("i", "j", F.col("v").alias("w"))
        if self.small(e):
            b = F.broadcast(b)
        return _coo(a.join(b, ["i", "j"]), "i", "j", f(F.col("v"), F.col("w")))

    def hadamard(self, e):
        return self._zip(e, lambda x, y: x * y)

    def divide(self, e):
        return self._zip(e, ieee_divide)

    def dividevector(self, e):
        at = "i" if e.b.ncols == 1 else "j"
        d = self(e.b).select(F.col(at).alias("j"), F.col("v").alias("w"))
        joined = self(e.a).join(self.hint(e.b, d), "j", "left")
        return _coo(joined, "i", "j", F.when(F.coalesce("w", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.col("v") / F.when(F.col("w") != 0, F.col("w"))))

    def stack(self, e):
        m, n = e.a.shape
        b = self(e.b)
        moved = _coo(b, "i", F.col("j") + F.lit(n), F.col("v")) if e.across else _coo(b, F.col("i") + F.lit(m), "j", F.col("v"))
        return self(e.a).unionByName(moved)

    def _coo_product(self, a, b, small_a, small_b):
        """Join on the inner index, then sum; partial sums combine before the shuffle on (i, j)."""
        left = a.select(F.col("i").alias("i"), F.col("j").alias("k"), F.col("v").alias("x"))
        right = b.select(F.col("i").alias("k"), F.col("j").alias("j"), F.col("v").alias("y"))
        if small_b:
            right = F.broadcast(right)
        elif small_a:
            left = F.broadcast(left)
        return self._summed(_coo(left.join(right, "k"), "i", "j", F.col("x") * F.col("y")))

    def matmul(self, e):
        how = e.how or self.choose(e)
        if how == "gram":
            return gram(e.b.rows, e.b.ncols)
        if how == "blocked":
            return blocked_product(self(e.a), self(e.b), e.a.shape, e.b.shape, conf(self.spark, "tessera.block.size"))
        return self._coo_product(self(e.a), self(e.b), self.small(e.a), self.small(e.b))

    def choose(self, e) -> str:
        """Rows kept as arrays give XᵀX in one pass; large dense pairs go through numpy; the rest joins."""
        if isinstance(e.a, X.Transpose) and e.a.a is e.b and isinstance(e.b, X.Source) and e.b.rows is not None and e.b.ncols <= conf(self.spark, "tessera.gram.columns"):
            return "gram"
        work = e.a.nrows * e.a.ncols * e.b.ncols
        if e.a.dense and e.b.dense and min(e.a.nrows, e.a.ncols, e.b.ncols) >= 32 and work >= conf(self.spark, "tessera.blocked.work"):
            return "blocked"
        return "coo"

    def rankone(self, e):
        x = self(e.b).select("i", F.col("v").alias("x"))
        y = self(e.b).select(F.col("i").alias("j"), F.col("v").alias("y"))
        # the outer product as an equi-join: one side in ways by its index, the other repeated for each, so that no key holds all rows
        ways = 1 if self.small(e.b) else max(1, -(-e.b.nrows // conf(self.spark, "tessera.outer.rows")))
        x = x.withColumn("c", F.pmod(F.xxhash64("i"), F.lit(ways)).cast("int"))
        y = y.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))) if ways > 1 else y.withColumn("c", F.lit(0))
        outer = x.join(self.hint(e.b, y), "c")
        return self._summed(self(e.a).unionByName(_coo(outer, "i", "j", F.lit(float(e.alpha)) * (F.col("x") * F.col("y")))))


def lower(spark: SparkSession, e: X.Expr) -> DataFrame:
    return Lowering(spark)(e)
