"""Registered queries over the driver's tables and the same results in SQL.

Values are whole numbers held in doubles (floor(256 x) of the embeddings, quantities, whole prices),
so sums are exact in any order and the two engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import blas
from .matrix import Matrix
from .operators import partitioning
from .plans.expr import Source
from .sources import (
    blocks, diag, eye, from_coo, from_ml, from_numpy, from_rows, from_sparse_arrays, from_vector, ones, rand, randn, spdiag, speye, sprand, sprandn, zeros,
)

DIM = 64
LINES = 8


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rows(df: DataFrame, key: str) -> int:
    top = df.agg(F.max(key)).first()[0]
    return 0 if top is None else top + 1


def embeddings(spark, d) -> Matrix:
    """X: vectors x 64, dense."""
    e = _read(spark, d, "embeddings")
    return from_rows(e, "vec_id", F.expr("transform(embedding, x -> floor(256 * double(x)))"), (_rows(e, "vec_id"), DIM), dense=True)


def quantities(spark, d) -> Matrix:
    """L: orders x line numbers, sparse."""
    li = _read(spark, d, "lineitem")
    return from_coo(li, "l_orderkey", "l_linenumber", "l_quantity", shape=(_rows(li, "l_orderkey"), LINES))


def prices(spark, d) -> Matrix:
    """D: orders x line numbers, sparse, whole discount percentages plus one."""
    li = _read(spark, d, "lineitem")
    return from_coo(li, "l_orderkey", "l_linenumber", F.expr("floor(l_extendedprice)"), shape=(_rows(li, "l_orderkey"), LINES))


def supply(spark, d) -> Matrix:
    """P: parts x suppliers, sparse."""
    li = _read(spark, d, "lineitem")
    s = _read(spark, d, "supplier")
    p = _read(spark, d, "part")
    shape = max(_rows(p, "p_partkey"), _rows(li, "l_partkey")), max(_rows(s, "s_suppkey"), _rows(li, "l_suppkey"))
    return from_coo(li, "l_partkey", "l_suppkey", "l_quantity", shape=shape)


def nations(spark, d) -> Matrix:
    """N: nations x order years since 1990 (customers' orders), small."""
    c = _read(spark, d, "customer")
    o = _read(spark, d, "orders")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return from_coo(j, "c_nationkey", F.year("o_orderdate") - 1990, F.lit(1), shape=(25, 40))


def _gram(x: Matrix) -> Matrix:
    return x.T @ x


_PICK = 3
#: A small matrix with a stored zero, in compressed columns, and a vector.
_SMALL = (3, 3), [0, 2, 3, 6], [0, 2, 1, 0, 1, 2], [1.0, 2.0, 3.0, 0.0, 5.0, 6.0]
_DIAG = [2.0, 0.0, 5.0]


def holes(spark, d) -> Matrix:
    """Z: the embeddings with NaN for zero."""
    e = _read(spark, d, "embeddings")
    return from_rows(e, "vec_id", F.expr("transform(embedding, x -> if(floor(256 * double(x)) = 0, double('NaN'), floor(256 * double(x))))"), (_rows(e, "vec_id"), DIM), dense=True)


def some_rows(spark, d) -> Matrix:
    """S: every third row of the embeddings; the others are absent."""
    e = _read(spark, d, "embeddings")
    return from_rows(e.filter("vec_id % 3 = 0"), "vec_id", F.expr("transform(embedding, x -> floor(256 * double(x)))"), (_rows(e, "vec_id"), DIM))


def _nan_as(m: Matrix, value: float = -1.0) -> Matrix:
    return m.map_values(lambda v: F.when(F.isnan(v), value).otherwise(v))


def _within(m: Matrix, low: float, high: float) -> Matrix:
    """How many active cells lie on [low, high)."""
    return m.map_values(lambda v: F.when((v >= low) & (v < high), 1.0).otherwise(0.0)).sum()


def _placed(m: Matrix, df: DataFrame) -> Matrix:
    return Matrix(m.spark, Source(df, m.shape))


def _ml(dense: bool):
    from pyspark.ml.linalg import DenseMatrix, SparseMatrix

    (m, n), pointers, at, values = _SMALL
    return DenseMatrix(m, n, list(range(1, 10))) if dense else SparseMatrix(m, n, pointers, at, values)


def _same(s, a: Matrix, b: Matrix, tolerance: float = 0.0) -> Matrix:
    return from_numpy(s, [[float(a.equals(b, tolerance))]])

QUERIES: dict[str, Callable[[SparkSession, str], Matrix]] = {
    "project_row": lambda s, d: embeddings(s, d).row(_PICK),
    "project_row_sparse": lambda s, d: supply(s, d).row(_PICK),
    "project_column": lambda s, d: embeddings(s, d).col(_PICK),
    "project_column_transposed": lambda s, d: quantities(s, d).t().project(False, _PICK),
    "project_row_of_product": lambda s, d: (supply(s, d).T @ supply(s, d)).row(_PICK),
    "project_column_of_sum": lambda s, d: (quantities(s, d) + prices(s, d)).col(_PICK),
    "selection": lambda s, d: embeddings(s, d).selection(7, _PICK),
    "selection_of_product": lambda s, d: (supply(s, d).T @ supply(s, d)).selection(1, _PICK),
    "selection_absent": lambda s, d: quantities(s, d).selection(0, 0),
    "transpose": lambda s, d: quantities(s, d).t(),
    "row_sum": lambda s, d: embeddings(s, d).row_sum(),
    "row_sum_transposed": lambda s, d: embeddings(s, d).t().row_sum(),
    "row_sum_of_product": lambda s, d: (supply(s, d).T @ supply(s, d)).row_sum(),
    "row_sum_add_scalar": lambda s, d: embeddings(s, d).add_scalar(2).row_sum(),
    "col_sum": lambda s, d: quantities(s, d).col_sum(),
    "col_sum_of_product": lambda s, d: (supply(s, d) @ supply(s, d).T).col_sum(),
    "sum": lambda s, d: quantities(s, d).sum(),
    "sum_of_product": lambda s, d: (supply(s, d) @ supply(s, d).T).sum(),
    "sum_of_sum": lambda s, d: (quantities(s, d) + prices(s, d)).sum(),
    "trace": lambda s, d: _gram(embeddings(s, d)).trace(),
    "trace_of_product": lambda s, d: (supply(s, d) @ supply(s, d).T).trace(),
    "vec": lambda s, d: quantities(s, d).vec(),
    "add_scalar": lambda s, d: quantities(s, d).add_scalar(5),
    "add_scalar_densify": lambda s, d: nations(s, d).add_scalar(5, densify=True),
    "multiply_scalar": lambda s, d: quantities(s, d) * 3,
    "power": lambda s, d: quantities(s, d) ** 2,
    "add_element": lambda s, d: quantities(s, d) + prices(s, d),
    "subtract_element": lambda s, d: quantities(s, d) - prices(s, d),
    "multiply_element": lambda s, d: quantities(s, d) * prices(s, d),
    "divide_element": lambda s, d: prices(s, d) / quantities(s, d),
    "divide_by_zero": lambda s, d: embeddings(s, d) / embeddings(s, d).multiply_scalar(0),
    "matrix_multiply": lambda s, d: supply(s, d).T @ supply(s, d),
    "matrix_multiply_gram": lambda s, d: _gram(embeddings(s, d)),
    "matrix_multiply_blocked": lambda s, d: embeddings(s, d).T.matrix_multiply(embeddings(s, d), how="blocked"),
    "matrix_multiply_chain": lambda s, d: nations(s, d).T @ nations(s, d) @ nations(s, d).T,
    "matrix_multiply_vector": lambda s, d: quantities(s, d) @ quantities(s, d).col_sum().T,
    "rank_one_update": lambda s, d: _gram(quantities(s, d)).matrix_rank_one_update(quantities(s, d).col_sum().T),
    "frobenius": lambda s, d: quantities(s, d).frobenius(),
    "divide_vector": lambda s, d: nations(s, d).divide_vector(nations(s, d).col_sum()),
    "equals_scalar": lambda s, d: quantities(s, d).equals_scalar(7),
    "equals_zero": lambda s, d: nations(s, d).equals_scalar(0),
    "gemm": lambda s, d: blas.gemm(2, nations(s, d).T, nations(s, d), -1, _gram(nations(s, d))),
    "gemv": lambda s, d: blas.gemv(2, quantities(s, d), quantities(s, d).col_sum().T, 3, quantities(s, d).row_sum()),
    "axpy": lambda s, d: blas.axpy(2, quantities(s, d), prices(s, d)),
    "dot": lambda s, d: blas.dot(quantities(s, d).row_sum(), prices(s, d).row_sum()),
    "syr": lambda s, d: blas.syr(4, nations(s, d).col_sum().T, _gram(nations(s, d))),
    "hstack": lambda s, d: quantities(s, d).hstack(prices(s, d)),
    "vstack": lambda s, d: quantities(s, d).vstack(prices(s, d)),
    "num_nonzeros": lambda s, d: embeddings(s, d).num_nonzeros(),
    "num_actives": lambda s, d: embeddings(s, d).num_actives(),
    "prune": lambda s, d: embeddings(s, d).prune(),
    "to_dense": lambda s, d: nations(s, d).to_dense(),
    "map_values": lambda s, d: quantities(s, d).map_values(lambda v: v * 2 + 1),
    "scal": lambda s, d: blas.scal(3, quantities(s, d)),
    "copy": lambda s, d: blas.copy(quantities(s, d)),
    "syr_odd": lambda s, d: blas.syr(-3, nations(s, d).col_sum().T, _gram(nations(s, d))),
    "divide_scalar": lambda s, d: quantities(s, d) / 3,
    "divide_scalar_zero": lambda s, d: quantities(s, d) / 0,
    "gram_nan": lambda s, d: _nan_as(_gram(holes(s, d))),
    "blocked_nan": lambda s, d: _nan_as(holes(s, d).T.matrix_multiply(holes(s, d), how="blocked")),
    "from_rows_absent": lambda s, d: some_rows(s, d).add_scalar(1, densify=True).row_sum(),
    "from_rows_absent_gram": lambda s, d: _gram(some_rows(s, d)),
    "zeros": lambda s, d: zeros(s, 5, 7),
    "ones": lambda s, d: ones(s, 5, 7),
    "eye": lambda s, d: eye(s, 6),
    "speye": lambda s, d: speye(s, 6),
    "diag": lambda s, d: diag(s, _DIAG),
    "spdiag": lambda s, d: spdiag(s, _DIAG),
    "rand": lambda s, d: _within(rand(s, 300, 200, -2, 3, seed=1), -2, 3),
    "randn": lambda s, d: _within(randn(s, 300, 200, seed=1), -10, 10),
    "sprand": lambda s, d: _within(sprand(s, 300, 200, 0.1, seed=1), 0, 1),
    "sprandn": lambda s, d: _within(sprandn(s, 300, 200, 0.1, seed=1), -10, 10),
    "partition_by_row": lambda s, d: _placed(quantities(s, d), partitioning.by_row(quantities(s, d).df, 8, 100)),
    "partition_by_column": lambda s, d: _placed(quantities(s, d), partitioning.by_column(quantities(s, d).df, 8)),
    "partition_by_index": lambda s, d: _placed(quantities(s, d), partitioning.by_index(quantities(s, d).df, 8, F.col("i") + F.col("j"))),
    "partition_block_cyclic": lambda s, d: _placed(quantities(s, d), partitioning.block_cyclic(quantities(s, d).df, quantities(s, d).shape, 4)),
    "partition_grid": lambda s, d: from_numpy(s, [partitioning.grid_shape(r, c, p) for r, c, p in ((100, 100, 64), (2, 100, 64), (1, 1, 64), (3, 3, 4))]),
    "from_compressed_columns": lambda s, d: from_sparse_arrays(s, *_SMALL),
    "from_compressed_rows": lambda s, d: from_sparse_arrays(s, *_SMALL, by_row=True),
    "from_numpy": lambda s, d: from_numpy(s, [[1, 0], [3, 4]]),
    "from_vector": lambda s, d: from_sparse_arrays(s, *_SMALL) @ from_vector(s, [1, 2, 3]),
    "from_ml_dense": lambda s, d: from_ml(s, _ml(True)) * 2,
    "from_ml_sparse": lambda s, d: from_ml(s, _ml(False)) * 2,
    "to_ml_round_trip": lambda s, d: from_ml(s, nations(s, d).to_ml_sparse()),
    "array_rows_round_trip": lambda s, d: from_rows(nations(s, d).rows_as_arrays(), "i", "values", (25, 40)).prune(),
    "array_columns_round_trip": lambda s, d: from_rows(nations(s, d).cols_as_arrays(), "j", "values", (40, 25)).T.prune(),
    "equals": lambda s, d: _same(s, quantities(s, d), quantities(s, d).t().t()),
    "equals_not": lambda s, d: _same(s, quantities(s, d), quantities(s, d) + prices(s, d)),
    "equals_tolerance": lambda s, d: _same(s, quantities(s, d), quantities(s, d).add_scalar(0.25), 0.5),
    "block_round_trip": lambda s, d: blocks.from_blocks(blocks.to_block_table(nations(s, d), 16), (25, 40), 16).prune(),
}

_X = "x as (select vec_id as i, cast(u.k - 1 as bigint) as j, floor(256 * cast(embedding[u.k] as double)) as v from embeddings, (select unnest(range(1, 65)) as k) u)"
_L = "l as (select l_orderkey as i, cast(l_linenumber as bigint) as j, sum(l_quantity) as v from lineitem group by 1, 2 having sum(l_quantity) <> 0)"
_D = "d as (select l_orderkey as i, cast(l_linenumber as bigint) as j, sum(floor(l_extendedprice)) as v from lineitem group by 1, 2 having sum(floor(l_extendedprice)) <> 0)"
_P = "p as (select l_partkey as i, l_suppkey as j, sum(l_quantity) as v from lineitem group by 1, 2 having sum(l_quantity) <> 0)"
_N = "n as (select cast(c_nationkey as bigint) as i, cast(year(o_orderdate) - 1990 as bigint) as j, cast(count(*) as double) as v from orders join customer on o_custkey = c_custkey group by 1, 2)"
_NG = "g as (select a.j as i, b.j as j, sum(a.v * b.v) as v from n a join n b on a.i = b.i group by 1, 2), c as (select j as i, sum(v) as v from n group by 1)"
_Q = "z as (select i, j, case when v = 0 then cast('nan' as double) else v end as v from x)"
_QG = "select i, j, case when isnan(v) then -1 else v end as v from (select a.j as i, b.j as j, sum(a.v * b.v) as v from z a join z b on a.i = b.i group by 1, 2)"


def _cells(*cells: tuple[int, int, float]) -> str:
    return "select cast(i as bigint) as i, cast(j as bigint) as j, cast(v as double) as v from (values " + ", ".join(map(str, cells)) + ") t(i, j, v)"


def _full(m: int, n: int, v: str) -> str:
    return f"select cast(a.r as bigint) as i, cast(b.c as bigint) as j, cast({v} as double) as v from (select unnest(range({m})) as r) a, (select unnest(range({n})) as c) b"


_GRID = "grid as (select cast(a.r as bigint) as i, cast(b.c as bigint) as j from (select unnest(range(25)) as r) a, (select unnest(range(40)) as c) b)"
_DIMS = "dims as (select greatest((select max(p_partkey) from part), (select max(l_partkey) from lineitem)) + 1 as parts, (select max(l_orderkey) + 1 from lineitem) as orders)"
_B, _Z = "cast(0 as bigint)", "cast(coalesce(sum(v), 0) as double)"


def _with(*tables: str) -> str:
    return "with " + ", ".join(tables) + " "


ORACLE: dict[str, str] = {
    "project_row": _with(_X) + f"select {_B} as i, j, v from x where i = {_PICK}",
    "project_row_sparse": _with(_P) + f"select {_B} as i, j, v from p where i = {_PICK}",
    "project_column": _with(_X) + f"select i, {_B} as j, v from x where j = {_PICK}",
    "project_column_transposed": _with(_L) + f"select j as i, {_B} as j, v from l where i = {_PICK}",
    "project_row_of_product": _with(_P) + f"select {_B} as i, b.j as j, sum(a.v * b.v) as v from p a join p b on a.i = b.i where a.j = {_PICK} group by b.j",
    "project_column_of_sum": _with(_L, _D) + f"select i, {_B} as j, sum(v) as v from (select * from l union all select * from d) where j = {_PICK} group by i",
    "selection": _with(_X) + f"select {_B} as i, {_B} as j, {_Z} as v from x where i = 7 and j = {_PICK}",
    "selection_of_product": _with(_P) + f"select {_B} as i, {_B} as j, cast(coalesce(sum(a.v * b.v), 0) as double) as v from p a join p b on a.i = b.i where a.j = 1 and b.j = {_PICK}",
    "selection_absent": _with(_L) + f"select {_B} as i, {_B} as j, {_Z} as v from l where i = 0 and j = 0",
    "transpose": _with(_L) + "select j as i, i as j, v from l",
    "row_sum": _with(_X) + f"select i, {_B} as j, sum(v) as v from x group by i",
    "row_sum_transposed": _with(_X) + f"select j as i, {_B} as j, sum(v) as v from x group by x.j",
    "row_sum_of_product": _with(_P) + f"select a.j as i, {_B} as j, sum(a.v * b.v) as v from p a join p b on a.i = b.i group by a.j",
    "row_sum_add_scalar": _with(_X) + f"select i, {_B} as j, sum(v + 2) as v from x group by i",
    "col_sum": _with(_L) + f"select {_B} as i, j, sum(v) as v from l group by j",
    "col_sum_of_product": _with(_P) + f"select {_B} as i, b.i as j, sum(a.v * b.v) as v from p a join p b on a.j = b.j group by b.i",
    "sum": _with(_L) + f"select {_B} as i, {_B} as j, {_Z} as v from l",
    "sum_of_product": _with(_P) + f"select {_B} as i, {_B} as j, sum(a.v * b.v) as v from p a join p b on a.j = b.j",
    "sum_of_sum": _with(_L, _D) + f"select {_B} as i, {_B} as j, {_Z} as v from (select * from l union all select * from d)",
    "trace": _with(_X) + f"select {_B} as i, {_B} as j, sum(v * v) as v from x",
    "trace_of_product": _with(_P) + f"select {_B} as i, {_B} as j, sum(v * v) as v from p",
    "vec": _with(_L, _DIMS) + f"select j * (select orders from dims) + i as i, {_B} as j, v from l",
    "add_scalar": _with(_L) + "select i, j, v + 5 as v from l",
    "add_scalar_densify": _with(_N, _GRID) + "select i, j, coalesce(v, 0) + 5 as v from grid left join n using (i, j)",
    "multiply_scalar": _with(_L) + "select i, j, v * 3 as v from l",
    "power": _with(_L) + "select i, j, v * v as v from l",
    "add_element": _with(_L, _D) + "select i, j, sum(v) as v from (select * from l union all select * from d) group by i, j",
    "subtract_element": _with(_L, _D) + "select i, j, sum(v) as v from (select * from l union all select i, j, -v from d) group by i, j",
    "multiply_element": _with(_L, _D) + "select i, j, l.v * d.v as v from l join d using (i, j)",
    "divide_element": _with(_L, _D) + "select i, j, d.v / l.v as v from l join d using (i, j)",
    "divide_by_zero": _with(_X) + "select i, j, cast(case when v > 0 then 'inf' when v < 0 then '-inf' else 'nan' end as double) as v from x",
    "matrix_multiply": _with(_P) + "select a.j as i, b.j as j, sum(a.v * b.v) as v from p a join p b on a.i = b.i group by a.j, b.j",
    "matrix_multiply_gram": _with(_X) + "select a.j as i, b.j as j, sum(a.v * b.v) as v from x a join x b on a.i = b.i group by a.j, b.j",
    "matrix_multiply_blocked": _with(_X) + "select a.j as i, b.j as j, sum(a.v * b.v) as v from x a join x b on a.i = b.i group by a.j, b.j",
    "matrix_multiply_chain": _with(_N, _NG) + "select g.i as i, n.i as j, sum(g.v * n.v) as v from g join n on g.j = n.j group by g.i, n.i",
    "matrix_multiply_vector": _with(_L, "c as (select j, sum(v) as v from l group by j)") + f"select l.i as i, {_B} as j, sum(l.v * c.v) as v from l join c on l.j = c.j group by l.i",
    "rank_one_update": _with(_L, "g as (select a.j as i, b.j as j, sum(a.v * b.v) as v from l a join l b on a.i = b.i group by 1, 2)", "c as (select j, sum(v) as v from l group by j)") + "select i, j, sum(v) as v from (select * from g union all select a.j, b.j, a.v * b.v from c a, c b) group by i, j",
    "frobenius": _with(_L) + f"select {_B} as i, {_B} as j, sqrt(sum(v * v)) as v from l",
    "divide_vector": _with(_N, "c as (select j, sum(v) as w from n group by j)") + "select i, j, v / w as v from n join c using (j)",
    "equals_scalar": _with(_L) + "select i, j, cast(v = 7 as double) as v from l",
    "equals_zero": _with(_N, _GRID) + "select i, j, cast(coalesce(v, 0) = 0 as double) as v from grid left join n using (i, j)",
    "gemm": _with(_N, _NG) + "select i, j, v from g",
    "gemv": _with(_L, "c as (select j, sum(v) as v from l group by j)") + f"select l.i as i, {_B} as j, sum(2 * l.v * c.v + 3 * l.v) as v from l join c on l.j = c.j group by l.i",
    "axpy": _with(_L, _D) + "select i, j, sum(v) as v from (select i, j, 2 * v as v from l union all select * from d) group by i, j",
    "dot": _with(_L, _D, "r as (select i, sum(v) as v from l group by i)", "q as (select i, sum(v) as w from d group by i)") + f"select {_B} as i, {_B} as j, sum(v * w) as v from r join q using (i)",
    "syr": _with(_N, _NG) + "select i, j, sum(v) as v from (select * from g union all select a.i, b.i, 4 * a.v * b.v from c a, c b) group by i, j",
    "hstack": _with(_L, _D) + f"select * from l union all select i, j + {LINES}, v from d",
    "vstack": _with(_L, _D, _DIMS) + "select * from l union all select i + (select orders from dims), j, v from d",
    "num_nonzeros": _with(_X) + f"select {_B} as i, {_B} as j, cast(count(*) filter (v <> 0) as double) as v from x",
    "num_actives": _with(_X) + f"select {_B} as i, {_B} as j, cast(count(*) as double) as v from x",
    "prune": _with(_X) + "select i, j, v from x where v <> 0",
    "to_dense": _with(_N, _GRID) + "select i, j, coalesce(v, 0) as v from grid left join n using (i, j)",
    "map_values": _with(_L) + "select i, j, v * 2 + 1 as v from l",
    "scal": _with(_L) + "select i, j, v * 3 as v from l",
    "copy": _with(_L) + "select i, j, v from l",
    "syr_odd": _with(_N, _NG) + "select i, j, sum(v) as v from (select * from g union all select a.i, b.i, -3 * (a.v * b.v) from c a, c b) group by i, j",
    "divide_scalar": _with(_L) + "select i, j, v / 3 as v from l",
    "divide_scalar_zero": _with(_L) + "select i, j, cast(case when v > 0 then 'inf' when v < 0 then '-inf' else 'nan' end as double) as v from l",
    "gram_nan": _with(_X, _Q) + _QG,
    "blocked_nan": _with(_X, _Q) + _QG,
    "from_rows_absent": _with(_X) + f"select i, {_B} as j, sum(case when i % 3 = 0 then v else 0 end + 1) as v from x group by i",
    "from_rows_absent_gram": _with(_X) + "select a.j as i, b.j as j, sum(a.v * b.v) as v from x a join x b on a.i = b.i where a.i % 3 = 0 group by a.j, b.j",
    "zeros": _full(5, 7, "0"),
    "ones": _full(5, 7, "1"),
    "eye": _full(6, 6, "a.r = b.c"),
    "speye": _cells(*[(k, k, 1) for k in range(6)]),
    "diag": _full(3, 3, "case when a.r <> b.c then 0 when a.r = 0 then 2 when a.r = 2 then 5 else 0 end"),
    "spdiag": _cells((0, 0, 2), (2, 2, 5)),
    "rand": _cells((0, 0, 60000)),
    "randn": _cells((0, 0, 60000)),
    "sprand": _cells((0, 0, 6000)),
    "sprandn": _cells((0, 0, 6000)),
    "partition_by_row": _with(_L) + "select i, j, v from l",
    "partition_by_column": _with(_L) + "select i, j, v from l",
    "partition_by_index": _with(_L) + "select i, j, v from l",
    "partition_block_cyclic": _with(_L) + "select i, j, v from l",
    "partition_grid": _cells((0, 0, 8), (0, 1, 8), (1, 0, 2), (1, 1, 32), (2, 0, 1), (2, 1, 1), (3, 0, 2), (3, 1, 2)),
    "from_compressed_columns": _cells((0, 0, 1), (2, 0, 2), (1, 1, 3), (0, 2, 0), (1, 2, 5), (2, 2, 6)),
    "from_compressed_rows": _cells((0, 0, 1), (0, 2, 2), (1, 1, 3), (2, 0, 0), (2, 1, 5), (2, 2, 6)),
    "from_numpy": _cells((0, 0, 1), (0, 1, 0), (1, 0, 3), (1, 1, 4)),
    "from_vector": _cells((0, 0, 1), (1, 0, 21), (2, 0, 20)),
    "from_ml_dense": _cells(*[(k % 3, k // 3, 2 * k + 2) for k in range(9)]),
    "from_ml_sparse": _cells((0, 0, 2), (2, 0, 4), (1, 1, 6), (0, 2, 0), (1, 2, 10), (2, 2, 12)),
    "to_ml_round_trip": _with(_N) + "select i, j, v from n",
    "array_rows_round_trip": _with(_N) + "select i, j, v from n",
    "array_columns_round_trip": _with(_N) + "select i, j, v from n",
    "equals": _cells((0, 0, 1)),
    "equals_not": _cells((0, 0, 0)),
    "equals_tolerance": _cells((0, 0, 1)),
    "block_round_trip": _with(_N) + "select i, j, v from n",
}
