"""Operators against numpy, rewrites against the unrewritten plan, pushdown, shape errors, sources."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera import Matrix, ShapeError, conf
from tessera.functions import blas
from tessera.operators import partitioning
from tessera.plans import expr as X
from tessera.plans.lower import lower
from tessera.plans.rewrite import chain_order, describe, rewrite
from tessera.sources import (
    diag, eye, from_blocks, from_coo, from_ml, from_numpy, from_parquet, from_rows, from_sparse_arrays, from_vector, ones, rand, randn, spdiag, speye,
    sprand, sprandn, to_block_table, zeros,
)

# the demo matrices
MAT1 = np.array([[1, 2, 0, 0], [1, 2, 0, 0], [0, 0, 2, 3], [0, 0, 2, 3.0]])
MAT2 = np.array([[3, 4, 4, 6], [3, 4, 5, 7], [0, 0, 0, 2], [0, 0, 4, 0.0]])
SP1 = np.array([[1, 0, 4], [0, 3, 5], [2, 0, 6.0]])
SP2 = np.array([[0, 1, 2], [3, 0, 0], [0, 2, 0.0]])
DEN2 = np.array([[1, 1, 1], [2, 2, 2], [3, 3, 3.0]])


@pytest.fixture(scope="module")
def m(spark):
    return lambda a, **k: from_numpy(spark, a, **{"keep_zeros": False} | k)


def same(x: Matrix, want):
    want = np.asarray(want, dtype=float)
    assert x.shape == want.shape
    assert np.allclose(x.to_numpy(), want, equal_nan=True), (x.explain(), x.to_numpy())


def test_demo_products_and_aggregates(m):
    a, b = m(MAT1), m(MAT2)
    same(a @ b, [[9, 12, 14, 20], [9, 12, 14, 20], [0, 0, 12, 4], [0, 0, 12, 4]])
    same(a.t().row_sum(), [[2], [4], [4], [6]])
    same(b.col_sum(), [[6, 8, 13, 15]])
    assert (a @ b).trace().item() == 37 and (a @ b).sum().item() == 142
    same(a.project(True, 2), [[0, 0, 2, 3]])
    same(b.project(False, 3), [[6], [7], [2], [0]])
    same((a @ b).col(3), [[20], [20], [4], [4]])
    assert (a @ b).selection(0, 3).item() == 20


def test_local_demo(m):
    a, b, v = m(SP1), m(SP2), m(np.array([[1], [2], [3.0]]))
    same(a @ b, [[0, 9, 2], [9, 10, 0], [0, 14, 4]])
    same(a * b, [[0, 0, 8], [0, 0, 0], [0, 0, 0]])
    same(a + b, [[1, 1, 6], [3, 3, 5], [2, 2, 6]])
    same(b @ b.T, [[5, 0, 2], [0, 9, 0], [2, 0, 4]])
    same(a @ v, [[13], [21], [20]])
    same(a @ b.T, [[8, 3, 0], [13, 0, 6], [12, 6, 0]])
    same(m(DEN2).divide_vector(v), DEN2 / np.array([1, 2, 3]))
    same(m(DEN2).divide_vector(v.T), DEN2 / np.array([1, 2, 3]))
    same(a.col_sum(), [[3, 3, 15]])


def test_block_demo(spark):
    schema = "rid int, cid int, matrix struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"
    b1, s1 = (1, 2, 2, None, None, [1.0, 1.0, 2.0, 2.0], False), (0, 2, 2, [0, 1, 2], [1, 0], [4.0, 2.0], False)
    df = spark.createDataFrame([(0, 2, b1), (1, 3, s1)], schema)
    a = from_blocks(df, (4, 8), 2)
    want = np.zeros((4, 8))
    want[0:2, 4:6], want[2:4, 6:8] = [[1, 2], [1, 2]], [[0, 2], [4, 0]]
    same(a, want)
    same(a.power(2), want**2)
    same(a.t(), want.T)
    flipped = spark.createDataFrame([(0, 0, (1, 2, 3, None, None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], True)), (1, 0, (0, 1, 3, [0, 2], [0, 2], [7.0, 8.0], True))], schema)
    same(from_blocks(flipped, (3, 3), 2), [[1, 2, 3], [4, 5, 6], [7, 0, 8]])
    ragged = from_numpy(spark, np.arange(15.0).reshape(5, 3))
    same(from_blocks(to_block_table(ragged, 2), (5, 3), 2), np.arange(15.0).reshape(5, 3))


_DIM = st.integers(1, 5)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_random_against_numpy(m, data):
    p, q, r = data.draw(_DIM), data.draw(_DIM), data.draw(_DIM)
    cells = lambda x, y: np.array(data.draw(st.lists(st.sampled_from([0, 0, 1, 2, -3]), min_size=x * y, max_size=x * y)), float).reshape(x, y)
    a, b, c = cells(p, q), cells(q, r), cells(p, q)
    full = data.draw(st.booleans())
    A, B, C = m(a, keep_zeros=full), m(b), m(c)
    k, c0 = data.draw(st.integers(0, p - 1)), data.draw(st.integers(0, r - 1))
    same((A @ B).row(k), (a @ b)[k : k + 1])
    same((A @ B).row_sum(), (a @ b).sum(1, keepdims=True))
    same((A @ B).col_sum(), (a @ b).sum(0, keepdims=True))
    assert np.isclose((A @ B).selection(k, c0).item(), (a @ b)[k, c0])
    assert np.isclose((A + C).T.sum().item(), (a + c).sum())
    assert np.isclose((A.T @ C).trace().item(), np.trace(a.T @ c))
    same((A + C).T.row(0), (a + c).T[:1])
    same(A.vec(), a.reshape(-1, 1, order="F"))
    same(A.hstack(C).vstack(C.hstack(A)), np.vstack([np.hstack([a, c]), np.hstack([c, a])]))


REWRITES = {
    "Row": lambda A, B: [A.t().row(1), (A + 2).row(1), (A * 2).row(1), (A + B).row(1), (A * B).row(1), (A / B).row(1), (A @ B.T).row(1)],
    "Col": lambda A, B: [A.t().col(1), (A + 2).col(1), (A * 2).col(1), (A + B).col(1), (A * B).col(1), (A @ B.T).col(1)],
    "Cell": lambda A, B: [A.t().selection(1, 0), (A + 2).selection(0, 1), (A * 2).selection(0, 1), (A + B).selection(0, 1), (A * B).selection(0, 1), (A @ B.T).selection(0, 1), (A**2).selection(1, 1)],
    "Sums": lambda A, B: [f(x) for f in (Matrix.row_sum, Matrix.col_sum, Matrix.sum) for x in (A.t(), A + 2, A * 2, A + B, A @ B.T, A.add_scalar(2, densify=True))],
    "Trace": lambda A, B: [x.trace() for x in ((A @ B.T).t(), (A @ B.T) + 2, (A @ B.T) * 2, A @ B.T + B @ A.T, A @ B.T)],
}


@pytest.mark.parametrize("kind", REWRITES)
@pytest.mark.parametrize("full", [True, False])
def test_rewritten_equals_given(spark, m, kind, full):
    a, b = np.array([[1, 0, 2], [0, 3, -1.0]]), np.array([[2, 0, 5], [4, 1, 1.0]])
    for x in REWRITES[kind](m(a, keep_zeros=full), m(b)):
        plain, new = (sorted(map(tuple, lower(spark, e).collect())) for e in (x.expr, rewrite(x.expr)))
        assert str(plain) == str(new), x.explain()


def test_rewrites_avoid_the_product(m):
    a, b = m(MAT1), m(MAT2)
    assert describe((a @ b).sum().optimized()) == "Sum(MatMul(ColSum(Source(4x4)), RowSum(Source(4x4))))".replace("Source(", "Source(")
    assert describe((a @ b).trace().optimized()) == "Sum(Hadamard(Transpose(Source(4x4)), Source(4x4)))"
    assert describe(a.t().t().optimized()) == "Source(4x4)"
    assert describe((a @ b).row(1).optimized()) == "MatMul(Row(Source(4x4), index=1), Source(4x4))"
    assert "AddScalar(RowSum" in describe(m(MAT1, keep_zeros=True).add_scalar(1).row_sum().optimized())
    assert "RowSum(AddScalar" in describe(a.add_scalar(1).row_sum().optimized())


def test_chain_order():
    s = lambda r, c: X.Source(None, (r, c))
    e = chain_order([s(10, 1000), s(1000, 10), s(10, 1000)])
    assert describe(e) == "MatMul(MatMul(Source(10x1000), Source(1000x10)), Source(10x1000))"
    assert describe(rewrite(X.MatMul(X.MatMul(s(1000, 10), s(10, 1000)), s(1000, 1)))) == "MatMul(Source(1000x10), MatMul(Source(10x1000), Source(1000x1)))"


def test_pushdown_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    from_numpy(spark, MAT1).write_parquet(path)
    plan = from_parquet(spark, path, (4, 4)).row(2).df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(i), EqualTo(i,2)]" in plan and "ReadSchema: struct<i:bigint,j:bigint,v:double>" in plan
    both = (from_parquet(spark, path, (4, 4)) @ from_parquet(spark, path, (4, 4))).selection(1, 2).df._jdf.queryExecution().toString()
    assert "EqualTo(i,1)" in both and "EqualTo(j,2)" in both
    same(from_parquet(spark, path, (4, 4)), MAT1)


def test_active_cells_and_division(spark, m):
    a = m(np.array([[2, 0], [0, -1.0]]))
    same(a.add_scalar(1), [[3, 0], [0, 0]])
    same(a.add_scalar(1, densify=True), [[3, 1], [1, 0]])
    same(a.power(0), [[1, 0], [0, 1]])
    same(a.power(0, densify=True), np.ones((2, 2)))
    full, zero = m(np.array([[1, -1, 0, 4.0]]), keep_zeros=True), m(np.array([[0, 0, 0, 2.0]]), keep_zeros=True)
    same(full / zero, [[np.inf, -np.inf, np.nan, 2]])
    same(m(np.array([[1, 2.0]])) / m(np.array([[0, 4.0]])), [[0, 0.5]])  # an absent divisor leaves no cell
    same(a.equals_scalar(0), [[0, 1], [1, 0]])
    same(a.equals_scalar(2), [[1, 0], [0, 0]])
    assert a.num_actives().item() == 2 and zero.num_nonzeros().item() == 1 and zero.prune().num_actives().item() == 1
    assert a.selection(0, 1).item() == 0.0


def test_rank_one_and_blas(m):
    a, x, y = np.array([[1, 0], [0, 0.0]]), np.array([[1], [2.0]]), np.array([[3], [-1.0]])
    same(m(a).matrix_rank_one_update(m(x)), a + x @ x.T)
    same(blas.syr(4, m(x), m(a)), 4 * x @ x.T + a)
    same(blas.syr(-4, m(x), m(a)), -4 * x @ x.T + a)
    same(blas.axpy(2, m(x), m(y)), 2 * x + y)
    same(blas.gemv(2, m(a), m(x), 3, m(y)), 2 * a @ x + 3 * y)
    same(blas.gemm(2, m(a), m(a), -1, m(a)), 2 * a @ a - a)
    assert blas.dot(m(x), m(y)).item() == 1.0
    same(blas.scal(2, blas.copy(m(x))), 2 * x)
    assert np.isclose(m(a + 2).frobenius().item(), np.linalg.norm(a + 2))


def test_blocked_agrees_with_coo(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(13, 7)), rng.normal(size=(7, 9))
    spark.conf.set("tessera.block.size", "4")
    try:
        same(from_numpy(spark, a).matrix_multiply(from_numpy(spark, b), how="blocked"), a @ b)
        same(from_numpy(spark, a).t().t().matrix_multiply(from_numpy(spark, b), how="coo"), a @ b)
        assert conf(spark, "tessera.block.size") == 4
    finally:
        spark.conf.unset("tessera.block.size")


def test_gram_of_rows(spark):
    a = np.arange(12.0).reshape(4, 3)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(a)] + [(None, [1.0, 1.0, 1.0]), (9, None)], "i long, x array<double>")
    x = from_rows(df, "i", "x", (4, 3), dense=True)
    same(x.T @ x, a.T @ a)
    same(x.row_sum(), a.sum(1, keepdims=True))
    assert "MapInArrow" in (x.T @ x).df._jdf.queryExecution().toString()


def test_rows_that_are_absent_repeated_or_hold_nulls(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (2, [3.0, None]), (2, [1.0, 1.0])], "i long, x array<double>")
    for parts in (1, 3):
        x = from_rows(df.repartition(parts), "i", "x", (4, 2))
        a = np.array([[1, 2], [0, 0], [4, 1], [0, 0.0]])
        same(x, a)
        same(x.T @ x, a.T @ a)
        assert x.add_scalar(1).sum().item() == 12 and x.add_scalar(1, densify=True).sum().item() == 16


def test_nan_stays_nan_in_every_product(spark):
    a = np.array([[1, np.nan], [2, 3.0]])
    x = from_numpy(spark, a)
    rows = from_rows(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(a)], "i long, x array<double>"), "i", "x", (2, 2), dense=True)
    want = np.array([[5, np.nan], [np.nan, np.nan]])
    for got in (x.T.matrix_multiply(x, how="coo"), x.T.matrix_multiply(x, how="blocked"), rows.T @ rows):
        assert np.array_equal(got.to_numpy(), want, equal_nan=True) and got.df.filter("v is null").isEmpty()


def test_updates_and_quotients_are_exact(spark):
    x, a = np.array([[0.1], [3.0], [7.0]]), np.arange(9.0).reshape(3, 3)
    for alpha in (2, 3, -3, 0.1):
        got = blas.syr(alpha, from_numpy(spark, x), from_numpy(spark, a)).to_numpy()
        assert np.array_equal(got, a + alpha * (x @ x.T))
    spark.conf.set("tessera.broadcast.bytes", "1")
    spark.conf.set("tessera.outer.rows", "2")
    try:
        assert np.array_equal(blas.syr(2, from_numpy(spark, x), from_numpy(spark, a)).to_numpy(), a + 2 * (x @ x.T))
    finally:
        spark.conf.unset("tessera.broadcast.bytes")
        spark.conf.unset("tessera.outer.rows")
    m = from_numpy(spark, a - 4)
    assert np.array_equal((m / 3).to_numpy(), (a - 4) / 3)
    with np.errstate(all="ignore"):
        assert np.array_equal((m / 0).to_numpy(), (a - 4) / 0.0, equal_nan=True)


def test_vectors_equality_and_sparse_conversion(spark):
    from pyspark.ml.linalg import Vectors

    a = np.array([[0, 2.0, 0], [0, 0, 5]])
    m = from_numpy(spark, a, keep_zeros=False)
    for v in ([1, 2, 3], Vectors.dense([1, 2, 3]), Vectors.sparse(3, [0, 1, 2], [1.0, 2.0, 3.0])):
        same(m @ from_vector(spark, v), a @ np.array([[1], [2], [3]]))
        assert from_vector(spark, v, row=True).shape == (1, 3)
    back = m.to_ml_sparse()
    assert np.array_equal(back.toArray(), a) and len(back.values) == 2 and from_ml(spark, back).equals(m)
    assert m.equals(m.to_dense()) and not m.equals(m.t()) and not m.equals(m * 1.01) and m.equals(m * 1.01, 0.1)
    assert from_numpy(spark, [[np.nan]]).equals(from_numpy(spark, [[np.nan]]))
    total = spark.sparkContext.accumulator(0.0)
    m.foreach_active(lambda i, j, v: total.add(v + i + j))
    assert total.value == 7 + 1 + 0 + 1 + 2


def test_empty_and_zero_matrices(spark):
    none = from_coo(spark.createDataFrame([], "i long, j long, v double"), shape=(3, 2))
    assert none.sum().item() == 0.0 and none.selection(2, 1).item() == 0.0
    same(none.T @ none, np.zeros((2, 2)))
    same(none.row_sum(), np.zeros((3, 1)))
    assert none.to_dense().num_actives().item() == 6
    assert from_coo(spark.createDataFrame([], "i long, j long, v double")).shape == (0, 0)
    assert from_coo(spark.createDataFrame([], "i long, j long, v double")).to_dense().sum().item() == 0.0


def test_coordinate_lists(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 2, 0.0), (None, 1, 5.0), (1, 1, None), (2, 0, -1.0)], "i long, j long, v double")
    a = from_coo(df)
    same(a, [[3, 0, 0], [0, 0, 0], [-1, 0, 0]])
    assert a.num_actives().item() == 2 and from_coo(df, keep_zeros=True).num_actives().item() == 3
    same(from_sparse_arrays(spark, (3, 3), [0, 2, 3, 6], [0, 2, 1, 0, 1, 2], [1.0, 2, 3, 4, 5, 6]), SP1)
    same(from_sparse_arrays(spark, (3, 3), [0, 2, 3, 6], [0, 2, 1, 0, 1, 2], [1.0, 2, 3, 4, 5, 6], by_row=True), SP1.T)


def test_generators_and_conversion(spark):
    same(zeros(spark, 2, 3), np.zeros((2, 3)))
    same(ones(spark, 2, 3), np.ones((2, 3)))
    for f in (eye, speye):
        same(f(spark, 3), np.eye(3))
    for f in (diag, spdiag):
        same(f(spark, [1, 0, 2]), np.diag([1, 0, 2]))
    u = rand(spark, 30, 20, -1, 1, seed=3).to_numpy()
    assert u.min() >= -1 and u.max() < 1 and len(np.unique(u)) == 600
    assert abs(randn(spark, 50, 50, seed=1).to_numpy().mean()) < 0.1
    for f in (sprand, sprandn):
        assert f(spark, 17, 9, 0.13, seed=5).num_actives().item() == np.ceil(17 * 9 * 0.13)
        assert f(spark, 3, 3, 0).sum().item() == 0.0
        assert f(spark, 3, 3, 1).num_actives().item() == 9
    a = from_numpy(spark, MAT2)
    same(from_ml(spark, a.to_ml()), MAT2)
    assert {r.i: r["values"] for r in a.rows_as_arrays().collect()}[1] == [3, 4, 5, 7]
    assert {r.j: r["values"] for r in a.cols_as_arrays().collect()}[2] == [4, 5, 0, 4]
    same(a.cut(), MAT2)
    same(a.cached() - a, np.zeros((4, 4)))


def test_shape_errors(m):
    a, b = m(np.ones((2, 3))), m(np.ones((2, 2)))
    for wrong in (lambda: a.row(2), lambda: a.col(-1), lambda: a.selection(0, 3), lambda: a.trace(), lambda: a + b, lambda: a * b, lambda: a / b, lambda: a @ b, lambda: b.matrix_rank_one_update(b), lambda: a.divide_vector(b), lambda: a.vstack(b), lambda: a.item(), lambda: a.to_numpy(limit=5)):
        with pytest.raises(ShapeError):
            wrong()


def test_partitioners(spark):
    df = from_numpy(spark, np.ones((8, 8))).df
    for out in (partitioning.by_row(df, 4, 2), partitioning.by_column(df, 4, 2), partitioning.block_cyclic(df, (8, 8), 2, 4)):
        assert out.count() == 64
    cyclic = partitioning.block_cyclic(df, (8, 8), 2, 4)
    sizes = [len(x) for x in cyclic.rdd.glom().collect()]
    assert sorted(sizes) == [16, 16, 16, 16]
    assert partitioning.grid_shape(1, 1000) == (1, 64) and partitioning.grid_shape(1000, 1000) == (8, 8)


def test_streaming_sums(spark, tmp_path):
    from tessera.streaming import running_cells, running_col_sum, running_row_sum

    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 4.0), (0, 0, 1.0)], "i long, j long, v double")
    cells.write.parquet(str(tmp_path / "in"))
    for f, want in ((running_row_sum, {(0, 0, 4.0), (1, 0, 4.0)}), (running_col_sum, {(0, 0, 6.0), (0, 1, 2.0)}), (running_cells, {(0, 0, 2.0), (0, 1, 2.0), (1, 0, 4.0)})):
        stream = spark.readStream.schema("i long, j long, v double").parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(f.__name__).start()
        q.processAllAvailable()
        q.stop()
        assert {tuple(r) for r in spark.table(f.__name__).select("i", "j", "v").collect()} == want
