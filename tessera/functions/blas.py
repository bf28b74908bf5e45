"""Level 1 to 3 routines. Matrices are immutable, so each returns its result."""

from __future__ import annotations

from ..matrix import Matrix


def axpy(a: float, x: Matrix, y: Matrix) -> Matrix:
    """a x + y"""
    return x.multiply_scalar(a).add_element(y)


def dot(x: Matrix, y: Matrix) -> Matrix:
    """xᵀy of two vectors of one shape, 1 x 1"""
    return x.multiply_element(y).sum()


def copy(x: Matrix) -> Matrix:
    return x


def scal(a: float, x: Matrix) -> Matrix:
    return x.multiply_scalar(a)


def syr(alpha: float, x: Matrix, a: Matrix) -> Matrix:
    """alpha x xᵀ + a, for a column vector x"""
    return a.matrix_rank_one_update(x, alpha)


def gemv(alpha: float, a: Matrix, x: Matrix, beta: float, y: Matrix) -> Matrix:
    """alpha a x + beta y"""
    return gemm(alpha, a, x, beta, y)


def gemm(alpha: float, a: Matrix, b: Matrix, beta: float, c: Matrix) -> Matrix:
    """alpha a b + beta c"""
    return c.gemm(a, b, alpha, beta)
