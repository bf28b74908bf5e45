"""Immutable matrix expressions.

Every node knows its shape and whether *all* of its cells are active (``dense``). A cell is active
when the sparse form holds a row for it; absent cells are implicit zeros. Shape errors are raised
when a node is built, so a wrong query fails before any job starts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any


class ShapeError(ValueError):
    """Operand dimensions do not fit the operator."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ShapeError(message)


@dataclass(frozen=True, eq=False)
class Expr:
    @property
    def children(self) -> tuple["Expr", ...]:
        return tuple(v for v in self.__dict__.values() if isinstance(v, Expr))

    @property
    def shape(self) -> tuple[int, int]:
        raise NotImplementedError

    @property
    def nrows(self) -> int:
        return self.shape[0]

    @property
    def ncols(self) -> int:
        return self.shape[1]

    @property
    def cells(self) -> int:
        return self.shape[0] * self.shape[1]

    @property
    def dense(self) -> bool:
        return False

    def with_children(self, new: tuple["Expr", ...]) -> "Expr":
        names = [k for k, v in self.__dict__.items() if isinstance(v, Expr)]
        return replace(self, **dict(zip(names, new, strict=True)))


@dataclass(frozen=True, eq=False)
class Source(Expr):
    """A DataFrame ``i, j, v``; ``rows`` optionally holds the same matrix as ``i, values array``."""

    df: Any
    size: tuple[int, int]
    full: bool = False
    rows: Any = None

    @property
    def shape(self):
        return self.size

    @property
    def dense(self):
        return self.full


@dataclass(frozen=True, eq=False)
class Unary(Expr):
    a: Expr

    @property
    def shape(self):
        return self.a.shape

    @property
    def dense(self):
        return self.a.dense


@dataclass(frozen=True, eq=False)
class Transpose(Unary):
    @property
    def shape(self):
        return self.a.ncols, self.a.nrows


@dataclass(frozen=True, eq=False)
class Row(Unary):
    index: int

    def __post_init__(self):
        _need(0 <= self.index < self.a.nrows, f"row {self.index} of a matrix with {self.a.nrows} rows")

    @property
    def shape(self):
        return 1, self.a.ncols


@dataclass(frozen=True, eq=False)
class Col(Unary):
    index: int

    def __post_init__(self):
        _need(0 <= self.index < self.a.ncols, f"column {self.index} of a matrix with {self.a.ncols} columns")

    @property
    def shape(self):
        return self.a.nrows, 1


@dataclass(frozen=True, eq=False)
class Cell(Unary):
    row: int
    col: int

    def __post_init__(self):
        _need(0 <= self.row < self.a.nrows and 0 <= self.col < self.a.ncols, f"cell ({self.row},{self.col}) outside {self.a.shape}")

    @property
    def shape(self):
        return 1, 1

    @property
    def dense(self):
        return True


@dataclass(frozen=True, eq=False)
class RowSum(Unary):
    @property
    def shape(self):
        return self.a.nrows, 1

    @property
    def dense(self):
        return self.a.dense and self.a.ncols > 0


@dataclass(frozen=True, eq=False)
class ColSum(Unary):
    @property
    def shape(self):
        return 1, self.a.ncols

    @property
    def dense(self):
        return self.a.dense and self.a.nrows > 0


@dataclass(frozen=True, eq=False)
class Sum(Unary):
    @property
    def shape(self):
        return 1, 1

    @property
    def dense(self):
        return True


@dataclass(frozen=True, eq=False)
class Trace(Sum):
    def __post_init__(self):
        _need(self.a.nrows == self.a.ncols, f"trace of a {self.a.shape} matrix")


@dataclass(frozen=True, eq=False)
class AddScalar(Unary):
    alpha: float


@dataclass(frozen=True, eq=False)
class MulScalar(Unary):
    alpha: float


@dataclass(frozen=True, eq=False)
class DivScalar(Unary):
    alpha: float


@dataclass(frozen=True, eq=False)
class Power(Unary):
    alpha: float


@dataclass(frozen=True, eq=False)
class MapValues(Unary):
    """``fn`` is a Column -> Column expression over active values; ``keep`` optionally filters (i, j, v)."""

    fn: Callable[[Any], Any] | None = None
    keep: Callable[[Any, Any, Any], Any] | None = None

    @property
    def dense(self):
        return self.a.dense and self.keep is None


@dataclass(frozen=True, eq=False)
class Densify(Unary):
    """Adds a stored zero for every absent cell."""

    @property
    def dense(self):
        return True


@dataclass(frozen=True, eq=False)
class Vec(Unary):
    @property
    def shape(self):
        return self.a.nrows * self.a.ncols, 1


@dataclass(frozen=True, eq=False)
class Binary(Expr):
    a: Expr
    b: Expr

    def __post_init__(self):
        _need(self.a.shape == self.b.shape, f"{type(self).__name__} of {self.a.shape} and {self.b.shape}")

    @property
    def shape(self):
        return self.a.shape


@dataclass(frozen=True, eq=False)
class Add(Binary):
    @property
    def dense(self):
        return self.a.dense or self.b.dense


@dataclass(frozen=True, eq=False)
class Hadamard(Binary):
    @property
    def dense(self):
        return self.a.dense and self.b.dense


@dataclass(frozen=True, eq=False)
class Divide(Hadamard):
    pass


@dataclass(frozen=True, eq=False)
class MatMul(Binary):
    #: None: chosen when lowered; else "coo" or "blocked".
    how: str | None = None

    def __post_init__(self):
        _need(self.a.ncols == self.b.nrows, f"product of {self.a.shape} and {self.b.shape}")

    @property
    def shape(self):
        return self.a.nrows, self.b.ncols

    @property
    def dense(self):
        return self.a.dense and self.b.dense and self.a.ncols > 0


@dataclass(frozen=True, eq=False)
class RankOne(Binary):
    """a + alpha b bᵀ for an n x 1 vector b."""

    alpha: float = 1.0

    def __post_init__(self):
        _need(self.b.ncols == 1, f"rank-one update needs a column vector, not {self.b.shape}")
        _need(self.a.shape == (self.b.nrows, self.b.nrows), f"rank-one update of {self.a.shape} by a vector of {self.b.nrows}")

    @property
    def dense(self):
        return self.a.dense or self.b.dense


@dataclass(frozen=True, eq=False)
class DivideVector(Binary):
    """Column c divided by entry c of a vector; a zero or absent divisor gives 0."""

    def __post_init__(self):
        _need(1 in self.b.shape and self.b.cells == self.a.ncols, f"{self.a.shape} divided by a vector of shape {self.b.shape}")

    @property
    def dense(self):
        return self.a.dense


@dataclass(frozen=True, eq=False)
class Stack(Binary):
    """b placed right of a (``across``) or below it."""

    across: bool = True

    def __post_init__(self):
        side = 0 if self.across else 1
        _need(self.a.shape[side] == self.b.shape[side], f"stacking {self.a.shape} and {self.b.shape}")

    @property
    def shape(self):
        (m, n), (p, q) = self.a.shape, self.b.shape
        return (m, n + q) if self.across else (m + p, n)

    @property
    def dense(self):
        return self.a.dense and self.b.dense


@dataclass(frozen=True, eq=False)
class EqualsScalar(Unary):
    """1.0 where |x - value| < tolerance, else 0.0; when 0 itself matches, absent cells do as well."""

    value: float
    tolerance: float = 1e-6

    @property
    def dense(self):
        return self.a.dense or abs(self.value) < self.tolerance
