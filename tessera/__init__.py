"""Matrix queries over Spark DataFrames: one row per active cell, algebra rewritten before Catalyst sees it."""

from .config import conf, session
from .matrix import Matrix
from .plans.expr import ShapeError

__all__ = ["Matrix", "ShapeError", "conf", "session"]
