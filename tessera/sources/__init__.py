"""Matrices from DataFrames, arrays, block tables and generators."""

from .blocks import from_blocks, to_block_table
from .tables import from_coo, from_ml, from_numpy, from_parquet, from_rows, from_sparse_arrays, from_vector
from .generators import diag, eye, ones, rand, randn, spdiag, speye, sprand, sprandn, zeros

__all__ = [
    "diag", "eye", "from_blocks", "from_coo", "from_ml", "from_numpy", "from_parquet", "from_rows", "from_sparse_arrays", "from_vector", "ones", "rand",
    "randn", "spdiag", "speye", "sprand", "sprandn", "to_block_table", "zeros",
]
