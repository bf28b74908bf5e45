"""Logical layer: expression tree, algebraic rewrites, lowering to DataFrames."""
