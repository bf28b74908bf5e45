"""Vector and matrix routines in the usual level 1 to 3 naming, over Matrix handles."""

from .blas import axpy, copy, dot, gemm, gemv, scal, syr

__all__ = ["axpy", "copy", "dot", "gemm", "gemv", "scal", "syr"]
