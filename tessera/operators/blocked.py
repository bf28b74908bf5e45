"""Dense products through numpy.

``gram`` folds each Arrow batch of row arrays into one n x n accumulator per task; ``blocked_product``
joins b x b blocks on the inner block index and multiplies them batch by batch. Both hand partial
results to an ordinary ``groupBy(i, j).sum``, so no task ever holds a whole operand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COO = "i bigint, j bigint, v double"
#: Output blocks held by a task before they are handed on.
HELD = 64


def _cells(rid: int, cid: int, size: int, block: np.ndarray) -> pa.RecordBatch:
    """Built from numpy as it is: NaN is a value here, not a null."""
    i, j = np.indices(block.shape, dtype=np.int64)
    columns = (i + rid * size).ravel(), (j + cid * size).ravel(), np.ascontiguousarray(block, np.float64).ravel()
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "v"])


def gram(rows: DataFrame, n: int) -> DataFrame:
    """XᵀX of a matrix stored as ``values array<double>`` rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((n, n)), False
        for b in batches:
            x = b.column(0)
            if len(x):
                flat = np.asarray(x.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(x), n)
                total += flat.T @ flat
                seen = True
        if seen:
            yield _cells(0, 0, n, total)

    return rows.select("values").mapInArrow(fold, COO).groupBy("i", "j").agg(F.sum("v").alias("v"))


def to_blocks(df: DataFrame, shape: tuple[int, int], size: int) -> DataFrame:
    """``rid, cid, nrows, ncols, pos, vals`` : the active cells of each block, positions row-major."""
    m, n = shape
    keyed = df.select(F.expr(f"i div {size}").cast("int").alias("rid"), F.expr(f"j div {size}").cast("int").alias("cid"), F.expr(f"int((i % {size}) * {size} + j % {size})").alias("p"), "v")
    packed = keyed.groupBy("rid", "cid").agg(F.collect_list(F.struct("p", "v")).alias("c"))
    return packed.select(
        "rid", "cid",
        F.least(F.lit(size), F.lit(m) - F.col("rid") * size).cast("int").alias("nrows"),
        F.least(F.lit(size), F.lit(n) - F.col("cid") * size).cast("int").alias("ncols"),
        F.col("c.p").alias("pos"), F.col("c.v").alias("vals"),
    )


def blocked_product(a: DataFrame, b: DataFrame, sa: tuple[int, int], sb: tuple[int, int], size: int) -> DataFrame:
    left = to_blocks(a, sa, size).select("rid", F.col("cid").alias("kid"), F.col("pos").alias("ap"), F.col("vals").alias("av"))
    right = to_blocks(b, sb, size).select(F.col("rid").alias("kid"), "cid", F.col("pos").alias("bp"), F.col("vals").alias("bv"))
    m, n = sa[0], sb[1]

    def dense(pos, vals) -> np.ndarray:
        out = np.zeros(size * size)
        out[np.asarray(pos)] = np.asarray(vals)
        return out.reshape(size, size)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out(key):
            block = held.pop(key)
            return _cells(*key, size, block[: m - key[0] * size, : n - key[1] * size])

        for f in batches:
            for k in range(f.num_rows):
                rid, cid = f.column("rid")[k].as_py(), f.column("cid")[k].as_py()
                ap, av, bp, bv = (f.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("ap", "av", "bp", "bv"))
                product = dense(ap, av) @ dense(bp, bv)
                if (rid, cid) in held:
                    held[rid, cid] += product
                else:
                    held[rid, cid] = product
                    if len(held) > HELD:
                        yield out(next(iter(held)))
        while held:
            yield out(next(iter(held)))

    return left.join(right, "kid").select("rid", "cid", "ap", "av", "bp", "bv").mapInArrow(multiply, COO).groupBy("i", "j").agg(F.sum("v").alias("v"))
