"""Block tables: one row per block with its coordinates and a local matrix.

The struct has seven fields: type (1 dense, 0 sparse), numRows, numCols, colPtrs, rowIndices, values,
isTransposed. Dense values are column-major (row-major when transposed); sparse ones are compressed
columns (rows when transposed). Decoding is plain SQL, ragged last blocks included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..plans.expr import Source

BLOCK = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"


def from_blocks(df: DataFrame, shape: tuple[int, int], block_size: int, rid: str = "rid", cid: str = "cid", matrix: str = "matrix") -> Matrix:
    """Blocks that are missing are zero; two blocks with one key are summed."""
    b = df.select(F.col(rid).cast("bigint").alias("r"), F.col(cid).cast("bigint").alias("c"), F.col(matrix).cast(BLOCK).alias("m")).select("r", "c", "m.*")
    # position p of the values is (minor, major): the minor index runs fastest
    dense = b.filter("type = 1").select("*", F.posexplode("values").alias("p", "v"))
    step = F.when(F.col("isTransposed"), F.col("numCols")).otherwise(F.col("numRows"))
    dense = dense.select("r", "c", "isTransposed", (F.col("p") % step).alias("minor"), F.floor(F.col("p") / step).cast("int").alias("major"), "v")
    # a compressed slice per major index, then its entries
    at = F.posexplode(F.expr("transform(sequence(1, size(colPtrs) - 1), k -> named_struct('a', colPtrs[k - 1], 'n', colPtrs[k] - colPtrs[k - 1]))")).alias("major", "s")
    entry = F.explode(F.expr("transform(slice(rowIndices, s.a + 1, s.n), (r, t) -> named_struct('minor', r, 'v', values[s.a + t]))")).alias("e")
    sparse = b.filter("type = 0 and size(colPtrs) > 1").select("*", at).select("r", "c", "isTransposed", "major", entry).select("r", "c", "isTransposed", "e.minor", "major", "e.v")
    cells = dense.unionByName(sparse)
    i = F.when(F.col("isTransposed"), F.col("major")).otherwise(F.col("minor"))
    j = F.when(F.col("isTransposed"), F.col("minor")).otherwise(F.col("major"))
    out = cells.select((F.col("r") * block_size + i).cast("bigint").alias("i"), (F.col("c") * block_size + j).cast("bigint").alias("j"), "v")
    return Matrix(df.sparkSession, Source(out.groupBy("i", "j").agg(F.sum("v").alias("v")), tuple(shape)))


def to_block_table(m: Matrix, block_size: int) -> DataFrame:
    """``rid, cid, matrix`` with dense column-major blocks, one for each block with an active cell."""
    nrows, ncols, b = m.nrows, m.ncols, block_size
    keyed = m.df.select(F.expr(f"int(i div {b})").alias("rid"), F.expr(f"int(j div {b})").alias("cid"), F.expr(f"int(i % {b})").alias("r"), F.expr(f"int(j % {b})").alias("c"), "v")
    h = F.least(F.lit(b), F.lit(nrows) - F.col("rid") * b).cast("int")
    w = F.least(F.lit(b), F.lit(ncols) - F.col("cid") * b).cast("int")
    packed = keyed.groupBy("rid", "cid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c") * h + F.col("r"), "v"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), h * w - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    none = F.lit(None).cast("array<int>")
    block = F.struct(F.lit(1).cast("tinyint").alias("type"), h.alias("numRows"), w.alias("numCols"), none.alias("colPtrs"), none.alias("rowIndices"), values.alias("values"), F.lit(False).alias("isTransposed"))
    return packed.select("rid", "cid", block.alias("matrix"))
