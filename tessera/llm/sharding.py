"""Contiguous, balanced shards from global prefix sums of byte sizes.

Rows are range-partitioned in their order (doc_id, then checksum and size, equal rows at random); every partition
contributes one total, the running totals of those give each partition its offset, and the offset
plus the running size inside the partition is the row's global position in bytes. Cutting the
position of each row's middle at equal targets gives shards of consecutive rows whose sizes differ from
the target by less than the largest row. Only a few bytes a row are shuffled, never its text.

Rows: a null text counts as no bytes; null doc_ids come first; repeated rows are separate rows; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

OVERHEAD = 8


def byte_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + OVERHEAD).cast("bigint")


def checksum(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def positions(sizes: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Adds ``start`` (bytes of all earlier rows), ``number`` (how many) and ``total`` to rows with a ``size``."""
    # pinned, as the partition number below must mean the same rows in every later use
    ranged = checkpoint(sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy(*order)
    run = ranged.select("*", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(within).alias("rank"))
    placed = run.join(F.broadcast(offsets), "part")  # at most ``parts`` rows
    return placed.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).withColumn("number", F.col("first") + F.col("rank") - 1).drop("part", "upto", "rank", "base", "first")


def shards(docs: DataFrame, n: int = 24, parts: int | None = None, text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; law is always ``bytes``."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), byte_size(text).alias("size"), checksum(text).alias("text_crc32"), F.rand(7).alias("salt"))
    # the salt only parts rows that are equal in all else, so that many of them share no range
    placed = positions(sizes, ["doc_id", "text_crc32", "size", "salt"], parts)
    cut = placed.withColumn("shard", F.expr(f"least({n - 1}, cast(((2 * start + size) * {n}) div (2 * total) as int))"))
    # shards are consecutive: a row's slot is its distance from the first row of its shard
    opens = cut.groupBy("shard").agg(F.min("number").alias("opens"))
    out = cut.join(F.broadcast(opens), "shard")  # at most n rows
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("number") - F.col("opens")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
