"""Cross-site boilerplate lines by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by aggregation, map-side first.
Lines whose estimate is far above the threshold go, far below stay, and those within the sketch's
error of it get an exact distinct count. Lines that go are cut from every document.

A line is compared trimmed and must not be blank; blank lines stay. Null texts stay null and have no lines;
null sites are not counted; repeated rows and null doc_ids keep their rows, each cut by its own text; extra columns stay, whatever
their names (``n_lines`` and ``n_removed`` then get underscores behind them); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, columns, free, row_key

#: log2 of the sketch's registers; its relative error is about 1.04 / sqrt(2**LG_K), and estimates within BAND errors are counted exactly.
LG_K, BAND = 10, 5.0


def line_table(docs: DataFrame, site: str) -> DataFrame:
    """``key, site, pos, h``: the hash of every line that is not blank."""
    lines = docs.select(row_key().alias("key"), F.col(site).cast("string").alias("site"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c"))).filter("line <> ''").select("key", "site", "pos", F.xxhash64("line").alias("h"))


def widespread(lines: DataFrame, sites: int) -> DataFrame:
    """``h`` of the lines that occur on at least ``sites`` distinct sites."""
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", LG_K).alias("sketch")).select("h", F.hll_sketch_estimate("sketch").alias("about"))
    slack = BAND * 1.04 / (2**LG_K) ** 0.5
    spread = checkpoint(spread.filter(F.col("about") >= sites * (1 - slack) - 1))
    near = spread.filter(F.col("about") <= sites * (1 + slack) + 1).select("h")
    # repeats combine map-side before the join deals by line, so that a very common line is one row a site there
    pairs = lines.select("h", "site").filter("site is not null").distinct()
    exact = pairs.join(near, "h", "left_semi").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= sites)
    return spread.filter(F.col("about") > sites * (1 + slack) + 1).select("h").unionByName(exact.select("h"))


def remove(docs: DataFrame, sites: int = 5, site: str = "source") -> DataFrame:
    """The documents with widespread lines cut, and ``n_lines``, ``n_removed``."""
    lines = checkpoint(line_table(docs, site))  # read three times below
    gone = lines.join(widespread(lines, sites), "h", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("gone"))
    joined = docs.select(row_key().alias("key"), F.struct(*columns(docs)).alias("row")).join(gone, "key", "left")
    joined = joined.select("row", F.col("row.text").cast("string").alias("text"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    parts = F.split("text", "\n", -1)
    # what stays are the stretches between removed lines: one pass, however many there are
    ends = F.concat(F.array(F.lit(-1)), F.array_sort("gone"), F.array(F.size("lines")))
    cut = joined.withColumn("lines", parts).withColumn("ends", ends)
    kept = F.expr("flatten(transform(sequence(0, size(ends) - 2), k -> slice(lines, ends[k] + 2, ends[k + 1] - ends[k] - 1)))")
    text = F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    own = [text.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("bigint")
    return cut.select(*own, n_lines.alias(free(docs, "n_lines")), F.size("gone").cast("bigint").alias(free(docs, "n_removed")))
