"""Helpers shared by the operators: bounded Arrow batches, checkpoints, row keys, samples, connected components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of text that a Python worker works on at once; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Rows of two ids that one task reads alone instead of a task for every shuffle partition.
FEW = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that what a worker makes of one is bounded, whatever the session's batch size."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        first = held = 0
        for k, n in enumerate(sizes):
            if k > first and (held + n > BATCH_BYTES or k - first >= BATCH_ROWS):
                yield b.slice(first, k - first)
                first, held = k, 0
            held += n
        yield b.slice(first)
    give_back()


def batched(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` whose batches end at BATCH_BYTES, also before a worker cuts them: the executor fills a whole batch outside its heap and
    the worker reads it whole, a task each, so Spark's 64 MB would hold several times that in every executor. Spark reads the limit from
    the session when the rows are computed; it is lowered there, never raised, and no result depends on it."""
    limit, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    bytes_now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < bytes_now <= BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns memory that this worker no longer uses; the pools of Arrow and of the C library would keep it as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def with_text(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents and the name of the column that holds their texts as strings: ``text`` where it does, else a copy called ``name`` or like it."""
    if ("text", "string") in docs.dtypes:
        return docs, "text"
    name = free(docs, name)
    return docs.withColumn(name, F.col("text").cast("string")), name


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets one of its own and a cluster an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return folder or sc.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _settled(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint and its rows, without what Catalyst has inferred: in loops the constraints multiply from round to round, and the size
    estimates, products over all joins, grow to numbers of millions of digits. At most FEW rows are read as one partition, which joins
    and aggregates without a shuffle."""
    df = checkpoint(df)
    rows = df.count()
    fresh = DataFrame(df.sparkSession._jsparkSession.createDataFrame(df._jdf.rdd(), df._jdf.schema()), df.sparkSession)
    return (fresh.coalesce(1) if rows <= FEW else fresh), rows


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Over all shuffle partitions, also where ``df`` is dealt by these columns already: what follows makes many
    rows of each, which AQE cannot know when it joins small partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*by, F.lit("spread")))


def free(df: DataFrame, name: str) -> str:
    """``name``, or where ``df`` has it already the name with underscores behind it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """What only rows with the same id and text share (a null text counts as empty); rows without an id sort last."""
    i = F.col(key).cast("bigint")
    key = F.struct(i.isNull().alias("none"), i.alias("id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("hash"))
    return key.cast("struct<none:boolean,id:bigint,hash:bigint>")  # as it comes back from Python, so that joins need no cast


def labelled_sample(docs: DataFrame, chosen: DataFrame, by: str, chars: int) -> DataFrame:
    """``doc_id, <by>, text`` of the labelled rows ``chosen`` (``doc_id, <by>``; few, as the caller limits them).

    One text for each label (of documents that repeat an id, the smallest). For each value of ``by`` the texts are
    taken in the order of a hash of their id as long as they have at most ``chars`` characters together."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the labels are limited by the caller, and so is the broadcast side
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", by).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    found = checkpoint(joined.withColumn("chars", F.char_length("text").cast("bigint")))
    order = Window.partitionBy(by).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = found.select("doc_id", by, F.sum("chars").over(order).alias("upto")).filter(F.col("upto") <= chars).select("doc_id", by)
    return found.join(F.broadcast(fits), ["doc_id", by]).select("doc_id", by, "text")


def learned(sample: DataFrame, by: str, train: Callable[[pa.Array, np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``train`` makes of the sample's texts and labels. It runs in one task: the sample is bounded, and the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = pa.Table.from_batches(held) if held else pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("text", pa.string())]).empty_table()
        rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        texts, marks = rows["text"].combine_chunks(), rows["label"].to_numpy()
        del held, rows
        model = train(texts, marks)
        del texts
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model.dtype.str]), pa.array([list(model.shape)]), pa.array([model.tobytes()])], ["kind", "shape", "model"])

    slim = sample.select("doc_id", F.col(by).cast("int").alias("label"), "text")
    got = batched(slim.repartition(1), run, "kind string, shape array<bigint>, model binary").collect()
    # an empty sample may have no task at all
    return np.frombuffer(got[0].model, got[0].kind).reshape(got[0].shape) if got else train(pa.array([], pa.string()), np.zeros(0, np.int32))


def _scramble(x: Column) -> Column:
    """A bijection of 64-bit integers (a Feistel network over a hash), so that the smallest label is a random node."""
    low = F.lit(0xFFFFFFFF).cast("bigint")
    left, right = F.shiftrightunsigned(x, 32), x.bitwiseAND(low)
    for salt in range(3):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(salt)).bitwiseAND(low))
    return F.shiftleft(left, 32).bitwiseOR(right)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges ``a, b`` (bigint): ``node, label`` for every node with an edge.

    Contraction: each node takes the smallest label in its neighbourhood (ids are scrambled first, so
    in expectation a fixed share of the nodes goes in each round, whatever the shape), edges are
    renamed, loops and repeats go. The maps of the rounds are then composed backwards. Minima combine
    before the shuffle; renaming is an equi-join whose hot side AQE may split.
    """
    edges, _ = _settled(edges.select("a", "b"))  # read twice below
    e = edges.select(_scramble(F.col("a")).alias("a"), _scramble(F.col("b")).alias("b")).filter("a <> b").distinct()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    (e, left_over), maps = _settled(e), []
    while left_over:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to, _ = _settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
        maps.append(to)
        left = e.join(to.select(F.col("n").alias("a"), F.col("m").alias("x")), "a").select("x", "b")
        new = left.join(to.select(F.col("n").alias("b"), F.col("m").alias("y")), "b").filter("x <> y")
        e, left_over = _settled(new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    label = None
    for to in reversed(maps):
        if label is None:
            label = to.select("n", F.col("m").alias("label"))
        else:
            later = label.select(F.col("n").alias("m"), "label")
            label, _ = _settled(to.join(later, "m", "left").select("n", F.coalesce("label", "m").alias("label")))
    if label is None:
        return nodes.select("node", F.col("node").alias("label"))
    return nodes.withColumn("n", _scramble(F.col("node"))).join(label, "n", "left").select("node", F.coalesce("label", "n").alias("label"))
