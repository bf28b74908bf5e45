"""Exact top-k inner products by tiles.

Queries and candidates are packed into blocks of at most one Arrow batch of rows. Every query tile meets every
candidate block once, on an equi-join by shard (the tiles are repeated for each shard; the
blocks are dealt over them, more of them as the table grows), as one matrix product. Each product keeps the best of a query, a task
merges what it has for a tile before handing it on, and the lists of the tasks are merged as a tree: by query and
group of tasks, then by query. No task holds more than its blocks and 64 tiles of results.

Scores are whole numbers: products run in float64 while every sum stays below 2**53 and in Python integers
beyond; a score is a long, so one beyond 64 bits is the largest long and ties there go by id. Vectors that are null or hold a null
or a non-finite component take no part, nor do rows without an id; only vectors of one length are compared. Each row that is a
query has its own answers and is left out of them itself, once: other rows of its id, equal ones too, are candidates like any other.
An empty table, or one without queries, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Tiles of results a task holds, rows of a block, candidates of a shard, and tasks whose lists are merged first.
HELD, BLOCK, SHARD, GROUP = 64, 1024, 1 << 16, 32


def whole(rows: pa.RecordBatch, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions in the batch and the matrix of floor(scale * x)."""
    lists = rows.column("embedding")
    lengths = np.diff(lists.offsets.to_numpy())
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    return {int(n): (at, flat[starts[at][:, None] + np.arange(n)]) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]}


def _pack(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    kinds = [("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("m", pa.binary())]
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            b = batch.slice(k, BLOCK)
            row, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id"))
            packed = [(n, row[at].astype("<i8").tobytes(), ids[at].astype("<i8").tobytes(), m.astype("<f8").tobytes()) for n, (at, m) in whole(b, scale).items()]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in packed], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    full = to_int(q) @ to_int(c).T if q.shape[1] else np.zeros((len(q), len(c)), object)
    return np.clip(full, -(2**63), 2**63 - 1).astype(np.int64)


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of each row's k largest scores, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    s, ids = s[:, order], ids[order]
    if s.shape[1] > 4 * k:  # narrow to what reaches the k-th largest score, with its ties
        row, col = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k][:, None])
    else:
        row, col = (x.ravel() for x in np.indices(s.shape))
    return first(row, ids[col], s[row, col], k)


def first(row: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.lexsort((ids, ~value, row))  # ~v falls as v rises, without overflow
    row, ids, value = row[at], ids[at], value[at]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], value[keep]


def _products(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, tuple] = {}

    def out(tile):
        rows, ids, own, (at, found, value) = held.pop(tile)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[at], ids[at], own[at], found, value)], ["row", "query_id", "own", "vec_id", "score"])

    for b in batches:
        for r in b.to_pylist():
            n, ci = r["dim"], np.frombuffer(r["ids"], "<i8")
            q = np.frombuffer(r["qm"], "<f8").reshape(-1, n)
            new = best(scores(q, np.frombuffer(r["m"], "<f8").reshape(len(ci), n)), ci, k)
            if (tile := r["qrows"]) in held:
                *query, old = held[tile]
                held[tile] = (*query, first(*(np.concatenate(x) for x in zip(old, new, strict=True)), k))
            else:
                own = np.array([scores(x[None], x[None])[0, 0] for x in q], np.int64)
                held[tile] = (np.frombuffer(tile, "<i8"), np.frombuffer(r["qids"], "<i8"), own, new)
            if len(held) > HELD:
                yield out(next(iter(held)))
    while held:
        yield out(next(iter(held)))


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, shards: int | None = None, tile: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row that ``is_query`` holds for, against all rows."""
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = usable.filter("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    shards = shards or max(16, -(-usable.count() // SHARD))
    asked = checkpoint(usable.filter(is_query).withColumn("row", F.monotonically_increasing_id()))
    asked = asked.repartition(max(1, -(-asked.count() // tile)), "row")
    kind = "dim int, rows binary, ids binary, m binary"
    blocks = usable.withColumn("row", F.lit(0).cast("bigint")).mapInArrow(partial(_pack, scale=scale), kind).withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    left = asked.mapInArrow(partial(_pack, scale=scale), kind).select("dim", F.col("rows").alias("qrows"), F.col("ids").alias("qids"), F.col("m").alias("qm"), every.alias("shard"))
    pairs = left.join(blocks, ["shard", "dim"]).select("dim", "qrows", "qids", "qm", "ids", "m")
    # one more than wanted, as the query's own row is among the candidates
    found = pairs.mapInArrow(partial(_products, k=k + 1), "row bigint, query_id bigint, own bigint, vec_id bigint, score bigint").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUP)))
    for by in (["row", "part"], ["row"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(Window.partitionBy("row"))
    found = found.withColumn("itself", F.coalesce(itself, F.lit(k + 2))).filter("rank <> itself")
    return found.withColumn("rank", F.col("rank") - (F.col("rank") > F.col("itself")).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
