"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r bits of each. Every
*distinct* fingerprint emits its ball of radius r, the variants are shuffled, and fingerprints that
meet are linked. All members of a variant's bucket are within r bits of it, so a bucket holds at most
one ball of fingerprints and any two of its members are within 2r bits: the chain of neighbours
in sorted order links the bucket completely without its pairs. Links are verified all the same.

Rows: a null text is an empty one; a text without words has fingerprint zero and links like any other.
Repeated rows stay separate rows of one class. A null doc_id keeps its row and never names a class
that has another id. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpoint, components, spread

_CHUNK = 1 << 15


def shingle_hashes(words: list[bytes], size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every space-joined run of ``size`` words, in chunks; fewer words make one run, none no run."""
    if not words:
        return
    if len(words) < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - size + 1, _CHUNK):
        part = words[at : at + _CHUNK + size - 1]
        text = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends[:-size].tolist()]
        yield np.array([digest(text[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def majority(chunks: Iterator[np.ndarray]) -> int:
    """The 64-bit number whose bits are set in over half of the hashes; 0 for none."""
    total, n = np.zeros(64, dtype=np.int64), 0
    for h in chunks:
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint(text: str | bytes | None, size: int = 3, seed: int = 42) -> int:
    raw = text.encode() if isinstance(text, str) else text or b""
    return majority(shingle_hashes(raw.lower().split(), size, seed))  # bytes: A-Z and ASCII white space only


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, "text"):
        texts = b.column("text").cast(pa.binary())
        fp = np.array([fingerprint(x.as_py(), size, seed) for x in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed integer)."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(partial(_fingerprints, size=size, seed=seed), "doc_id bigint, fp bigint")


def masks(bits: int, radius: int) -> list[int]:
    """All patterns of at most ``radius`` set bits, as signed 64-bit numbers."""
    out = level = [0]
    for _ in range(radius):
        level = sorted({m | 1 << k for m in level for k in range(bits) if not m >> k & 1})
        out = out + level
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, radius: int = 1) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints ``fp`` that connect what is within 2 * radius bits."""
    ball = F.array(*[F.lit(m).cast("bigint") for m in masks(64, radius)])
    variants = spread(distinct, "fp").select("fp", F.explode(ball).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), "fp")
    met = variants.groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter("size(fps) > 1")
    pair = F.explode(F.arrays_zip(F.slice("fps", 1, F.size("fps") - 1).alias("a"), F.slice("fps", 2, F.size("fps") - 1).alias("b"))).alias("p")
    pairs = met.select(pair)
    a, b = pairs.schema["p"].dataType.names
    return pairs.select(F.col(f"p.{a}").alias("a"), F.col(f"p.{b}").alias("b")).distinct().filter(differing("a", "b") <= 2 * radius)


def classes(docs: DataFrame, size: int = 3, seed: int = 42, radius: int = 1) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id reachable over links of at most 2 * radius bits."""
    prints = checkpoint(fingerprints(docs, size, seed))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(distinct.select("fp"), radius))
    named = distinct.join(linked.select(F.col("node").alias("fp"), "label"), "fp", "left")
    lone = named.filter("label is null").select("fp", F.col("first").alias("component_id"))
    grouped = named.filter("label is not null")
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    found = lone.unionByName(grouped.join(smallest, "label").select("fp", "component_id"))
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")
