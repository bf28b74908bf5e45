"""Near-duplicate removal: SimHash ball hashing first, then an exact similarity join for what fingerprints cannot reach.

Texts are near duplicates where their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Equal texts (after folding
case and outer punctuation) collapse first. Then every distinct 64-bit SimHash of a set emits all variants within one bit, those
that meet within two bits are candidates (``simhash.links``), and their sets are compared: this joins large groups of copies at a cost of one
ball a text. Pairs at 0.8 differ in about ten bits of 64, though, beyond any ball that could be emitted, so the rest is exact:
two sets at similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each, in whatever order all sets
are sorted by (prefix filter). Every text is dealt by these shingles, and texts of different components that meet are candidates unless
their sizes, the shingle's positions or the sets' parities rule the pair out. The sets of the rest are compared, so exactly the pairs at
SIMILARITY link. Shingles common in a sample of the texts come last in the order: it holds for any sample
and keeps shared passages out of the prefixes. A sample of bounded size misses passages that a small share of many texts holds, whose
buckets grow with the input; so the prefixes themselves are counted, shingles in more than FULL of them move back as well, and the
texts that held one there get a new prefix. No bucket is cut by this: it is another order, the same for all sets.

Only connected components are wanted, so a pair within a component is not compared: buckets of one label
go. The first round compares every row with the next one and the first one of its bucket, later rounds rows at most
STEP, STEP ** 2, ... places apart until every pair of different labels in every bucket has been compared. A large
group so costs two comparisons a row, and no bucket is cut.

Rows: null and empty texts are one group of equal texts; of each group the row with the smallest doc_id stays (one without an id
only if the group has no other), of rows that agree in id and text one. Extra columns of the kept rows stay, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, bounded, checkpoint, columns, components, row_key
from .simhash import links, majority, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: SIMILARITY as a ratio of integers: comparisons are exact.
OVER, UNDER = 4, 5
#: Texts of the sample that orders the shingles, and the most shingles taken to be common in it.
SAMPLE, COMMON = 5_000, 30_000
#: A shingle in more prefixes than FULL moves back in the order, the most frequent ones if there are more than MOVED; so often at most.
FULL, MOVED, MOVES = 8, 500_000, 3
#: How the distance compared in a bucket grows.
STEP = 32
#: Pairs or labels that are sent to every executor at most.
SMALL = 500_000
#: The types of the columns that Python workers return.
KEY = "key struct<none:boolean,id:bigint,hash:bigint>"
REPS = f"{KEY}, node bigint, n bigint, fp bigint, odd array<bigint>, head array<bigint>"
_EDGES = b".,;:!?\"'()[]{}*#%&$|"


def folded_words(text: bytes) -> list[bytes]:
    return [x for w in text.decode("utf-8", "replace").lower().encode().split() if (x := w.strip(_EDGES))]


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct hashes, sorted."""
    parts = list(shingle_hashes(words, SHINGLE, 42))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _prefix(h: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of which any set at SIMILARITY shares one in its own prefix: rare ones first, then by hash."""
    rank = np.zeros(len(h), np.int64)
    if len(common) and len(h):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[at] == h, often[at], 0)
    return h[np.lexsort((h, rank))[: len(h) - -(-OVER * len(h) // UNDER) + 1]]


def _parities(h: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each of 2 n bits or more, a power of two: where two sets differ, at most as many bits do."""
    width = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    parity = np.bincount((h % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _node(words: list[bytes]) -> int:
    """The id of a folded text."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, "text"):
        node = [_node(folded_words(x.as_py() or b"")) for x in b.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(node, pa.int64())], ["key", "node"])


def _prefixes(batches: Iterator[pa.RecordBatch], common: np.ndarray, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, "text"):
        node, n, fp, odd, head = [], [], [], [], []
        for x in b.column("text").cast(pa.binary()):
            words = folded_words(x.as_py() or b"")
            h = shingles(words)
            node.append(_node(words))
            n.append(len(h))
            fp.append(majority(h[k : k + (1 << 15)] for k in range(0, len(h), 1 << 15)))
            odd.append(_parities(h))
            head.append(_prefix(h, common, often).view(np.int64))
        fp = pa.array(np.array(fp, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), fp, *(pa.array(x, pa.list_(pa.int64())) for x in (odd, head))], ["key", "node", "n", "fp", "odd", "head"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, "text"):
        node, whole = [], []
        for x in b.column("text").cast(pa.binary()):
            words = folded_words(x.as_py() or b"")
            node.append(_node(words))
            whole.append(shingles(words).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(whole, pa.list_(pa.int64()))], ["node", "whole"])


def _common(slim: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several texts of a sample hold, and in how many of all texts by that (as a power of two)."""
    every = max(1, slim.count() // SAMPLE)
    sample = slim.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(every)) == 0)
    held = batched(sample, _sets, "node bigint, whole array<bigint>").select(F.explode("whole").alias("h"))
    top = held.groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], np.log2(top["count"].to_numpy() * every).astype(np.int64)[order]


def _frequent(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles in more than FULL prefixes, and in how many (as a power of two); MOVED at most, the rarest go."""
    held = reps.select(F.explode("head").alias("h")).groupBy("h").count().filter(F.col("count") > FULL)
    held = checkpoint(held.select("h", F.floor(F.log2("count")).alias("power")))
    least, room = 64, MOVED
    for r in held.groupBy("power").count().orderBy(F.desc("power")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["power"]
    top = held.filter(F.col("power") >= least).toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], top["power"].to_numpy().astype(np.int64)[order]


def _joined(common: np.ndarray, often: np.ndarray, h: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order with these shingles moved back, and which of them stood further ahead before."""
    every = np.union1d(common, h)
    before, now = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    before[np.searchsorted(every, common)] = often
    now[np.searchsorted(every, h)] = power
    return every, np.maximum(before, now), every[now > before]


def _moved(reps: DataFrame, slim: DataFrame, common: np.ndarray, often: np.ndarray) -> DataFrame:
    """``reps`` with the prefixes of an order in which shingles of many prefixes come late.

    Shingles only move back, so a prefix without one that moved stays as it is; the others are made anew. These reach further into
    their texts and may hold other frequent shingles, hence some rounds: what is left then is left to the buckets."""
    base, made, last = reps, None, reps
    for _ in range(MOVES):
        common, often, back = _joined(common, often, *_frequent(last))
        if not len(back):
            break
        table = reps.sparkSession.createDataFrame(pa.table({"h": pa.array(back.view(np.int64))}))
        # MOVED hashes at most
        touched = _sent(checkpoint(reps.select("node", F.explode("head").alias("h")).join(F.broadcast(table), "h", "left_semi").select("node").distinct()))
        old = reps.drop("head").join(touched, "node", "left_semi")
        texts = slim.withColumn("at", F.xxhash64("key")).join(_sent(checkpoint(old.select(F.xxhash64("key").alias("at")))), "at", "left_semi").select("key", "text")
        heads = batched(texts, partial(_prefixes, common=common, often=often), REPS).groupBy("node").agg(F.min("head").alias("head"))
        last = checkpoint(old.join(heads, "node"))
        # one list of nodes, whatever the round: it is sent along whenever the rows are read
        made = last if made is None else checkpoint(made.join(touched, "node", "left_anti").unionByName(last))
        reps = base.join(_sent(made.select("node")), "node", "left_anti").unionByName(made)
    return reps


def _possible(x: str, y: str) -> str:
    """Whether sets of these sizes, a shared shingle at these positions, can reach SIMILARITY."""
    most = f"least({x}.pos, {y}.pos) + least({x}.n - {x}.pos, {y}.n - {y}.pos)"
    return f"{UNDER} * least({x}.n, {y}.n) >= {OVER} * greatest({x}.n, {y}.n) and {OVER + UNDER} * ({most}) >= {OVER} * ({x}.n + {y}.n)"


def _sketched(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows with ``low``: the parities folded to 256 bits, or all where there are fewer."""
    low = F.expr("if(size(odd) <= 4, odd, transform(sequence(1, 4), k -> aggregate(sequence(k, size(odd), 4), 0L, (s, i) -> s ^ odd[i - 1]))) as low")
    return rows.join(reps.select("node", low), "node")


def _parted(x: str, y: str) -> str:
    """Whether sets with these folded parities can reach SIMILARITY; those of different widths are left to the whole ones."""
    differ = f"aggregate(zip_with({x}.low, {y}.low, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    return f"(size({x}.low) <> size({y}.low) or {OVER + UNDER} * {differ} <= {UNDER - OVER} * ({x}.n + {y}.n))"


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _either(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """What stands in one of two columns, once."""
    return checkpoint(pairs.select(F.explode(F.array(a, b)).alias(name)).distinct())


def verified(pairs: DataFrame, reps: DataFrame, slim: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets are at SIMILARITY or above."""
    pairs = checkpoint(pairs.distinct())
    # as long as the pairs are few, sketches and texts stay where they are and only those of candidates move
    own = reps.select("node", F.xxhash64("key").alias("at"), "n", "odd").join(_sent(_either(pairs, "a", "b", "node")), "node", "left_semi")
    for x in "ab":
        pairs = pairs.join(own.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("at", "n", "odd")]), x)
    # sets differ in as many shingles as their parities at least; sizes within SIMILARITY differ by one doubling of the width at most
    folded = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y), {0})"
    a, b = folded.format("odd_a", "odd_b"), folded.format("odd_b", "odd_a")
    differ = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    pairs = checkpoint(pairs.filter((OVER + UNDER) * differ <= (UNDER - OVER) * (F.col("n_a") + F.col("n_b"))).select("a", "b", "at_a", "at_b"))
    # by a hash of the key, which is small to send: another text that shares one has another node and joins nothing below
    texts = slim.withColumn("at", F.xxhash64("key")).join(_sent(_either(pairs, "at_a", "at_b", "at")), "at", "left_semi").select("key", "text")
    sets = batched(texts, _sets, "node bigint, whole array<bigint>")
    both = pairs.select("a", "b")
    for x in "ab":
        both = both.join(sets.select(F.col("node").alias(x), F.col("whole").alias(f"set_{x}")), x)
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter((OVER + UNDER) * shared >= OVER * (F.size("set_a") + F.size("set_b"))).select("a", "b").distinct()


def _dealt(reps: DataFrame) -> DataFrame:
    """``h, node, n, pos, label``: a row for each shingle of a prefix."""
    return reps.select(F.posexplode("head").alias("pos", "h"), "node", "n", "label")


def _buckets(dealt: DataFrame) -> DataFrame:
    """``h, m``: the rows of each shingle that holds two labels at least, by size."""
    m = F.sort_array(F.collect_list(F.struct("n", "node", "pos", *[c for c in ("label", "low") if c in dealt.columns])))
    return dealt.groupBy("h").agg(m.alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("h", "m")


def _pairs(buckets: DataFrame, after: int, upto: int) -> DataFrame:
    """``a, b``: possible pairs of different labels, more than ``after`` and at most ``upto`` places apart; of the first round also those with the first row."""
    met = f"slice(m, i + 2 + {after}, {upto - after})" if after else f"concat(slice(m, i + 2, {upto}), slice(m, 1, 1))"
    bound = f"and {_parted('x', 'y')}" if after else ""
    ahead = f"filter({met}, y -> x.label <> y.label and {_possible('x', 'y')} {bound})"
    found = buckets.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> transform({ahead}, y -> struct(least(x.node, y.node) as a, greatest(x.node, y.node) as b))))")).alias("p"))
    return found.select("p.a", "p.b")


def _near_prints(reps: DataFrame) -> DataFrame:
    """``a, b``: texts of one fingerprint with the smallest of them, and those smallest ones where fingerprints link."""
    hubs = checkpoint(reps.groupBy("fp").agg(F.min("node").alias("hub")))
    same = reps.select("fp", "node").join(hubs, "fp").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = links(hubs.select("fp"))
    for x in "ab":
        near = near.join(hubs.select(F.col("fp").alias(x), F.col("hub").alias(f"hub_{x}")), x)
    return same.unionByName(near.select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b")))


def _named(found: DataFrame) -> DataFrame:
    """``node, label`` of the nodes with a link: the smallest node of the component."""
    named = components(found)
    return checkpoint(named.join(named.groupBy("label").agg(F.min("node").alias("least")), "label").select("node", F.col("least").alias("label")))


def _labelled(rows: DataFrame, named: DataFrame) -> DataFrame:
    return rows.drop("label").join(_sent(named), "node", "left").withColumn("label", F.coalesce("label", "node"))


def labels(reps: DataFrame, slim: DataFrame) -> DataFrame:
    """``reps`` (``key, node, n, fp, odd, head``) with the components of the pairs at SIMILARITY as ``label``."""
    found = checkpoint(verified(_near_prints(reps), reps, slim))
    named = _named(found)
    left = checkpoint(_buckets(_dealt(_labelled(reps, named))))
    after, upto, sketched = 0, 1, False
    while (left.agg(F.max(F.size("m"))).first()[0] or 0) > after + 1:
        new = checkpoint(verified(_pairs(left, after, upto), reps, slim))
        after, upto = upto, upto * STEP
        left = left.filter(F.size("m") > after + 1)
        if not new.isEmpty():
            found = found.unionByName(new)
            named = _named(found)
        elif sketched:
            continue
        # places stay as they are: a bucket keeps its rows, in the same order. The rows left after the first round get a sketch,
        # which spares most pairs of later rounds
        rows = left.select("h", F.explode("m").alias("x")).select("h", "x.n", "x.node", "x.pos", *(["x.low"] if sketched else []))
        left, sketched = checkpoint(_buckets(_labelled(rows if sketched else _sketched(rows, reps), named))), True
    return _labelled(reps, named)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("key"), F.col("text").cast("string").alias("text"))


def classes(docs: DataFrame) -> DataFrame:
    """``node, keeper``: every distinct text and the smallest row key of its group."""
    slim = _slim(docs)
    common, often = _common(slim)
    rows = batched(slim, partial(_prefixes, common=common, often=often), REPS)
    # equal texts agree in all but the key
    reps = checkpoint(rows.groupBy("node").agg(*[F.min(c).alias(c) for c in ("key", "n", "fp", "odd", "head")]))
    named = labels(_moved(reps, slim, common, often), slim).select("node", "key", "label")
    return named.join(named.groupBy("label").agg(F.min("key").alias("keeper")), "label").select("node", "keeper")


def groups(docs: DataFrame) -> DataFrame:
    """``key, keeper``: the row key of every document and the smallest key of its group."""
    return batched(_slim(docs), _nodes, f"{KEY}, node bigint").join(classes(docs), "node").select("key", "keeper")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest key."""
    keep = classes(docs).select(F.col("keeper").alias("key")).distinct()
    # rows that share a key become one before they move
    one = docs.select(row_key().alias("key"), F.struct(*columns(docs)).alias("row")).groupBy("key").agg(F.min("row").alias("row"))
    return one.join(keep, "key", "left_semi").select("row.*")
