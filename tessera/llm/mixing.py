"""Mixing to target weights with soft domain membership.

A softmax classifier, trained on a bounded sample of the labelled table, gives every document a posterior
over the domains. Nonnegative document rates are then fitted by projected gradient descent so that the
expected token totals of the domains, sum_d rate_d tokens_d p_dk, meet the targets in least squares. The gradient
is taken in the norm weighted by tokens, in which a document's step depends only on its posterior and
the K residuals: each iteration is one aggregate of K sums over a narrow table, and a rate is a chain of
steps from 1, computed where the row is.

Rates lie between 0 and ``most``: no text is repeated more often than that to serve a rare domain. Targets that cannot
be met so, or for want of documents, are logged as a warning with what is missing.

Rows: null and empty texts have no tokens, get a posterior from the bias alone and keep rate steps of their own; null
doc_ids are rated like any other, and rows that agree in id and text share a decision; without labels the posteriors are
equal and rates follow from the targets alone; an empty table gives an empty one. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, bounded, checkpoint, columns, labelled_sample, learned, row_key

#: The classes of the labelled table: by quality, and toxic apart.
DOMAINS = ("low", "good", "toxic")
#: Wanted shares of all tokens.
WEIGHTS = {"low": 0.10, "good": 0.88, "toxic": 0.02}
HASHED = 1 << 12
SAMPLE, SAMPLE_CHARS = 1500, 12_000_000  # labelled texts of each domain at most, and their characters together
#: The highest rate: no document comes more than MOST times.
MOST = 8.0
STEPS, RATE, RIDGE = 150, 0.5, 1e-4
#: Rates are fitted until residuals are within CLOSE, or have not fallen by a share of FALL in PATIENCE rounds.
CLOSE, FALL, PATIENCE = 1e-3, 0.01, 10
_STATS = 6


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word of every token, tokens of each text, and a few ratios of its characters."""
    texts = pc.fill_null(texts, "")
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    coded = split.flatten().dictionary_encode()
    slots = np.array([zlib.crc32(w.lower().encode()) % HASHED for w in coded.dictionary.to_pylist()], np.int64)
    tokens = slots[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    blank = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.maximum(1, pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    share = lambda p: pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False) / chars
    stats = np.stack([share("[A-Z]"), share("[0-9]"), share("[!|%*&$#]"), share("[.,]"), share("\n"), counts / chars], axis=1) * 10
    if blank.any():  # a blank text is split into one empty token
        keep = np.repeat(~blank, counts)
        tokens, counts = tokens[keep], np.where(blank, 0, counts)
    return tokens, counts, stats


def posteriors(texts: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and domain posteriors of each text; model: HASHED + stats + bias rows by domain columns."""
    tokens, counts, stats = _bags(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    z = np.stack([np.bincount(owner, model[tokens, k], minlength=len(counts)) for k in range(model.shape[1])], axis=1) / np.maximum(1, counts)[:, None]
    z = z + stats @ model[HASHED : HASHED + _STATS] + model[-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return counts, p / p.sum(axis=1, keepdims=True)


def train(texts: pa.Array, domain: np.ndarray) -> np.ndarray:
    """Softmax regression on averaged hashed words and character ratios, classes weighted by their size in the sample."""
    k = len(DOMAINS)
    model = np.zeros((HASHED + _STATS + 1, k))
    if not len(texts):
        return model
    tokens, counts, stats = _bags(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    share = 30.0 / np.maximum(1, counts)
    y = np.eye(k)[domain]
    memory = np.full_like(model, 1e-8)
    for _ in range(STEPS):
        z = np.stack([np.bincount(owner, model[tokens, c], minlength=len(counts)) for c in range(k)], axis=1) * share[:, None] + stats @ model[HASHED : HASHED + _STATS] + model[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - y) / len(texts)
        words = np.stack([np.bincount(tokens, (g[:, c] * share)[owner], minlength=HASHED) for c in range(k)], axis=1)
        grad = np.concatenate([words, stats.T @ g, g.sum(axis=0, keepdims=True)]) + RIDGE * model
        memory += grad**2
        model -= RATE * grad / np.sqrt(memory)
    model[:HASHED] *= 30.0
    return model


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0).alias("domain")).dropna().distinct()
    chosen = None
    for k in range(len(DOMAINS)):
        part = usable.filter(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    return learned(labelled_sample(docs, chosen, "domain", SAMPLE_CHARS), "domain", train)


def _members(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, "text"):
        counts, p = posteriors(b.column("text"), model)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(counts), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1]))], ["doc_id", "key", "tokens", *[f"p_{d}" for d in DOMAINS]])


def membership(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``doc_id, key, tokens, p_<domain>``."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    return batched(slim, partial(_members, model=model), "doc_id bigint, key struct<none:boolean,id:bigint,hash:bigint>, tokens bigint, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def rate_of(steps: list[list[float]], most: float = MOST) -> Column:
    """The rate after the given steps: rate - step . p, kept between 0 and ``most``, from 1."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    p = [F.col(f"p_{d}") for d in DOMAINS]
    return F.aggregate(moves, F.lit(1.0), lambda r, s: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), r - sum((x * s[k] for k, x in enumerate(p)), F.lit(0.0)))))


def fit_rates(members: DataFrame, weights: dict[str, float], most: float = MOST) -> list[list[float]]:
    """Steps of projected gradient descent on the residuals of the domains in ``weights``, until they are within CLOSE of all tokens.

    Where they stop falling before that, as without documents of a wanted domain, plain gradient steps go on from the best
    rates until the squares fall by less than FALL in PATIENCE rounds; the steps of the smallest are returned and what is unmet is logged as a warning.

    Until then the gradient is scaled by the inverse of the K x K matrix of expected token overlaps of the documents whose
    rate is between its bounds, which would meet the targets in one step if no further rate reached one.
    """
    total = members.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return []
    wanted = [k for k, d in enumerate(DOMAINS) if d in weights]
    k = len(DOMAINS)
    target = np.array([weights[DOMAINS[x]] for x in wanted])
    steps: list[list[float]] = []
    best, at, unmet, mark, since, bound = np.inf, 0, {}, np.inf, 0, None
    plain = False
    while True:
        rated = members.withColumn("_rate", rate_of(steps, most)).withColumn("_live", F.when((F.col("_rate") > 0) & (F.col("_rate") < most), F.col("tokens")).otherwise(0))
        overlaps = [F.sum(F.col("_live") * F.col(f"p_{a}") * F.col(f"p_{b}")) for a in DOMAINS for b in DOMAINS]
        got = np.array(list(rated.agg(*[F.sum(F.col("tokens") * F.col("_rate") * F.col(f"p_{d}")) for d in DOMAINS], *overlaps).first())) / total
        residual, overlap = got[:k][wanted] - target, got[k:].reshape(k, k)[np.ix_(wanted, wanted)]
        # of the first round, in which all rates are 1 and live: what the gradient changes by at most
        bound = np.linalg.eigvalsh(overlap).max() if bound is None else bound
        off = float(residual @ residual)
        if off < best:
            best, at, unmet = off, len(steps), dict(zip([DOMAINS[x] for x in wanted], residual.round(6).tolist(), strict=True))
        if np.abs(residual).max() <= CLOSE:
            return steps
        if off < mark * (1 - FALL):
            mark, since = off, len(steps)
        elif len(steps) - since >= PATIENCE:
            if plain:
                logging.getLogger(__name__).warning("mixing targets unmet after %d rounds, residual shares of tokens %s", len(steps), unmet)
                return steps[:at]
            # targets out of reach: scaled steps need not lead to the least squares, plain ones do
            plain, steps, mark, since = True, steps[:at], best, at
            continue
        step = np.zeros(k)
        step[wanted] = residual / bound if plain else np.linalg.solve(overlap + 1e-4 * np.eye(len(wanted)), residual)
        # rounded so that the order in which executors add up does not show
        steps.append([round(float(x), 9) for x in step])


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, most: float = MOST) -> DataFrame:
    """``doc_id, key, tokens, p_<domain>, rate, copies``; copies is the rate rounded up or down by a hash of the key."""
    members = checkpoint(membership(docs, fit(docs, labels)))
    steps = fit_rates(members, weights or WEIGHTS, most)
    u = F.pmod(F.xxhash64("key", F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return members.withColumn("rate", rate_of(steps, most)).withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, most: float = MOST) -> DataFrame:
    """The documents, each as often as its copies say."""
    chosen = rates(docs, labels, weights, most).groupBy("key").agg(F.min("copies").alias("copies")).filter("copies > 0")
    packed = docs.select(row_key().alias("key"), F.struct(*columns(docs)).alias("row")).join(chosen, "key")
    return packed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
