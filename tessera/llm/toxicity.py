"""Toxicity: character n-gram (subword) embeddings, averaged, into a linear softmax.

A word is the bag of its character n-grams, so an unseen misspelling or inflection shares most of its
vectors with words that were seen. One average over a whole text hides a few insults in a long one and one over all
tokens lets a repeated word outweigh the rest, so the average is taken over the distinct words of each
window of ``WINDOW`` words (half overlapping; a shorter one is filled up with neutral words), and the text's score is
that of its worst window. Embeddings and softmax are trained jointly in numpy by full-batch gradient
descent: all windows of a clean text are negative, the worst window of a toxic text is positive.

As everything after the embedding is linear, a window's logit is the sum of its words' logits, and
those are means of n-gram logits: scoring needs one number for each n-gram bucket.

Rows: null and empty texts score like a text without words, by the bias; null doc_ids are scored and never learned
from; without labels of both kinds the score is the share of toxic labels, or 0. A label given twice counts once,
contradictory ones both. Extra columns are ignored, or kept under their names with ``keep_text``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import batched, bounded, columns, give_back, labelled_sample, learned, with_text

BUCKETS, DIM, WINDOW, SIZES = 1 << 18, 8, 48, (3, 4, 5)
#: At most so many labelled texts of each kind are learned from, the first by a hash of the id, and so many characters of each kind together.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1500, 2500, 12_000_000
STEPS, PRIOR, LEAST_TEXTS, BIAS_RATE, W_RATE, MOMENTUM, RIDGE, LASSO = 200, -4.0, 0.002, 0.05, 0.01, 0.9, 1e-3, 5e-4
#: A word's average is as if it had so many neutral n-grams more, lest two or three of a short word decide.
PAD = 6
#: Words whose n-grams, windows whose words, and n-grams whose sums are worked out at once.
SLICE, ROWS, SUMMED = 20_000, 1 << 12, 1 << 18


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the number of each token's word, and how many tokens each text has."""
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    blank = coded.dictionary.index("").as_py()  # a text without words is split into one empty token
    if blank >= 0:
        owner = np.repeat(np.arange(len(counts)), counts)[ids != blank]
        counts, ids = np.bincount(owner, minlength=len(counts)).astype(np.int64), ids[ids != blank]
    return coded.dictionary, ids, counts


def subwords(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of each ``<word>``, word after word, and how many each has (an empty one has none)."""
    points = np.frombuffer("".join(f"<{w}>" for w in vocabulary).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(vocabulary), dtype=np.int32), [len(w) + 2 for w in vocabulary])
    ids, who = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for n in SIZES:
        k = len(points) - n + 1
        if k <= 0:
            continue
        h = np.full(k, 1469598103934665603 + n, np.uint64)
        for t in range(n):
            h = (h ^ points[t : t + k]) * np.uint64(1099511628211)
        inside = owner[:k] == owner[n - 1 :]
        h = h[inside]
        ids.append(((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32))
        who.append(owner[:k][inside])
    ids, who = np.concatenate(ids), np.concatenate(who)
    return ids[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(vocabulary))


def windows(ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some windows at a time: the text of each, its sorted words, and which of them are its first of a kind."""
    half = WINDOW // 2
    many = np.where(counts > WINDOW, -(-(counts - WINDOW) // half) + 1, np.minimum(counts, 1))
    opens, first = np.cumsum(counts) - counts, np.cumsum(many) - many
    for at in range(0, int(many.sum()), ROWS):
        number = np.arange(at, min(at + ROWS, int(many.sum())))
        doc = np.searchsorted(first, number, "right") - 1
        start = np.minimum((number - first[doc]) * half, np.maximum(counts[doc] - WINDOW, 0))
        inside = start[:, None] + np.arange(WINDOW)
        word = np.where(inside < counts[doc][:, None], ids[np.minimum(opens[doc][:, None] + inside, len(ids) - 1)], -1)
        word.sort(axis=1)
        new = word >= 0
        new[:, 1:] &= word[:, 1:] != word[:, :-1]
        yield doc, word, new


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _summed(x: np.ndarray, of: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """``np.bincount(to, x[of], minlength=n)``, added in the same order but some at a time: numpy takes 8 bytes more for every index and value."""
    out = np.zeros(n)
    for k in range(0, len(to), SUMMED):
        np.add.at(out, to[k : k + SUMMED], x[of[k : k + SUMMED]])
    return out


def train(texts: pa.Array, toxic: np.ndarray, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """Logit contribution of every bucket (float32), the bias last.

    With two classes the softmax depends on the difference of its two weight vectors, so gradients of
    embeddings and weights both follow from one number for each bucket; nothing wider is carried
    through the averages. Gradient steps with momentum move an n-gram by how many texts it tells apart, which keeps
    rare ones near zero; buckets seen in fewer than ``LEAST_TEXTS`` of the texts (3 at least) stay zero.
    """
    listed, ids, counts = tokens(texts)
    toxic = np.asarray(toxic, dtype=bool)[counts > 0]
    counts = counts[counts > 0]
    if not len(toxic) or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return np.append(np.zeros(BUCKETS), np.log(max(share, 1e-6) / max(1 - share, 1e-6))).astype(np.float32)
    # in slices, so that only the 4-byte results of all words are held at once
    slices = [subwords(listed.slice(k, SLICE).to_pylist()) for k in range(0, len(listed), SLICE)]
    grams, gram_counts = (np.concatenate(x) for x in zip(*slices, strict=True))
    n_words = len(listed)
    del slices, listed
    give_back()
    gram_starts = _starts(gram_counts)
    divisor = gram_counts + PAD
    least = max(3, round(LEAST_TEXTS * len(counts)))
    seen = np.zeros(BUCKETS, np.int32)
    for lo, n in zip(_starts(counts).tolist(), counts.tolist(), strict=True):
        own = np.unique(ids[lo : lo + n])
        at = np.repeat(gram_starts[own] - _starts(gram_counts[own]), gram_counts[own]) + np.arange(gram_counts[own].sum())
        seen[np.unique(grams[at])] += 1
    # n-grams that stay zero need no place; every word keeps its own count as the divisor
    live = seen[grams] >= least
    gram_word = np.repeat(np.arange(n_words, dtype=np.int32), gram_counts)[live]
    grams = grams[live]
    parts = [(doc.astype(np.int32), word[new].astype(np.int32), new.sum(axis=1, dtype=np.int32)) for doc, word, new in windows(ids, counts)]
    docs, sizes = np.concatenate([x[0] for x in parts]), np.concatenate([x[2] for x in parts])
    parts = [(words, _starts(n)) for _, words, n in parts]
    cuts = np.cumsum([0, *[len(starts) for _, starts in parts]])
    del ids, live
    give_back()

    def spread(x: np.ndarray) -> np.ndarray:
        """For each word, the sum of ``x`` over the windows that hold it; some windows at a time and still in their order."""
        out = np.zeros(n_words)
        for (words, _), lo, hi in zip(parts, cuts[:-1], cuts[1:], strict=True):
            np.add.at(out, words, np.repeat(x[lo:hi], sizes[lo:hi]))
        return out

    opens = np.searchsorted(docs, np.arange(len(counts)))
    positive = toxic[docs]
    per_kind = np.where(positive, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())

    rng = np.random.default_rng(seed)
    table, w, bias = rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 1, DIM), PRIOR
    table[seen < least] = 0
    w /= np.linalg.norm(w)
    # a bound of each bucket's curvature; the ridge holds back what few windows speak for
    mass = _summed(spread(per_kind) / divisor, gram_word, grams, BUCKETS)
    step_of = 4 / (WINDOW * (mass + RIDGE))
    speed = np.zeros(BUCKETS)
    for _ in range(steps):
        word = _summed(table @ w, grams, gram_word, n_words) / divisor
        logit = np.clip(WINDOW * np.concatenate([np.add.reduceat(word[words], starts) for words, starts in parts]) + bias, -60, 60)
        p = 1 / (1 + np.exp(-logit))
        worst = positive & (logit >= np.maximum.reduceat(logit, opens)[docs])
        g = np.where(positive, np.where(worst, p - 1, 0.0), p) * per_kind
        back = spread(g) / divisor
        bucket = _summed(back, gram_word, grams, BUCKETS)
        speed = MOMENTUM * speed - step_of * bucket
        w_grad = table.T @ bucket
        table += np.outer(speed, w / (w @ w))
        # soft threshold: an n-gram whose evidence is within the noise stays at zero
        t = table @ w
        speed[np.abs(t) <= step_of * LASSO] = 0
        table *= np.maximum(0, 1 - step_of * LASSO / np.maximum(np.abs(t), 1e-12))[:, None]
        w = w - W_RATE * w_grad / (np.abs(w_grad).max() + 1e-12)
        bias -= BIAS_RATE * g.sum()
    return np.append(WINDOW * (table @ w), bias).astype(np.float32)


def word_logits(vocabulary: pa.Array, model: np.ndarray) -> np.ndarray:
    out = []
    for k in range(0, len(vocabulary), SLICE):
        ids, counts = subwords(vocabulary.slice(k, SLICE).to_pylist())
        out.append(np.bincount(np.repeat(np.arange(len(counts)), counts), model[ids].astype(np.float64), minlength=len(counts)) / (counts + PAD))
    return np.concatenate(out) if out else np.zeros(0)


def score_texts(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    """Score of each text: the logistic of its worst window's logit, or of the bias for a text without words."""
    vocabulary, ids, counts = tokens(texts)
    per_word = word_logits(vocabulary, model)
    worst = np.where(counts > 0, -np.inf, 0.0)
    for doc, word, new in windows(ids, counts):
        np.maximum.at(worst, doc, np.where(new, per_word[word], 0.0).sum(axis=1))
    return 1.0 / (1.0 + np.exp(-np.clip(worst + float(model[-1]), -500, 500)))


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 3 is 1: those labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Train on a bounded sample of labelled texts (the SAMPLE_ constants)."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).distinct()
    first = lambda kind, n: usable.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return learned(labelled_sample(docs, first(1, SAMPLE_TOXIC).unionByName(first(0, SAMPLE_CLEAN)), "toxic", SAMPLE_CHARS), "toxic", train)


def _scores(batches: Iterator[pa.RecordBatch], model: np.ndarray, text: str, name: str) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, text):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(b.column(text), model))], [*b.schema.names, name])


def score(docs: DataFrame, model: np.ndarray, keep_text: bool = False, name: str = "score") -> DataFrame:
    """``doc_id, score`` for every document, or all its columns and the score under ``name``, which must be free."""
    if not keep_text:
        docs = docs.select("doc_id", "text")
    given, text = with_text(docs, "scored_text")
    schema = StructType([*given.schema.fields]).add(name, DoubleType())
    out = batched(given, partial(_scores, model=model, text=text, name=name), schema)
    return out.select(*columns(docs), F.col(name)) if keep_text else out.select("doc_id", name)
