"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased with white space squeezed. An item of m characters that occurs in a text with at
most k = floor(ERROR m) edits shares at least m + 1 - q - k q of its q-grams with it, all of them on diagonals (text
position minus item position) within k of each other. So per text:

1. positions whose q-gram occurs in any item are marked (one table lookup each) and counted over windows;
   regions too thin for any item go. A match spans several windows, one of which has its share.
2. in what stays, (text position, item position) hits are counted in overlapping diagonal bands of 2 w, stepped
   by w >= k, so that some band holds any match's diagonals whole; bands under the item's bound (its share, where the region is
   shorter than the item) go.
3. bands that reach their share are verified by banded alignment: free ends in the text, at most k edits.

The items' tables are broadcast only piecewise: a benchmark is cut into parts of at most PART_BYTES and
each part scans the documents. Items too short for a positive bound are compared by exact containment.

Null texts and items are empty; an empty item matches nothing; null item ids are not reported; repeated
documents keep their rows; an empty table gives an empty one, and an empty benchmark no hits. Extra columns stay, whatever their names
(``hits`` then gets underscores behind it).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import batched, bounded, columns, free, with_text

Q, ERROR, PART_BYTES = 8, 0.06, 2 << 20
#: Bits of the table of marked q-grams, characters marked together, and hits counted at once.
_BITS, TOGETHER, HITS = 22, 1 << 19, 1 << 20


def squeezed(text: str | None) -> str:
    return " ".join((text or "").lower().replace("\0", " ").split())


def normal(text: str | None) -> np.ndarray:
    return np.frombuffer(squeezed(text).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    h, span = points.astype(np.uint64), 1
    while span < Q:  # Q is a power of two: hashes of twice the length from two neighbours
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15) + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)


class Items:
    def __init__(self, rows: list[tuple[int, str | None]]):
        every = [(i, normal(t)) for i, t in rows]
        self.short: list[tuple[int, np.ndarray]] = []
        self.ids, self.points, self.edits, self.bound = [], [], [], []
        for i, p in every:
            k = int(ERROR * len(p))
            bound = len(p) + 1 - Q - k * Q
            if not len(p):
                continue
            if bound < 1:
                self.short.append((i, p))
            else:
                self.ids.append(i)
                self.points.append(p)
                self.edits.append(k)
                self.bound.append(bound)
        hashes = [grams(p) for p in self.points]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])[order]
        self.at = np.concatenate([np.arange(len(x)) for x in hashes] or [np.zeros(0, int)])[order]
        self.distinct, self.first, self.many = np.unique(self.h, return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[_slot(self.h)] = True
        self.edits, self.bound = np.array(self.edits, int), np.array(self.bound, int)
        if len(self.ids):
            spans = np.array([len(p) for p in self.points]) + self.edits
            self.longest = int(spans.max())
            self.window = int(spans.min())
            # windows of 2 w at steps of w / 2 hold any stretch of 1.5 w whole; of a longer match some such stretch has its share
            stretch = self.window * 3 // 2
            self.share = np.where(spans <= stretch, self.bound, np.maximum(1, self.bound * stretch // (spans + stretch)))
            self.least = int(self.share.min())
            self.step = int(max(1, self.edits.max()))

    def regions(self, marked: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of positions that a match may lie in."""
        n, w = len(marked), self.window
        upto = np.concatenate(([0], np.cumsum(marked)))
        if upto[-1] < self.least:
            return []
        starts = np.arange(0, n, max(1, w // 2))
        dense = upto[np.minimum(starts + 2 * w, n)] - upto[starts] >= self.least
        out: list[list[int]] = []
        for s in starts[dense].tolist():
            e = min(n, s + 2 * w)
            if out and s <= out[-1][1]:
                out[-1][1] = e
            else:
                out.append([s, e])
        return [tuple(x) for x in out]

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, about where it begins, edits) for every item the text holds, one place each."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """``find`` for each text; they are marked together, about TOGETHER characters at once."""
        out: list[list[tuple[int, int, int]]] = []
        group, size = [], 0
        for t in texts:
            group.append(squeezed(t))
            size += len(group[-1])
            if size >= TOGETHER:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group) if group else out

    def _group(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for i, p in self.short:
            item = p.tobytes().decode("utf-32-le", "surrogatepass")
            for f, t in zip(found, texts, strict=True):
                if (at := t.find(item)) >= 0:
                    f[i] = at, 0
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(self.ids) and len(points) >= Q:
            h = grams(points)
            opens = np.cumsum([0, *(len(t) + 1 for t in texts)])
            for lo, hi in self.regions(self.seen[_slot(h)]):
                for d in range(int(np.searchsorted(opens, lo, "right")) - 1, int(np.searchsorted(opens, hi, "left"))):
                    a, b = int(opens[d]), int(opens[d + 1]) - 1
                    first, last = max(lo, a), min(hi, b)
                    if last - first >= self.least:
                        self._search(points[a:b], h[first:last], first - a, found[d])
        return [[(i, *f[i]) for i in sorted(f)] for f in found]

    def _search(self, points, h, lo, found) -> None:
        marked = np.flatnonzero(self.seen[_slot(h)])
        at = np.minimum(np.searchsorted(self.distinct, h[marked]), len(self.distinct) - 1)
        same = self.distinct[at] == h[marked]
        marked, at = marked[same], at[same]
        left, n = self.first[at], self.many[at]
        keys, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # a q-gram that many items hold makes many hits: they are counted in pieces
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1
        for part in np.split(np.arange(len(n)), cuts):
            m = n[part]
            which = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(left[part], m)
            item, diagonal = self.item[which], lo + np.repeat(marked[part], m) - self.at[which]
            band = (diagonal + self.longest) // self.step
            # band b covers the diagonals of steps b and b + 1; in a thinned region an item needs its share of hits
            new, of = np.unique(np.concatenate([keys, item * (1 << 40) + band, item * (1 << 40) + band - 1]), return_inverse=True)
            count = np.bincount(of, np.concatenate([count, np.ones(2 * len(item))]), minlength=len(new)).astype(np.int64)
            keys = new
        own = keys >> 40
        good = count >= self.share[own]
        # the fullest bands first: one verified place is enough
        for at in np.flatnonzero(good)[np.argsort(-count[good], kind="stable")].tolist():
            it = int(own[at])
            if self.ids[it] not in found:
                start = int(keys[at] - (it << 40)) * self.step - self.longest
                edits = banded(self.points[it], points, start, start + 2 * self.step, int(self.edits[it]))
                if edits is not None:
                    found[self.ids[it]] = max(0, start), edits


def banded(p: np.ndarray, text: np.ndarray, first: int, last: int, k: int) -> int | None:
    """Fewest edits that turn p into some stretch of text on diagonals first - k .. last + k; None if over k."""
    lo, hi = first - k, last + k
    width, m = hi - lo + 1, len(p)
    stretch = text[max(0, lo) : max(0, hi + m)]
    if (at := stretch.tobytes().find(p.tobytes())) >= 0 and at % 4 == 0:
        return 0
    big = m + width + 1
    ramp = np.arange(width)
    # positions before and after the text hold a character that is in no item
    padded = np.full(width + m, 0xFFFFFFFF, np.uint32)
    src = slice(max(0, lo), min(len(text), lo + width + m))
    if src.start < src.stop:
        padded[src.start - lo : src.stop - lo] = text[src]
    outside = (np.arange(width + m) + lo < 0) | (np.arange(width + m) + lo >= len(text))
    cost = np.where(outside, big, 0)
    row = np.where(np.arange(width) + lo > len(text), big, np.where(np.arange(width) + lo < 0, big, 0))  # any start is free
    edge = np.full(width + 1, big)
    for r in range(m):
        edge[:width] = row
        straight = row + (padded[r : r + width] != p[r]) + cost[r : r + width]  # diagonal kept
        new = np.minimum(straight, edge[1:] + 1)  # a character of p left out
        row = np.minimum.accumulate(new - ramp) + ramp  # characters of the text inserted
        if r % 16 == 15 and row.min() > k:
            return None
    best = int(row.min())
    return best if best <= k else None


_HITS = ArrayType(StructType().add("item_id", LongType()).add("start", LongType()).add("edits", LongType()))


def _matches(batches: Iterator[pa.RecordBatch], rows: list[tuple[int, str]], text: str, name: str) -> Iterator[pa.RecordBatch]:
    items = Items(rows)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("edits", pa.int64())]))
    for b in bounded(batches, text):
        hits = [[dict(zip(("item_id", "start", "edits"), f, strict=True)) for f in found] for found in items.find_all(b.column(text).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, kind)], [*b.schema.names, name])


def parts(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in pieces that are small enough to send to every task."""
    out, size = [[]], 0
    for r in benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null").orderBy("item_id").toLocalIterator():
        weight = 64 + 4 * len(r.text or "")
        if out[-1] and size + weight > PART_BYTES:
            out.append([])
            size = 0
        out[-1].append((r.item_id, r.text))
        size += weight
    return out


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the documents and ``hits``, an array of (item_id, start, edits) in the normalised text."""
    (out, text), found = with_text(docs, "searched_text"), []
    for rows in parts(benchmark):
        found.append(free(out, "hits"))
        out = batched(out, partial(_matches, rows=rows, text=text, name=found[-1]), StructType([*out.schema.fields]).add(found[-1], _HITS))
    hits = F.concat(*[F.col(f) for f in found]) if len(found) > 1 else F.col(found[0])
    return out.select(*columns(docs), hits.alias(found[0]))
