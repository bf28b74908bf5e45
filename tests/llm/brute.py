"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import re
import zlib

import xxhash

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    kinds = ("assign", "access", "hex")
    base = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(base.encode()).hexdigest(), base)


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, min(1, len(words))))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows, near=2):
    """rows: (doc_id, fingerprint); the smallest id of each row's component, by union-find over all pairs."""
    prints = sorted({f for _, f in rows})
    up = {f: f for f in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(prints):
        for b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= near:
                up[root(a)] = root(b)
    first = {}
    for d, f in rows:
        if d is not None:
            first[root(f)] = min(first.get(root(f), d), d)
    return [(d, f"{f:016x}", first.get(root(f))) for d, f in rows]


def shards(rows, n=24):
    """rows: (doc_id, text) in order; the shard and slot of each."""
    sized = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows]
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, start, slots, out = sum(s for _, s, _ in sized), 0, {}, []
    for d, s, c in sized:
        k = min(n - 1, (2 * start + s) * n // (2 * total))
        out.append((d, s, c, "bytes", k, slots.setdefault(k, 0), None))
        slots[k] += 1
        start += s
    return out


def near_groups(texts, similarity=0.8):
    """texts: lists of words; each position's smallest position reachable over pairs of Jaccard similarity, of sets of five words."""
    folded = [[x for w in t if (x := w.lower().strip(".,;:!?\"'()[]{}*#%&$|"))] for t in texts]
    sets = [{tuple(t[k : k + 5]) for k in range(max(len(t) - 4, min(1, len(t))))} for t in folded]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            if folded[a] == folded[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) > 0:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in range(len(texts))}
