"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open elements
(tag names and the words of class, id and role). A bidirectional LSTM in numpy reads the page's blocks in
order, as hashed vectors of path and words and a few measures, and labels each block as main text or
not, with the rest of the page as context. It is trained here on pages that a generator composes from
known parts, so their labels are exact, with invented words, so it learns structure and not vocabulary.

Scripts, styles, comments and form fields are not text and never become blocks; what other elements hold is the labeller's
to judge. Tags are read as browsers do (quotes count after an equals sign, a quote without an end does not), in time that grows with the
page's length alone, and states of the LSTM are held for STEPS blocks at a time. Rows: null and empty pages have no
text; repeated rows are extracted alike; broken markup ends where the page ends; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import html as references
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

#: Elements without an end tag, elements whose content is not text, and elements that stand as blocks; all others run on within a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style head title textarea select".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "label legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements that end where the next of their kind begins.
OPEN_ENDED = frozenset("p li dt dd tr td th option".split())
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART, _NAME = re.compile(r"[A-Za-z]+"), re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r">|=\s*[\"']")
#: Where elements end whose content has no markup.
_RAW = {t: re.compile(rf"</{t}(?:[\s/][^>]*)?>", re.I) for t in ("script", "style")}
#: White space of the markup; other spaces (such as no-break) are squeezed as well.
_SPACE = re.compile(r"\s+")
#: How far up an end tag of an inline element looks for its start.
NEAR = 64

PATH, WORDS, MEASURES = 96, 32, 6
WIDTH, HIDDEN = PATH + WORDS + MEASURES, 20
#: Blocks read at a time.
STEPS = 512


@lru_cache(maxsize=65536)
def _slot(name: str, n: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % n


@lru_cache(maxsize=8192)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    marks = " ".join(a or b or c for a, b, c in _MARK.findall(attributes)) if "=" in attributes else ""
    return (f"<{tag}>", *(w.lower() for w in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", marks))))


class Page:
    """Where tags begin and end, in one pass over the source."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.final = {q: source.rfind(q) for q in "\"'"}

    def tag_end(self, at: int) -> int:
        """The position of the ``>`` that ends the tag open at ``at``, or -1: the page ends within it."""
        while at <= self.last and (m := _TAG_STOP.search(self.source, at)):
            at = m.end()
            if m[0] == ">":
                return at - 1
            if self.final[m[0][-1]] >= at:  # else the quote has no end and is a character like any other
                at = self.source.index(m[0][-1], at) + 1
        return -1


#: (hashed names of the path as bits, those of its last two, number of names), text, characters inside links
Cut = tuple[tuple[int, int, int], str, int]


def blocks(page: str | None) -> list[Cut]:
    """Each block in page order."""
    page = page or ""
    out: list[Cut] = []
    #: tag, bits of the path down to it, its last two names, number of names
    stack: list[tuple[str, int, tuple[str, ...], int]] = []
    opened: Counter[str] = Counter()
    run: list[str] = []
    linked = silent = 0
    path: tuple[int, int, int] | None = None
    reader = Page(page)

    def close() -> None:
        nonlocal linked, path
        if run:
            text = _SPACE.sub(" ", references.unescape("".join(run))).strip()
            if text:
                out.append((path or (0, 0, 0), text, linked))
            run.clear()
        linked, path = 0, None

    def add(text: str) -> None:
        nonlocal linked, path
        if silent or not text:
            return
        if path is None and not text.isspace():
            _, bits, ends, n = stack[-1] if stack else ("", 0, (), 0)
            path = bits, sum({1 << _slot(f"last {e}", PATH) for e in ends}), n
        run.append(text)
        if opened["a"]:
            linked += len(text)

    def shut(k: int, upto: int) -> None:
        nonlocal silent
        for gone in stack[k:upto]:
            opened[gone[0]] -= 1
            silent -= gone[0] in SILENT
        del stack[k:upto]

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            continue
        name = _NAME.match(page, start + 1)
        if name is None:
            add("<")
            at = start + 1
            continue
        end = reader.tag_end(name.end())
        if end < 0:
            break
        at, tag, attributes = end + 1, name[1].lower(), page[name.end() : end]
        if tag in BLOCK:
            close()
        elif tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if page[start + 1] != "/":
            if tag in _RAW:  # raw text until its own end tag
                closing = _RAW[tag].search(page, at)
                at = closing.end() if closing else len(page)
                continue
            if tag in OPEN_ENDED and stack and stack[-1][0] == tag:
                shut(len(stack) - 1, len(stack))
            if attributes.endswith("/"):
                continue
            names = _names(tag, attributes)
            _, bits, ends, n = stack[-1] if stack else ("", 0, (), 0)
            for x in names:
                bits |= 1 << _slot(x, PATH)
            stack.append((tag, bits, (*ends, *names)[-2:], n + len(names)))
            opened[tag] += 1
            silent += tag in SILENT
        elif opened[tag] > 0:
            least = -1 if tag in BLOCK else max(-1, len(stack) - 1 - NEAR)
            k = next((k for k in range(len(stack) - 1, least, -1) if stack[k][0] == tag), None)
            if k is not None:
                shut(k, len(stack) if tag in BLOCK else k + 1)
    close()
    return out


def _bits(mask: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")


def vectors(page: list[Cut]) -> np.ndarray:
    x = np.zeros((len(page), WIDTH), np.float32)
    for k, ((path, ends, depth), text, linked) in enumerate(page):
        x[k, :PATH] = _bits(path | ends)
        words = text.lower().split(" ")
        x[k, PATH : PATH + WORDS] = np.bincount([_slot(w, WORDS) for w in words], minlength=WORDS) / len(words)
        n = len(text)
        x[k, -6:] = np.log1p(n) / 6, min(1.0, linked / n), np.log1p(len(words)) / 4, text[-1] in ".!?:;\"", min(depth, 64) / 16, len(text.translate(_NO_DIGITS)) / n
    return x


#: Leaves the characters that are not ASCII digits.
_NO_DIGITS = str.maketrans("", "", "0123456789")


def _lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, state=None, tape: list | None = None) -> tuple[np.ndarray, tuple]:
    """Hidden states (time, batch, hidden) and the last state; steps outside the mask carry the state. What training needs goes on the tape."""
    steps, batch, _ = x.shape
    h, c = state or (np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32))
    out = np.zeros((steps, batch, HIDDEN), np.float32)
    pre = x @ wx + b
    for t in range(steps):
        z = pre[t] + h @ wh
        gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if tape is not None:
            tape.append((h, c, i, f, o, g, tc, m))
        c = np.where(m, c_new, c)
        h = np.where(m, o * tc, h)
        out[t] = h
    return out, (h, c)


def _lstm_back(x, d_out, tape, wh):
    dwx, dwh, db = np.zeros((x.shape[2], 4 * HIDDEN), np.float32), np.zeros_like(wh), np.zeros(4 * HIDDEN, np.float32)
    dh = dc = np.zeros_like(d_out[0])
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = tape[t]
        dh = dh + d_out[t]
        dhm, dcm = dh * m, dc * m
        d_c = dcm + dhm * o * (1 - tc**2)
        dz = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), dhm * tc * o * (1 - o), d_c * i * (1 - g**2)], axis=1)
        dwx += x[t].T @ dz
        dwh += h.T @ dz
        db += dz.sum(axis=0)
        dh = np.where(m, dz @ wh.T, dh)
        dc = np.where(m, d_c * f, dc)
    return dwx, dwh, db


def _padded(pages: list[list[Cut]], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and mask of the blocks ``lo`` to ``hi`` of each page."""
    x, mask = np.zeros((hi - lo, len(pages), WIDTH), np.float32), np.zeros((hi - lo, len(pages)), bool)
    for k, p in enumerate(pages):
        own = p[lo:hi]
        if own:
            x[: len(own), k], mask[: len(own), k] = vectors(own), True
    return x, mask


def _reversed(a: np.ndarray) -> np.ndarray:
    return a[::-1]


def logits(model, pages: list[list[Cut]]) -> np.ndarray:
    """(block, page): forwards over the pages and backwards, STEPS blocks at a time."""
    wx1, wh1, b1, wx2, wh2, b2, out, direct, bias = model
    n = max(map(len, pages))
    z, spans = np.zeros((n, len(pages)), np.float32), [(lo, min(lo + STEPS, n)) for lo in range(0, n, STEPS)]
    state = None
    for lo, hi in spans:
        x, mask = _padded(pages, lo, hi)
        h, state = _lstm(x, mask, wx1, wh1, b1, state)
        z[lo:hi] += h @ out[:HIDDEN] + x @ direct + bias
    state = None
    for lo, hi in reversed(spans):
        x, mask = (x, mask) if len(spans) == 1 else _padded(pages, lo, hi)
        h, state = _lstm(_reversed(x), _reversed(mask), wx2, wh2, b2, state)
        z[lo:hi] += _reversed(h) @ out[HIDDEN:]
    return z


_MAIN = ("article", "main", "div class='post-content'", "div id='content'", "div class='entry-content'", "section class='article-body'", "div class='story text'")
_ASIDE = (
    "nav", "header", "footer", "aside", "form", "div class='ad'", "div class='advert banner'", "div class='sidebar'", "div id='sidebar-right'", "div class='cookie notice'", "div class='menu'",
    "ul class='breadcrumb'", "section class='comments'", "div id='comments'", "div class='comment reply'", "div class='related posts'", "div class='share social'", "div class='newsletter signup promo'",
    "div class='site-header'", "div class='footer copyright'", "div class='sponsored'", "div role='banner'", "div role='navigation'", "div class='widget'", "div class='popup modal alert'", "p class='notice'", "div class='pagination'",
)


def composed(seed: int) -> tuple[str, list[bool]]:
    """A page of known parts and the label of each of its blocks."""
    r = random.Random(seed)
    page, labels = [], []
    syllables = ["".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiouéü") for _ in range(r.randint(1, 3))) for _ in range(60)]

    def words(n):
        return " ".join(r.choice(syllables) for _ in range(n))

    def sentence(n):
        return words(n).capitalize() + r.choice(". . . ! ?".split())

    def emit(tag, text, main):
        page.append(f"<{tag}>{text}</{tag.split()[0]}>" if r.random() < 0.9 or tag.split()[0] not in ("p", "li") else f"<{tag}>{text}")
        labels.append(main)

    def aside(spec, depth=0):
        page.append(f"<{spec}>")
        kind = r.random()
        if kind < 0.45:
            page.append("<ul>")
            for _ in range(r.randint(2, 7)):
                emit("li", f"<a href='/x'>{words(r.randint(1, 3))}</a>", False)
            page.append("</ul>")
        elif kind < 0.8:
            page.append(("&copy; " if "footer" in spec else "") + sentence(r.randint(2, 30)))
            labels.append(False)
        else:
            for _ in range(r.randint(1, 3)):
                emit(r.choice(("p", "div", "h3", "label", "p")), sentence(r.randint(2, 40)), False)
        page.append(f"</{spec.split()[0]}>")

    page.append("<html><head><title>x</title></head><body>")
    for _ in range(r.randint(0, 4)):
        aside(r.choice(_ASIDE))
    wrap = r.random() < 0.4
    if wrap:
        page.append("<div class='wrapper page'>")
    spec = r.choice(_MAIN) if r.random() < 0.5 else "article"
    page.append(f"<{spec}>")
    if r.random() < 0.8:
        emit("h1", words(r.randint(3, 12)), True)
    if r.random() < 0.4:  # an unclosed inline element and a break between paragraphs
        page.append(f"<p><b>{sentence(r.randint(3, 20))}<br>")
        labels.append(True)
    for _ in range(r.randint(1, 14)):
        u = r.random()
        if u < 0.1:
            emit(r.choice(("h2", "h3")), words(r.randint(1, 8)), True)
        elif u < 0.16:
            page.append("<ul>")
            for _ in range(r.randint(2, 5)):
                emit("li", sentence(r.randint(2, 15)), True)
            page.append("</ul>")
        elif u < 0.2:
            emit("blockquote", sentence(r.randint(5, 30)), True)
        elif u < 0.3:
            aside(r.choice(_ASIDE))
        else:
            text = sentence(r.choice((1, 2, 5, 12, 30, 60)))
            emit("p", text.replace(" ", " <a href='/y'>" + words(2) + "</a> ", 1) if r.random() < 0.15 else text, True)
    page.append(f"</{spec.split()[0]}>")
    if wrap:
        page.append("</div>")
    for _ in range(r.randint(0, 4)):
        aside(r.choice(_ASIDE))
    page.append("</body></html>" if r.random() < 0.9 else "")
    return "".join(page), labels


@lru_cache(maxsize=1)
def trained(pages: int = 1200, epochs: int = 8, seed: int = 5) -> tuple[np.ndarray, ...]:
    """The labeller's weights, trained on composed pages by Adam."""
    rng = np.random.default_rng(seed)
    data = []
    for k in range(pages):
        source, labels = composed(k)
        cut = blocks(source)
        if len(cut) == len(labels) and cut:
            data.append((cut, np.array(labels, np.float32)))
    shapes = [(WIDTH, 4 * HIDDEN), (HIDDEN, 4 * HIDDEN), (4 * HIDDEN,)] * 2 + [(2 * HIDDEN,), (WIDTH,), (1,)]
    model = [rng.normal(0, 0.15, s).astype(np.float32) if len(s) > 1 or s[0] > 4 else np.zeros(s, np.float32) for s in shapes]
    m1, m2 = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model]
    step = 0
    data.sort(key=lambda d: len(d[0]))
    groups = [data[k : k + 24] for k in range(0, len(data), 24)]
    groups = [(*_padded([d[0] for d in g], 0, len(g[-1][0])), [d[1] for d in g]) for g in groups]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask, marks = groups[g]
            y = np.zeros(mask.shape, np.float32)
            for k, d in enumerate(marks):
                y[: len(d), k] = d
            tape1, tape2 = [], []
            ahead, _ = _lstm(x, mask, *model[:3], tape=tape1)
            behind, _ = _lstm(_reversed(x), _reversed(mask), *model[3:6], tape=tape2)
            both = np.concatenate([ahead, _reversed(behind)], axis=2)
            z = both @ model[6] + x @ model[7] + model[8]
            d_z = np.where(mask, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0) / mask.sum()
            d_both = d_z[:, :, None] * model[6]
            grads = [*_lstm_back(x, d_both[:, :, :HIDDEN], tape1, model[1]), *_lstm_back(_reversed(x), _reversed(d_both[:, :, HIDDEN:]), tape2, model[4])]
            grads += [np.einsum("tb,tbh->h", d_z, both), np.einsum("tb,tbw->w", d_z, x), np.array([d_z.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                m1[k] += 0.1 * (grad - m1[k])
                m2[k] += 0.001 * (grad**2 - m2[k])
                model[k] = (model[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return tuple(model)


def label(pages: list[list], model) -> list[np.ndarray]:
    """Whether each block is main text; pages of similar length are read together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        size = max(1, min(64, 20000 // len(pages[order[at]])))
        group = order[at : at + size]
        z = logits(model, [pages[k] for k in group])
        for n, k in enumerate(group):
            out[k] = z[: len(pages[k]), n] > 0
        at += size
    return out


def texts(sources: list[str | None], model) -> list[str]:
    pages = [blocks(s) for s in sources]
    return ["\n".join(b[1] for b, keep in zip(p, marks, strict=True) if keep) for p, marks in zip(pages, label(pages, model), strict=True)]


def _extract(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, "html"):
        got = texts(b.column("html").to_pylist(), model)
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(partial(_extract, model=trained()), "page_id bigint, url string, text string, n_chars bigint")
