"""Secret scans with a trigram inverted index, in DataFrame functions only.

Every rule is a regular expression. From the expression itself a Boolean query over trigrams is derived: what
must stand in a row is a literal run, a run is the AND of its trigrams, and alternatives (branches, small character classes, optional
parts) are an OR. The index is split by documents: in each block of it a trigram has one posting list, the
lists of a clause's trigrams are intersected and those of its alternatives united, which gives the candidate (document, rule) pairs.
Candidates rejoin the texts and are verified by the regex. Rules without a mandatory trigram
scan every text. The index is case-folded, so it can only add candidates.

Positions come from splitting at the rule: gaps and matches alternate, so the running sum of their
lengths in code points is the start of each match.

Rows: a null text is an empty one and has no secrets; repeated rows and null doc_ids keep their rows (rows equal in id and
text share a posting); extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key

#: A class of more characters, or more alternatives, ends a literal run: the query says less, and is never wrong.
WIDE, MANY = 8, 64
#: Documents of a block of the index, on average.
BLOCK = 2048

_RUN = tuple[str, ...]


def _runs(parsed) -> list[_RUN]:
    """Alternatives of a parsed expression, each the literal runs that its matches hold; "" at an end or between parts lets a run break there."""
    out: list[_RUN] = [("",)]
    for op, value in parsed:
        match str(op):
            case "LITERAL":
                new = [(chr(value).lower(),)]
            case "IN":
                chars = set()
                for kind, v in value:
                    n = (v, v) if str(kind) == "LITERAL" else v if str(kind) == "RANGE" else (0, 1 << 16)
                    chars |= {chr(x).lower() for x in range(n[0], min(n[1], n[0] + 64) + 1)}
                new = [(x,) for x in sorted(chars)] if len(chars) <= WIDE and not any(str(k) in ("NEGATE", "CATEGORY") for k, _ in value) else [("", "")]
            case "SUBPATTERN":
                new = _runs(value[-1])
            case "BRANCH":
                new = [r for branch in value[1] for r in _runs(branch)]
            case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT":
                least, most, inner = value
                once = _runs(inner)
                if (least, most) == (0, 1):
                    new = [("",), *once]
                elif least == 0:
                    new = [("", "")]
                else:
                    new = once if most == 1 else [(*r, "", *r) if len(r) > 1 else (r[0], r[0]) for r in once]
            case "AT":
                new = [("",)]
            case _:
                new = [("", "")]
        new = list(dict.fromkeys(new))
        if len(out) * len(new) > MANY:
            out, new = [(*r, "") for r in out] if len(new) > 1 else out, [("",)] if len(new) > 1 else new
            if len(out) * len(new) > MANY:
                return [("", "")]
        out = list(dict.fromkeys((*a[:-1], a[-1] + b[0], *b[1:]) for a in out for b in new))
    return out


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this group has at least so many characters.
    group: int = 0
    least: int = 1
    base: bool = False

    def query(self) -> list[list[str]] | None:
        """OR of ANDs of folded trigrams; None where some alternative is too short to have one."""
        found = [sorted({x[k : k + 3] for x in runs for k in range(len(x) - 2)}) for runs in _runs(re._parser.parse(self.pattern))]
        clauses = [list(c) for c in dict.fromkeys(map(tuple, found))]
        if not all(clauses):
            return None
        # a clause that asks for more than another adds nothing
        return [c for c in clauses if not any(set(d) < set(c) for d in clauses)]


#: The three base rules as specified; the others are published token formats.
RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
)


def trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in r.query() or [] for t in clause})


def postings(texts: DataFrame, grams: list[str], blocks: int) -> DataFrame:
    """The inverted index of ``key, text``: ``block, lists``, a map from each trigram (its number in ``grams``) to the keys of the block's texts that hold it."""
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(n)) for n, g in enumerate(grams)]))
    found = texts.select("key", F.lower("text").alias("folded")).select("key", F.explode(held).alias("trigram"))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    lists = found.groupBy(block, "trigram").agg(F.collect_set("key").alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))


def _for(rule: int):
    return lambda key: F.struct(key.alias("key"), F.lit(rule).alias("rule"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """``key, rules``: the numbers of the rules whose query the key's postings satisfy."""
    number = {g: n for n, g in enumerate(grams)}
    pairs = []
    for n, r in enumerate(rules):
        for clause in r.query() or []:
            keys = None
            for g in clause:
                own = F.try_element_at("lists", F.lit(number[g]))
                keys = own if keys is None else F.array_intersect(keys, own)
            pairs.append(F.transform(F.coalesce(keys, F.array()), _for(n)))
    if not pairs:
        return index.select(F.lit(None).cast("struct<none:boolean,id:bigint,hash:bigint>").alias("key"), F.array(F.lit(0)).alias("rules")).limit(0)
    return index.select(F.explode(F.flatten(F.array(*pairs))).alias("p")).groupBy("p.key").agg(F.collect_set("p.rule").alias("rules"))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's matches, leftmost and non-overlapping, in code points."""
    quoted = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, quoted, F.lit(0))
    judged = F.regexp_extract_all(text, quoted, F.lit(rule.group)) if rule.group else whole
    pieces = F.arrays_zip(F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)), F.char_length).alias("gap"), F.transform(whole, F.char_length).alias("long"), F.transform(judged, F.char_length).alias("judged"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc, p):
        start = acc["at"] + p["gap"]
        end = start + p["long"]
        found = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p["judged"] >= rule.least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, begin, step, lambda acc: acc["out"])


def _joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``; one row for each document."""
    grams = trigrams(rules)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", row_key())
    found = candidates(postings(texts, grams, max(1, -(-docs.count() // BLOCK))), rules, grams)
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    joined = texts.join(found, "key", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<int>")))
    per_rule = []
    for n, r in enumerate(rules):
        due = F.array_contains("rules", n) if r.query() else F.lit(True)
        per_rule.append(F.when(due & F.rlike("text", F.lit(r.pattern)), spans(F.col("text"), r, n)).otherwise(nothing).alias(f"s{n}"))
    lists = joined.select("doc_id", *per_rule)
    every = [n for n in range(len(rules))]
    base = [n for n in every if rules[n].base]
    merged = lambda which: F.array_sort(F.concat(*[F.col(f"s{n}") for n in which]))
    counts = [F.size(f"s{n}").cast("bigint").alias(f"n_{rules[n].kind}") for n in base]
    both = lists.select("doc_id", *counts, _joined(merged(base), rules).alias("base"), _joined(merged(every), rules).alias("spans"))
    return both.select("doc_id", *[f"n_{rules[n].kind}" for n in base], F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
