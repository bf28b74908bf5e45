"""Tool-call linking, in DataFrame functions only.

Calls and results are hash-joined by identifier (results are combined per identifier first, so a repeated one
cannot multiply a call). Calls are ordered topologically: level 0 depends on nothing, level n + 1 on calls
of level n at most. Calls with a single dependency form chains, which pointer doubling walks in as many rounds as the logarithm
of their length; only calls with several dependencies are then placed one after another, each once the
last of its dependencies has its place. Arguments are checked against the tool's schema, and each call with its
result is serialised as canonical JSON: sorted keys, no spaces, one spelling of each value.

Rows: a null identifier links to nothing and depends on nothing; calls that repeat an identifier stay rows of their
own and share its level, and what any of them depends on counts for all; unparsable or null arguments and unknown tools are invalid and
serialised without arguments; dependencies on unknown calls are ignored and counted; calls on a cycle, or behind one, have no level; results of
unknown calls are what ``orphans`` returns; empty tables give empty ones. Extra columns of the calls stay; columns that bear the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

_ID = "call_id"

#: Schema types and how a parsed value of each is described.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}

#: tool: {argument: (type, required)}
Schemas = dict[str, dict[str, tuple[str, bool]]]


def valid(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments (JSON text) are an object that has what the tool's schema asks for and nothing else."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.lit(False)
    for tool, fields in schemas.items():
        known = F.array(*[F.lit(k) for k in fields]) if fields else F.array().cast("array<string>")
        ok = F.schema_of_variant(parsed).rlike("^OBJECT<") & (F.size(F.array_except(keys, known)) == 0)
        for field, (kind, required) in fields.items():
            got = F.schema_of_variant(F.try_variant_get(parsed, f"$['{field}']", "variant"))
            ok = ok & F.coalesce(got.rlike(f"^{KINDS[kind]}$"), F.lit(not required))
        out = F.when(name == tool, F.coalesce(ok, F.lit(False))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _settled(df: DataFrame) -> DataFrame:
    """A checkpoint that leaves behind what Catalyst infers of identifiers: in loops those constraints multiply."""
    return checkpoint(df).select(*[F.concat(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def chains(single: DataFrame) -> DataFrame:
    """``call_id, on, steps`` of calls with one dependency: the first call on the way that has none or several, and how far off it is.

    Each round doubles how far a pointer reaches. Calls that lead into a cycle are left out."""
    jump = _settled(single.select(_ID, "on", F.lit(1).cast("bigint").alias("steps")))
    rounds = max(1, jump.count()).bit_length() + 1
    for _ in range(rounds):
        ahead = jump.select(F.col(_ID).alias("on"), F.col("on").alias("far"), F.col("steps").alias("more"))
        if jump.join(ahead, "on", "left_semi").isEmpty():
            return jump
        jump = _settled(jump.join(ahead, "on", "left").select(_ID, F.coalesce("far", "on").alias("on"), (F.col("steps") + F.coalesce("more", F.lit(0).cast("bigint"))).alias("steps")))
    return jump.join(single.select(F.col(_ID).alias("on")), "on", "left_anti").select(_ID, "on", "steps")


def levels(calls: DataFrame) -> DataFrame:
    """``call_id, level, n_missing`` for every distinct identifier, from ``depends_on`` (array of identifiers)."""
    ids = calls.filter("call_id is not null").select(_ID).distinct()
    asked = calls.filter("call_id is not null").select(_ID, F.explode("depends_on").alias("on")).filter("on is not null").distinct()
    edges = checkpoint(asked.join(ids.select(F.col(_ID).alias("on"), F.lit(True).alias("known")), "on", "left").select(_ID, "on", "known"))
    missing = edges.filter("known is null").groupBy(_ID).agg(F.count("*").alias("n_missing"))
    edges = edges.filter("known").select(_ID, "on")
    several = checkpoint(edges.groupBy(_ID).agg(F.count("*").alias("n"), F.min("on").alias("on")))
    jump = chains(several.filter("n = 1").select(_ID, "on"))
    placed = _settled(ids.join(several, _ID, "left_anti").select(_ID, F.lit(0).cast("bigint").alias("level")))
    # an edge to a chain is one to the chain's end, as much farther off
    ends = jump.select(F.col(_ID).alias("on"), F.col("on").alias("far"), "steps")
    left = edges.join(several.filter("n > 1").select(_ID), _ID, "left_semi").join(ends, "on", "left")
    left = left.select(_ID, F.coalesce("far", "on").alias("on"), (F.coalesce("steps", F.lit(0).cast("bigint")) + 1).alias("steps"))
    left = _settled(left.groupBy(_ID, "on").agg(F.max("steps").alias("steps")))
    while not left.isEmpty():
        known = left.join(placed.select(F.col(_ID).alias("on"), "level"), "on", "left")
        ready = known.groupBy(_ID).agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count("*").alias("n"), F.count("level").alias("have")).filter("n = have")
        front = _settled(ready.select(_ID, "level"))
        if front.isEmpty():
            break
        placed = _settled(placed.unionByName(front))
        left = _settled(left.join(front, _ID, "left_anti").select(_ID, "on", "steps"))
    behind = jump.join(placed.select(F.col(_ID).alias("on"), "level"), "on").select(_ID, (F.col("level") + F.col("steps")).alias("level"))
    found = placed.unionByName(behind).select(_ID, F.col("level").cast("int").alias("level"))
    return ids.join(found, _ID, "left").join(missing, _ID, "left").select(_ID, "level", F.coalesce("n_missing", F.lit(0).cast("bigint")).alias("n_missing"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Calls (``call_id, name, arguments, depends_on``, and whatever else) with ``level, n_missing, valid, n_results, json``.

    ``results``: ``call_id, content``; of several for one call the smallest is serialised."""
    own = ("level", "n_missing", "valid", "n_results", "json")
    packed = calls.select(_ID, "name", "arguments", F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in calls.columns if c.lower() not in own]).alias("row"))
    answers = results.filter("call_id is not null").groupBy(_ID).agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    linked = packed.join(levels(calls.select(_ID, "depends_on")), _ID, "left").join(answers, _ID, "left")
    body = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col(_ID).alias("id"), F.col("name"), F.col("content").alias("result"))
    none = F.lit(0).cast("bigint")
    return linked.select("row.*", "level", F.coalesce("n_missing", none).alias("n_missing"), valid(F.col("name"), F.col("arguments"), schemas).alias("valid"), F.coalesce("n_results", none).alias("n_results"), F.to_json(body).alias("json"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results (all their columns) whose ``call_id`` is null or names no call."""
    known = calls.select(F.col(_ID).alias(_ID)).filter("call_id is not null").distinct()
    return results.join(known, _ID, "left_anti").select(*results.columns)


#: The tools that turns of a conversation stand for; other turns than those of users and assistants call a tool that is not among them.
TURNS: Schemas = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results, every row one of them: each user turn calls ``reply``, other roles call a tool
    of their name, and an assistant's turn is the result of the turn before. A call depends on those one and two turns earlier, as far as
    they are calls. A null conversation or turn makes a null identifier."""
    at = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    reply = F.coalesce(F.col("role") == "assistant", F.lit(False))
    name = F.when(F.col("role") == "user", F.lit("reply")).otherwise(F.col("role"))
    calls = messages.filter(~reply).select(at(0).alias(_ID), "conv_id", "turn", name.alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.array(at(1), at(2)).alias("depends_on"))
    return calls, messages.filter(reply).select(at(1).alias(_ID), "conv_id", "turn", F.col("text").alias("content"))
