"""The operators over their tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, lines, mixing, secrets, sharding, simhash, toolcalls, topk, toxicity
from .common import read


def op1_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(read(spark, d, "documents"))


def op2_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shards(read(spark, d, "documents"), 24)


def op3_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.search(read(spark, d, "embeddings"), F.expr("vec_id % 50 = 0"))


def op4_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html.extract(read(spark, d, "pages"))


def op5_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.rates(read(spark, d, "documents"), read(spark, d, "labels")).drop("key")


def op6_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    calls, results = toolcalls.turns(read(spark, d, "conversations"))
    linked = toolcalls.link(calls, results, toolcalls.TURNS)
    lone = toolcalls.orphans(calls, results)
    nothing = {"level": F.lit(None).cast("int"), "n_missing": F.lit(0).cast("bigint"), "valid": F.lit(False), "n_results": F.lit(0).cast("bigint"), "json": F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")))}
    cols = ["conv_id", "turn", "call_id", *nothing]
    return linked.select(*cols).unionByName(lone.withColumns(nothing).select(*cols))


def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = lines.remove(read(spark, d, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, d, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.matches(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.col("hits.item_id").alias("item_ids"))


def op10_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.classes(read(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_sharding, op3_topk, op4_html_extraction, op5_mixing, op6_tool_calls, op7_line_dedup, op8_toxicity, op9_decontamination, op10_simhash)
}

ORACLE: dict[str, str] = {
    "op3_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings),
        s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(range(1, 65), lambda k: q.e[k] * c.e[k])) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op6_tool_calls": """
        with recursive m as (select *, conv_id || ':' || turn as me, conv_id || ':' || (turn - 1) as one, conv_id || ':' || (turn - 2) as two, coalesce(role = 'assistant', false) as reply from conversations),
        c as (select conv_id, turn, text, me as call_id, one, two, case when role = 'user' then 'reply' else role end as name from m where not reply),
        r as (select one as call_id, min(text) as content, count(*) as n from m where reply and one is not null group by 1),
        e as (select distinct a.call_id, b.call_id as dep from c a join c b on b.call_id in (a.one, a.two)),
        l as (select distinct call_id, 0 as level from c where call_id is not null and call_id not in (select call_id from e)
              union select e.call_id, l.level + 1 from l join e on e.dep = l.call_id),
        h as (select call_id, max(level) as level from l group by 1),
        k as (select call_id, count(*) as n from e group by 1)
        select c.conv_id, c.turn, c.call_id, cast(h.level as int) as level, case when c.call_id is null then 0 else 2 - coalesce(k.n, 0) end as n_missing,
               coalesce(c.name = 'reply' and c.text is not null and c.turn is not null, false) as valid, coalesce(r.n, 0) as n_results,
               '{"arguments":{' || coalesce('"text":' || to_json(c.text) || ',', '') || '"turn":' || c.turn || '},"id":' || to_json(c.call_id) || ',"name":' || to_json(c.name) || coalesce(',"result":' || to_json(r.content), '') || '}' as json
        from c left join h using (call_id) left join k using (call_id) left join r using (call_id)
        union all
        select conv_id, turn, one, null, 0, false, 0, '{' || coalesce('"id":' || to_json(one), '') || coalesce(case when one is null then '' else ',' end || '"result":' || to_json(text), '') || '}'
        from m where reply and (one is null or one not in (select call_id from c where call_id is not null))""",
    "op7_line_dedup": r"""
        with d as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents),
        x as (select doc_id, source, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
        t as (select doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as k from x),
        bad as (select k from t where k <> '' group by k having count(distinct source) >= 5),
        kept as (select t.doc_id, count(*) as n_lines, count(bad.k) as n_removed, string_agg(case when bad.k is null then line end, chr(10) order by pos) as txt
                 from t left join bad on t.k = bad.k group by t.doc_id)
        select doc_id, n_lines, n_removed, md5(coalesce(txt, '')) as kept_md5 from kept""",
}
