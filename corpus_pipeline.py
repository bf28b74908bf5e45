"""From raw documents to shards: toxicity, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and
hands the next stage what it reads back, so a lost executor never reaches further than one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, neardup, sharding, toxicity
from tessera.llm.common import columns, free, read, remove_folder, shared_folder

#: Documents whose score reaches this go.
TOXIC = 0.7
SHARDS = 24
#: Wanted shares of the domains that the toxicity stage leaves, in the proportions of mixing.
_LEFT = {d: w for d, w in mixing.WEIGHTS.items() if d != "toxic"}
WEIGHTS = {d: w / sum(_LEFT.values()) for d, w in _LEFT.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    name = free(docs, "score")
    return toxicity.score(docs, model, keep_text=True, name=name).filter(F.col(name) < TOXIC).select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(docs, read(spark, sf_dir, "benchmark"))
    return found.filter(F.size(found.columns[-1]) == 0).select(*columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, read(spark, sf_dir, "labels"), WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shards(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL cannot train the classifiers or walk the components; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from its folder below spark.checkpoint.dir; the folders of the others go as soon as they have been read."""
    docs, last = read(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove_folder(spark, last)
        last = f"{folder}/{name}"
    return docs
