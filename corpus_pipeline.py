"""From raw documents to shards: toxic rows go, near duplicates go, benchmark leaks go, sources are
mixed to target weights, and what is left is dealt out to shards.

Every stage takes what the one before it kept, and each is written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexispark.functions.lineage import materialize
from lexispark.llm import decontaminate, mixing, ngram_join, sharding, toxicity

SHARDS = 8
#: Expected share of the tokens that the mixing stage keeps, and how far it evens out the margins.
BUDGET, TEMPERATURE = 0.9, 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, temperature=TEMPERATURE, budget=BUDGET)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(docs, n_shards=SHARDS).withColumns({"shard": F.col("shard").cast("int"), "slot": F.col("slot").cast("long")})


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: The toxicity stage fits a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
