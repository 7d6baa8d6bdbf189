"""Plans that driver and executors hold for many small steps."""

import re

from pyspark.sql import functions as F

from lexispark.llm import mixing, sharding


def test_a_sweep_reads_the_cells_once(spark, monkeypatch):
    plans, keep = [], mixing.materialize

    def seen(df, name="table"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)

    cells = spark.createDataFrame([("a", "x", "p", 10), ("a", "y", "q", 30), ("b", "x", "q", 60)], "source string, lang string, topic string, tokens long")
    want = mixing.default_targets(keep(cells), mixing.MARGINS, 1.0)
    monkeypatch.setattr(mixing, "materialize", seen)
    raked = mixing.rake(keep(cells), want, sweeps=3)
    assert [len(re.findall("Relation ", p)) for p in plans[1:]] == [1, 1, 1]
    assert {r.tokens: round(r.weight, 9) for r in raked.collect()} == {10: 0.1, 30: 0.3, 60: 0.6}


def test_a_cut_is_found_without_ranking_digits(spark, monkeypatch):
    plans, frame = [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (plans.append(self._jdf.queryExecution().optimizedPlan().toString()), collect(self))[1])
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), F.col("id").cast("int")).alias("text"))
    out = sharding.kd_shards(docs, n_shards=3).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()
    assert sorted(out["shard"]) == [0, 1, 2] and out["s"].max() - out["s"].min() < 600
    assert plans and not any("Window" in p for p in plans)
