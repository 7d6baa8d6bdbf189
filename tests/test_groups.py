"""Prefix ranges, components, hub attributes and bucketed tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import components, thesaurus, vocabulary
from lexispark.sources import sinks


def test_prefixes_read_sorted_ranges(spark):
    draw = random.Random(1)
    words = sorted({"".join(draw.choices("abÀz %_", k=draw.randint(1, 5))) for _ in range(900)} | {"Abba", "ABBA", "abba"})
    asked = ["ab", "AB", "a%", "__", "zz", "Àb", "q", "abba", "abbaa", "", " "] + words[::40]
    df = spark.createDataFrame([(w,) for w in words], "lemma string").withColumn("_low", F.lower("lemma")).repartition(4)
    pre = spark.createDataFrame([(p,) for p in asked], "prefix string").distinct().withColumn("_p", F.lower("prefix"))
    for limit in (3, 50, 1000):
        got = {}
        for r in thesaurus.first_with_prefix(pre, df, limit).collect():
            got.setdefault(r.prefix, set()).add(r.lemma)
        want = {p: set(sorted((w for w in words if w.lower().startswith(p.lower())), key=lambda w: (w.lower().encode(), w.encode()))[:limit]) for p in asked}
        assert got == {p: w for p, w in want.items() if w}
    plan = thesaurus.first_with_prefix(pre, df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # the ranges of a prefix, no prefixes of words
    assert thesaurus.first_with_prefix(pre, df.limit(0), 3).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_tasks_contract_what_they_hold(spark, shape, monkeypatch):
    draw = random.Random(2)
    edges = {"chain": [(k, k + 1) for k in range(600)], "star": [(0, k) for k in range(1, 600)], "random": [(draw.randrange(900), draw.randrange(900)) for _ in range(700)]}[shape]
    draw.shuffle(edges)
    low = {n: n for e in edges for n in e}
    for _ in range(len(low)):
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    rounds, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda d, name: rounds.append(name) or write(d, name))
    assert {r.node: r.component for r in components.connected_components(df).collect()} == low
    with_contraction, rounds[:] = rounds.count("stars"), []
    monkeypatch.setattr(components, "contracted", lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    components.connected_components(df).count()
    assert with_contraction <= rounds.count("stars") - {"chain": 2, "star": 0, "random": 1}[shape]
    monkeypatch.undo()
    nodes_of_tasks = df.withColumn("t", F.spark_partition_id()).select("t", F.explode(F.array("a", "b"))).distinct().count()
    assert components.contracted(df.filter("a <> b")).count() < nodes_of_tasks
    assert components.contracted(df.filter("a <> b").coalesce(1)).count() == len(low) - len(set(low.values()))


def test_components_of_texts():
    nodes, low = components.smallest_reached(np.array(["b", "d", "x"], dtype=object), np.array(["c", "c", "y"], dtype=object))
    assert dict(zip(nodes, low, strict=True)) == {"b": "b", "c": "b", "d": "b", "x": "x", "y": "x"}


def test_a_hub_is_dealt_to_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        members = spark.createDataFrame([("hub", k) for k in range(1200)] + [("small", k) for k in range(5)] + [("one", 7)], "g string, m long")
        pairs = vocabulary.pairs_of_groups(members, "g", "m", hub=60).withColumn("task", F.spark_partition_id())
        per = pairs.groupBy("task").count().toPandas()["count"]
        assert per.sum() == 1200 * 1199 // 2 + 10 and len(per) >= 20 and per.max() < 0.1 * per.sum()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    distinct = vocabulary.pairs_of_groups(members.filter("g = 'hub' and m < 100"), "g", "m", hub=7)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in distinct.collect()} == {(a, b) for a in range(100) for b in range(a + 1, 100)} and distinct.count() == 4950


def test_a_bucketed_table_is_joined_without_a_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", k % 9, 0.5) for k in range(100)], "synset_id string, cluster_id long, salience_sum double")
    for _ in range(2):  # a table of that name is replaced
        table = sinks.write_bucketed(rows, "curated_in_buckets", "cluster_id", str(tmp_path / "curated"), 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        names = spark.createDataFrame([(k, f"c{k}") for k in range(9)], "cluster_id long, name string")
        joined = table.join(names, "cluster_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the other side's
        assert "Exchange" not in table.groupBy("cluster_id").count()._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP TABLE curated_in_buckets")


def serial_claims(lists):
    """Synsets in rank order take their first lemma that is free, else share their first."""
    taken, out = set(), {}
    for rank, lemmas in enumerate(lists, 1):
        pick = next((x for x in lemmas if x not in taken), None)
        out[rank] = (pick or lemmas[0], pick is None)
        taken.add(out[rank][0])
    return out


@pytest.mark.parametrize("shape", ["chain", "random"])
def test_claims_as_one_by_one(spark, shape, monkeypatch):
    draw = random.Random(3)
    if shape == "chain":  # every synset wants the lemma that the one before it had to move on to
        own = [[f"l{k:05d}", f"l{k + 1:05d}"] if k else ["l00001"] for k in range(5000)]
    else:
        own = [[f"l{x:05d}" for x in draw.sample(range(90), draw.randint(1, 4))] for _ in range(160)]
    names = [f"s{k:05d}" for k in range(len(own))]
    lemmas = spark.createDataFrame([(x, s) for s, xs in zip(names, own, strict=True) for x in xs], "lemma string, synset_id string").repartition(3)
    synsets = spark.createDataFrame([(s, "n") for s in names], "synset_id string, pos string")
    fam = spark.createDataFrame([], "lemma string, familiarity double")
    polysemy = {}
    for xs in own:
        for x in xs:
            polysemy[x] = polysemy.get(x, 0) + 1
    want = serial_claims([sorted(xs, key=lambda x: (polysemy[x], len(x), x)) for xs in own])
    written, write = [], vocabulary.materialize
    for module in (vocabulary, components):
        monkeypatch.setattr(module, "materialize", lambda d, name: written.append(name) or write(d, name))
    got = vocabulary.build_vocabulary(synsets, lemmas, fam).collect()
    assert {r.vocab_id: (r.lemma, r.is_shared) for r in got} == want
    assert all(r.synset_id == names[r.vocab_id - 1] and r.polysemy == polysemy[r.lemma] for r in got)
    assert len(written) < 20
