"""Sketches of the n-gram join: they rule out pairs of a group of near copies, and never a link."""

import numpy as np
from pyspark.sql import functions as F

from lexispark.llm import ngram_join as N
from lexispark.operators import components
from lexispark.operators.components import connected_components


def test_sketches_rule_out_no_link(spark):
    draw = np.random.default_rng(4)
    rows, want = [], []
    for k in range(300):
        n, moved = int(draw.integers(1, 900)), draw.random() / 4
        a = draw.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.where(draw.random(n) < moved, draw.integers(0, 1 << 62, n).astype(np.uint64), a)
        sets = [np.unique(x) for x in (a, b)]
        common = len(np.intersect1d(*sets))
        want.append(100 * common >= N.PERCENT * (len(sets[0]) + len(sets[1]) - common))
        rows.append((k, *[N.sketch(s).tolist() for s in sets], *[len(s) for s in sets]))
    table = spark.createDataFrame(rows, "k int, x array<long>, y array<long>, nx long, ny long")
    got = {r.k: r.ok for r in table.select("k", N.alike(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")).alias("ok")).collect()}
    assert any(want) and all(got[k] for k, linked in enumerate(want) if linked)
    few = [k for k, r in enumerate(rows) if r[3] < 200 and not want[k]]
    assert few and sum(got[k] for k in few) < len(few) / 2


def test_outsiders_of_near_copies_meet_no_member(spark):
    """Of two outsiders in the lists of a component, only the one that differs in few tokens meets its members."""
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 62, 100).astype(np.uint64)
    sets = {k: np.append(base, np.uint64(k)) for k in range(50)}
    sets[50], sets[51] = np.append(base[:95], draw.integers(0, 1 << 62, 6).astype(np.uint64)), np.append(base[:60], draw.integers(0, 1 << 62, 41).astype(np.uint64))
    sketches = spark.createDataFrame([(k, N.sketch(s).tolist()) for k, s in sets.items()], "key long, sketch array<long>")
    lists = spark.range(52).selectExpr("id AS key", "explode(sequence(1L, 9L)) AS token", "101L AS n", "token - 1 AS pos", "CASE WHEN id < 50 THEN 0L ELSE id END AS component")
    for heavy in (0, 1000):
        got = sorted(map(tuple, N.across(N.mixed_lists(lists, heavy, sketches=sketches)).collect()))
        assert got == [(k, 50) for k in range(50)]
        assert {51} & {k for pair in N.sampled(N.mixed_lists(lists, heavy, 1, sketches), 60).collect() for k in pair} == set()


def test_few_edges_are_contracted_by_one_task(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(40)] + [(99, 99), (70, None)]
    rounds, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda d, name: rounds.append(name) or write(d, name))
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r.node: r.component for r in connected_components(df, alone=100).collect()} == {99: 99} | dict.fromkeys(range(41), 0)
    assert rounds == ["edges", "reached"]
    assert connected_components(df.limit(0), alone=100).count() == 0
    rounds.clear()
    assert connected_components(df, alone=3).count() == 42 and "stars" in rounds
