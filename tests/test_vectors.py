"""Metric cells, vector means and exact quantiles against plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import cells, similarity
from lexispark.operators.enrichment import mean_vectors
from lexispark.operators.quantiles import doubles, exact_quantiles, ordered_bits


@pytest.fixture(scope="module")
def clustered():
    """Vectors around 40 places, some equal, one place with many, and a zero vector."""
    rng = np.random.default_rng(1)
    spots = rng.normal(size=(40, 12))
    x = spots[rng.integers(0, 40, 700)] + 0.05 * rng.normal(size=(700, 12))
    x[600:] = x[3]  # one hot vector
    x[50] = 0
    return x.astype(np.float32)


def frame(spark, x, name):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], f"{name} long, embedding array<float>").repartition(3)


def cosines(a, b):
    unit = lambda m: m / np.where((n := np.linalg.norm(m.astype(float), axis=1, keepdims=True)) == 0, 1, n)
    return unit(a) @ unit(b).T


@pytest.mark.parametrize("threshold", [0.8, 0.3, 0.0])
def test_pairs_within_the_angle(spark, clustered, threshold):
    found, sent = cells.pairs_within(frame(spark, clustered, "id"), threshold, "id", block=64, cell=8)
    s = cosines(clustered, clustered)
    want = {(a, b) for a, b in zip(*np.nonzero(s >= threshold), strict=True) if a < b}
    got = found.collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert max(abs(r.similarity - min(1, s[r.a, r.b])) for r in got) < 1e-6
    if threshold == 0.8:  # of over 40 cells a vector goes to its own and few others
        assert sent.count() < 4 * len(clustered)


def test_pairs_of_nothing(spark, clustered):
    assert similarity.similar_pairs(frame(spark, clustered[:0], "id")).count() == 0
    assert similarity.similar_pairs(frame(spark, clustered[50:51], "id")).count() == 0


def test_lsh_finds_nine_of_ten(spark, clustered):
    every = {(r.a, r.b) for r in similarity.similar_pairs(frame(spark, clustered, "id"), 0.8).collect()}
    some = {(r.a, r.b) for r in similarity.similar_pairs_lsh(frame(spark, clustered, "id"), 0.8).collect()}
    assert some <= every and len(some) >= 0.9 * len(every)


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("unit", [True, False])
def test_nearest_by_cells(spark, clustered, k, unit):
    rng = np.random.default_rng(2)
    asked = np.concatenate([clustered[rng.integers(0, 700, 80)], rng.normal(size=(20, 12)), np.zeros((1, 12))]).astype(np.float32)
    found, visits = cells.nearest(frame(spark, asked, "query_id"), frame(spark, clustered, "base_id"), k, unit, block=64, cell=8)
    if unit:
        key = -np.round(cosines(asked, clustered), 9)
    else:
        d = cells.distances(asked.astype(float), clustered.astype(float))
        d[d < 1e-7] = 0
        key = np.round(d, 9)
    want = {q: [int(b) for b in np.lexsort((np.arange(700), key[q]))[:k]] for q in range(len(asked))}
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add((-round(r.score, 9) if unit else round(r.score, 9), r.base_id))
    assert {q: [b for _, b in sorted(x)[:k]] for q, x in got.items()} == want
    near = visits.filter(F.col("query_id") < 80).count()
    assert near < 80 * 40 / 3  # queries near a place leave most of the cells out


def test_nearest_in_an_empty_table(spark, clustered):
    assert similarity.nearest(frame(spark, clustered[:4], "query_id"), frame(spark, clustered[:0], "base_id")).count() == 0
    assert similarity.nearest(frame(spark, clustered[:0], "query_id"), frame(spark, clustered[:4], "base_id")).count() == 0


def test_mean_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{k}", rng.normal(size=3 if k < 8 else 2).tolist()) for k in rng.integers(0, 12, 900).tolist()]
    rows += [("hot", [float(k), 1.0, -1.0]) for k in range(3000)] + [("nulls", [1.0, None]), ("nulls", [3.0, None]), ("none", None), ("none", []), (None, [1.0])]
    df = spark.createDataFrame(rows, "key string, embedding array<float>").repartition(4)
    got = {r.key: r.embedding for r in mean_vectors(df, "key").collect()}
    want = {k: np.mean([v for q, v in rows if q == k], axis=0).tolist() for k in {f"k{k}" for k in range(12)}} | {"hot": [1499.5, 1.0, -1.0]}
    assert got.keys() == want.keys() | {"nulls"} and got["nulls"] == [2.0, None]
    assert all(np.allclose(got[k], want[k], atol=1e-5) for k in want)
    assert mean_vectors(df.limit(0), "key").count() == 0


def test_mean_vectors_shuffles_vectors_and_not_elements(spark):
    df = spark.createDataFrame([(k % 5, [1.0] * 64) for k in range(2000)], "key int, embedding array<float>").coalesce(1)
    plan = mean_vectors(df, "key")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 2


def test_bits_order_like_doubles():
    x = np.array([-np.inf, -1e300, -1.0, -1e-310, -0.0, 0.0, 5e-324, 1e-9, 1.0, 1.0 + 2**-52, 1e300, np.inf])
    b = ordered_bits(x)
    assert (np.diff(b) >= 0).all() and b[4] == b[5] and (doubles(b.tolist()) == x).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=1001), "b": np.repeat([0.25, 0.5, 0.5000001], 400), "c": np.array([7.0]), "d": np.concatenate([-rng.exponential(size=500) * 1e-200, rng.normal(size=37) * 1e200, [0.0] * 9])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "scoring string, score double").repartition(3)
    ps = [0.0, 0.05, 0.5, 0.9, 0.95, 1.0]
    got = exact_quantiles(df, [(g, p) for g in ("a", "b", "c", "d", "e", "f") for p in ps])
    want = {(g, p): float(np.quantile(xs, p)) for g, xs in groups.items() for p in ps}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=0) for k in want)
