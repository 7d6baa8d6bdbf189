"""Clusters of vectors: connected without a list of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import cells, components, similarity


def table(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, embedding array<float>")


def made(kind):
    r = np.random.default_rng(5)
    if kind == "even":
        return r.normal(size=(400, 12))
    if kind == "groups":  # four apart, and some on their own
        return np.concatenate([np.eye(12)[k] + 0.15 * r.normal(size=(80, 12)) for k in range(4)] + [r.normal(size=(60, 12)), np.zeros((2, 12))])
    angle = np.linspace(0, 3, 300)  # a chain, each linked with its neighbours only, with two gaps
    return np.array([[np.cos(a), np.sin(a)] for a in angle if not (0.9 < a < 1.2 or 2 < a < 2.1)])


@pytest.mark.parametrize(("kind", "threshold"), [("even", 0.6), ("even", 0.75), ("groups", 0.8), ("groups", 0.0), ("chain", 0.9999)])
def test_components_are_those_of_all_pairs(spark, kind, threshold):
    vectors = table(spark, made(kind))
    pairs = cells.pairs_within(vectors, threshold, "id")[0].select("a", "b").toPandas()
    node, low = components.smallest_reached(pairs["a"].to_numpy(), pairs["b"].to_numpy())
    found, looked = cells.linked_within(vectors, threshold, "id", block=16, cell=24)
    assert {r.node: r.component for r in found.collect()} == dict(zip(node.tolist(), low.tolist(), strict=True))
    if kind != "even" and threshold > 0:  # several components, so some rows looked beyond their cells
        assert not looked.isEmpty()


def test_edges_do_not_grow_with_the_square(spark, monkeypatch):
    r, rows, keep = np.random.default_rng(6), [], components.materialize

    def counted(df, name="table"):
        out = keep(df, name)
        rows.extend([out.count()] if name == "edges" else [])
        return out

    monkeypatch.setattr(components, "materialize", counted)
    vectors = table(spark, np.ones(8) + 0.1 * r.normal(size=(600, 8))).withColumn("lemma", F.col("id").cast("string"))
    out = similarity.cluster_vocab(vectors.select(F.col("id").alias("vocab_id"), "lemma"), vectors.select("lemma", "embedding"), 0.8)
    assert {r.cluster_id for r in out.collect()} == {0}
    assert rows and max(rows) <= 3 * 600
