"""Steps that grow with the input and no faster: rows spread over tasks, vectors looked up, pairs not shuffled."""

from pyspark.sql import functions as F

from lexispark.operators import concreteness as C, enrichment as E, vocabulary as V
from lexispark.plans import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_of_one_row_group_are_spread(spark, tmp_path):
    spark.range(3000).selectExpr("id AS doc_id", "concat('a b a w', cast(id % 5 AS string), ' zz') AS text").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = views.document_tokens(spark.read.parquet(str(tmp_path / "d")))
    assert got.select(F.spark_partition_id()).distinct().count() > 4
    assert {(r.tok, r.n, r.pos_in_list) for r in got.filter("doc_id = 7").collect()} == {("a", 2, 1), ("b", 1, 2), ("w", 1, 3), ("zz", 1, 4)}
    assert got.count() == 12_000


def test_few_vectors_are_looked_up(spark, monkeypatch):
    lemmas = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "1"), ("c", "2"), ("x", "3"), ("a", None), (None, "4"), ("n", "5")], "lemma string, synset_id string").repartition(3)
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0, None]), ("c", [0.5, float("nan")]), ("n", [None, 7.0])], "lemma string, embedding array<float>")
    sent = C.synset_embeddings(lemmas, vectors)
    assert "Join" not in plan(sent)
    got = {r.synset_id: r.embedding for r in sent.collect()}
    assert got == {"1": [2.0, 2.0], "2": [0.5, None], "5": [None, 7.0]}
    monkeypatch.setattr(E, "SENT_VECTORS", 2)
    assert {r.synset_id: r.embedding for r in C.synset_embeddings(lemmas, vectors).collect()} == got
    monkeypatch.undo()
    twice = vectors.union(vectors.limit(1)).union(spark.createDataFrame([("z", [1.0])], "lemma string, embedding array<float>"))
    assert E.sent_vectors(twice) is None and E.sent_vectors(vectors.limit(0)) is None


def test_polysemy_of_distinct_rows_shuffles_no_pairs(spark):
    lemmas = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", None)], "lemma string, synset_id string")
    got = V.lemma_polysemy(lemmas, distinct=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, V.lemma_polysemy(lemmas).collect())) == [("a", 2), ("b", 1), ("c", 0)]
    assert plan(V.lemma_polysemy(lemmas, distinct=True)).count("Exchange hash") == 1


def test_lists_of_lemmas_are_made_for_chosen_synsets_only(spark):
    synsets = spark.createDataFrame([(str(k), "n", f"d{k}") for k in range(6)] + [("1", "v", "other"), ("2", "n", "d2")], "synset_id string, pos string, definition string")
    lemmas = spark.createDataFrame([(f"w{k % 4}", str(k)) for k in range(6)] + [("v", "1"), ("v", "1")], "lemma string, synset_id string")
    freqs = spark.createDataFrame([("w1", 5.0), ("w2", 4.0), ("w3", 1.0)], "lemma string, familiarity double")
    seen = spark.createDataFrame([("3",)], "synset_id string")
    out = E.rank_synsets_for_enrichment(synsets, lemmas, freqs, seen, 6, 0, spark.createDataFrame([("0",)], "synset_id string"))
    got = sorted(tuple(r) for r in out.drop("rank").collect())
    assert got == [("0", "w0", "n", "d0", ["w0"]), ("1", "w1", "n", "d1", ["v", "w1"]), ("1", "w1", "v", "other", ["v", "w1"]), ("2", "w2", "n", "d2", ["w2"]), ("2", "w2", "n", "d2", ["w2"]), ("5", "w1", "n", "d5", ["w1"])]
    assert sorted(r["rank"] for r in out.collect()) == [1, 2, 3, 4, 5, 6]
    assert plan(E.familiar_synsets(synsets, lemmas, freqs)).count("collect_set") == 0
