"""Steps that hold no more than they need: related words once, lists as rows, decimal scores."""

import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from lexispark.operators import concreteness as C, thesaurus as T
from lexispark.plans.views import document_tokens


def test_shootout_of_decimal_scores(spark):
    rows = [(str(i), [float(i % 7), float(i % 5), float(i % 3)], Decimal(i % 7) / 2) for i in range(80)]
    training = spark.createDataFrame(rows, "synset_id string, embedding array<float>, score decimal(29,16)")
    out = C.model_shootout(training, alphas=(0.1,), trees=(2,), depths=(2,), ks=(3,))
    assert {r.model for r in out.collect()} == {"ridge", "random_forest", "knn"}


def test_related_words_are_reduced_once(spark):
    rows = [("a", "b", "2", "similar"), ("a", "b", "9", "synonym"), ("a", "b", "3", "synonym"), ("a", "a", "1", "hypernym"), ("b", "c", "4", "hyponym"), ("b", "c", "5", "hyponym")]
    related = spark.createDataFrame(rows, "word string, node_id string, synset_id string, relation_type string")
    once = T.first_related(related)
    assert sorted(map(tuple, once.collect())) == [("a", "a", "1", "hypernym"), ("a", "b", "3", "synonym"), ("b", "c", "4", "hyponym")]
    chosen = spark.createDataFrame([("a", "b")], "word string, selected string")
    for got, want in zip(T.expand_graph(*T.word_graph(once), chosen, once), T.expand_graph(*T.word_graph(related), chosen, related), strict=True):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_cross_links_of_common_synsets(spark):
    nodes = spark.createDataFrame([("w", "a", 1), ("w", "b", 1), ("w", "c", 2), ("x", "a", 1), ("x", "d", 1)], "word string, node_id string, node_order int")
    lemmas = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2"), ("b", "2"), ("c", "1"), ("d", "2")], "lemma string, synset_id string")
    assert sorted(map(tuple, T.cross_links(nodes, lemmas).collect())) == [("w", "a", "b"), ("x", "a", "d")]


def test_collocations_carry_the_first_words_of_a_partner(spark):
    lemmas = spark.createDataFrame([(f"w{i:02}", "2") for i in range(30)] + [("w05", "1"), ("a", "3"), ("w05", "3")], "lemma string, synset_id string")
    syntagms = spark.createDataFrame([("1", "2"), ("2", "1"), ("3", "1"), ("3", "1")], "synset1id string, synset2id string")
    got = T.collocations(spark.createDataFrame([("1",)], "synset_id string"), syntagms, lemmas, 3)
    assert sorted(map(tuple, got.select("synset_id", "partner", "partner_synset_id").collect())) == [("1", "a", "3"), ("1", "w00", "2"), ("1", "w01", "2")]


def test_rows_are_digested_in_order(spark):
    rows = [("x", f"{i:05}", f"t{i}") for i in range(12_000)] + [("y", "1", None), ("y", "2", "b"), ("z", "1", None)]
    got = {r.word: (r.n_senses, r.senses_md5) for r in T.written_out(spark.createDataFrame(rows, "word string, k string, text string").orderBy(F.desc("k")), ["k"]).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert got == {"x": (12_000, md5("|".join(f"t{i}" for i in range(12_000)))), "y": (2, md5("b")), "z": (1, md5(""))}


def test_tokens_of_documents_are_counted_where_they_are_read(spark):
    texts = [(1, "b a B K x1y"), (2, None), (3, ""), (4, "12 été z z z a")]
    one = document_tokens(spark.createDataFrame(texts, "doc_id long, text string"))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    twice = document_tokens(spark.createDataFrame([*texts, (4, "a a a a")], "doc_id long, text string"))
    want = {(1, "a", 1, 2, 2), (1, "b", 2, 1, 2), (1, "k", 1, 3, 2), (1, "x", 1, 4, 2), (1, "y", 1, 5, 2)}
    assert set(map(tuple, one.collect())) == want | {(4, "z", 3, 1, 3), (4, "a", 1, 2, 3), (4, "t", 1, 3, 3)}
    assert set(map(tuple, twice.collect())) == want | {(4, "a", 5, 1, 5), (4, "z", 3, 2, 5), (4, "t", 1, 3, 5)}
