"""Small tables with pinned answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import scores, text
from lexispark.operators import components, concreteness, enrichment, evaluation, frequency, retrieval, similarity, thesaurus, trials, vocabulary
from lexispark.sources import sinks, tables


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column).first()[0]


@pytest.fixture(scope="module")
def lexicon(spark):
    synsets = spark.createDataFrame([("k1", "n", "a"), ("k2", "v", "b"), ("k3", "r", "c"), ("k4", "n", "d")], "synset_id string, pos string, definition string")
    lemmas = spark.createDataFrame([("plod", "k1"), ("plod", "k2"), ("plod", "k3"), ("trudge", "k1"), ("trudge", "k4"), ("slog", "k2"), ("slog", "k4"), ("amble", "k3")], "lemma string, synset_id string")
    freq = spark.createDataFrame([("plod", 2.5), ("trudge", 4.0), ("slog", 4.5), ("amble", 1.0)], "lemma string, familiarity double")
    return synsets, lemmas, freq


def test_vocabulary_takes_the_least_polysemous_free_lemma(lexicon):
    # familiarity ranks k2 and k4 (4.5), k1 (4.0), k3 (2.5); polysemy is amble 1, slog 2, trudge 2, plod 3
    got = {r.synset_id: (r.vocab_id, r.lemma, r.is_shared) for r in vocabulary.build_vocabulary(*lexicon).collect()}
    assert got == {"k2": (1, "slog", False), "k4": (2, "trudge", False), "k1": (3, "plod", False), "k3": (4, "amble", False)}


def test_vocabulary_shares_a_lemma_when_all_are_taken(spark):
    synsets = spark.createDataFrame([("x", "n"), ("y", "n")], "synset_id string, pos string")
    lemmas = spark.createDataFrame([("only", "x"), ("only", "y")], "lemma string, synset_id string")
    freq = spark.createDataFrame([("only", 3.0)], "lemma string, familiarity double")
    assert [(r.synset_id, r.lemma, r.is_shared) for r in vocabulary.build_vocabulary(synsets, lemmas, freq).orderBy("vocab_id").collect()] == [("x", "only", False), ("y", "only", True)]


def test_vocabulary_equals_serial_claiming(spark):
    import random

    draw = random.Random(2)
    edges = sorted({(f"l{draw.randint(0, 25)}", f"s{k:03d}") for k in range(60) for _ in range(draw.randint(1, 3))})
    fam = {f"l{k}": float(draw.randint(0, 5)) for k in range(26)}
    ids = sorted({s for _, s in edges})
    poly = {lem: sum(x == lem for x, _ in edges) for lem, _ in edges}
    top = {s: max(fam[lem] for lem, x in edges if x == s) for s in ids}
    want, taken = {}, set()
    for s in sorted(ids, key=lambda s: (-top[s], s)):
        cand = sorted((lem for lem, x in edges if x == s), key=lambda lem: (poly[lem], len(lem), lem))
        free = [c for c in cand if c not in taken]
        want[s] = (free or cand)[0]
        taken.update(free[:1])
    got = vocabulary.build_vocabulary(spark.createDataFrame([(s, "n") for s in ids], "synset_id string, pos string"), spark.createDataFrame(edges, "lemma string, synset_id string"), spark.createDataFrame(list(fam.items()), "lemma string, familiarity double"))
    assert {r.synset_id: r.lemma for r in got.collect()} == want


def test_antonyms(spark):
    rel = spark.createDataFrame([("p", "size", "60"), ("q", "size", "60"), ("r", "size", "60"), ("p", "hue", "60"), ("s", "hue", "11")], "source_synset string, target_synset string, relation_type string")
    vocab = spark.createDataFrame([(4, "p", "vast"), (7, "q", "tiny"), (9, "s", "pale")], "vocab_id long, synset_id string, lemma string")
    pairs = vocabulary.antonym_pairs(rel, vocab)
    assert sorted(map(tuple, pairs.collect())) == [(4, 7), (7, 4)]
    apart = spark.createDataFrame([(4, 2)], "vocab_id long, cluster_id long")
    assert sorted(map(tuple, vocabulary.cluster_antonyms(pairs, apart).collect())) == [(2, 7), (7, 2)]
    same = spark.createDataFrame([(4, 3), (7, 3)], "vocab_id long, cluster_id long")
    assert vocabulary.cluster_antonyms(pairs, same).count() == 0


def test_clusters(spark):
    # cosines: oak-elm 0.96, elm-ash 0.8, oak-ash 0.6, so oak and ash meet through elm only
    vectors = spark.createDataFrame([("oak", [5.0, 0.0, 0.0]), ("elm", [24.0, 7.0, 0.0]), ("ash", [3.0, 4.0, 0.0]), ("sea", [0.0, 0.0, 2.0])], "lemma string, embedding array<float>")
    vocab = spark.createDataFrame([(11, "ash"), (12, "oak"), (13, "elm"), (14, "sea"), (15, "absent")], "vocab_id long, lemma string")
    got = {r.vocab_id: (r.cluster_id, r.is_representative, r.is_singleton) for r in similarity.cluster_vocab(vocab, vectors, 0.79).collect()}
    assert got == {11: (11, True, False), 12: (11, False, False), 13: (11, False, False), 14: (14, True, True), 15: (15, True, True)}
    exact = similarity.similar_pairs(vectors.select(F.hash("lemma").cast("long").alias("id"), "embedding"), 0.79)
    near = similarity.similar_pairs_lsh(vectors.select(F.hash("lemma").cast("long").alias("id"), "embedding"), 0.79)
    show = lambda df: sorted((r.a, r.b, round(r.similarity, 4)) for r in df.collect())
    assert len(show(exact)) == 2 and show(near) == show(exact)
    chain = components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(99, 99)], "a long, b long"))
    assert {r.node: r.component for r in chain.collect()} == {**dict.fromkeys(range(41), 0), 99: 99}


def test_snapping(spark):
    vocab = spark.createDataFrame([(2, "damp"), (5, "hoot"), (6, "damp"), (8, "blaze")], "vocab_id long, lemma string")
    props = spark.createDataFrame([(1, "damp", [0.0, 3.0]), (2, "hooted", None), (3, "moist", [1.0, 7.0]), (4, "qq", None), (5, "null", [0.0, 0.0]), (6, "dry", [4.0, -3.0]), (7, "blazing", None)], "property_id long, text string, embedding array<float>")
    links = spark.createDataFrame([("u", 1, " DAMP", 0.125), ("u", 2, "hooted", 1.0), ("u", 3, "moist", 0.5), ("u", 4, "qq", 1.0), ("u", 5, "null", 1.0), ("u", 6, "dry", 0.25), ("w", 3, "moist", 0.75), ("w", 7, "blazing", 1.0)], "synset_id string, property_id long, text string, salience double")
    clusters = spark.createDataFrame([(2, 40)], "vocab_id long, cluster_id long")
    got = {(r.synset_id, r.cluster_id): (r.vocab_id, r.snap_method, r.salience_sum) for r in similarity.snap_properties(links, props, vocab, clusters).collect()}
    assert got == {("u", 40): (2, "exact", 0.625), ("u", 5): (5, "morphological", 1.0), ("w", 40): (2, "embedding", 0.75), ("w", 8): (8, "morphological", 1.0)}
    snapped = similarity.snap_links(links, props, vocab)
    rejects = {r.text: (r.reason, r.best_score) for r in similarity.snap_rejects(links, snapped, props, vocab).collect()}
    assert rejects == {"qq": ("no_embedding", None), "null": ("zero_norm", None), "dry": ("below_threshold", pytest.approx(-0.6))}
    assert {r.stage: r.n for r in similarity.snap_counts(links, snapped).collect()} == {"exact": 1, "morphological": 2, "embedding": 2, "dropped": 3}
    irregular = spark.createDataFrame([("went", "go")], "form string, lemma string")
    forms = similarity.snap_morphological(spark.createDataFrame([(1, "went", "z")], "property_id long, text string, synset_id string"), spark.createDataFrame([(3, "go")], "vocab_id long, lemma string"), irregular)
    assert [r.vocab_id for r in forms.collect()] == [3]


def test_retrieval(spark):
    curated = spark.createDataFrame([("hub", 1, 2.0), ("hub", 2, 1.0), ("rim", 1, 0.5), ("rim", 3, 4.0), ("cog", 1, 1.5), ("cog", 2, 0.25), ("axle", 5, 1.0), ("alt", 3, 1.0)], "synset_id string, cluster_id long, salience_sum double")
    vocab = spark.createDataFrame([(1, "round"), (2, "central"), (3, "outer"), (4, "flat")], "vocab_id long, lemma string")
    ant = spark.createDataFrame([(2, 3), (3, 2), (1, 5), (5, 1)], "a long, b long")
    synsets = spark.createDataFrame([(s, "n", f"the {s}") for s in ("hub", "rim", "cog", "axle", "alt")], "synset_id string, pos string, definition string")
    lemmas = spark.createDataFrame([("wheel", "hub"), ("wheel", "alt"), ("edge", "rim"), ("tooth", "cog"), ("rod", "axle")], "lemma string, synset_id string")
    src = spark.createDataFrame([("hub",)], "source_id string")
    got = {r.lemma: (r.rank, r.salience_sum, r.contrast_count, r.shared_properties) for r in retrieval.forge_by_synset(src, curated, vocab, ant, synsets, lemmas).collect()}
    # hub shares 1 with rim and 1, 2 with cog; 2 opposes 3 (rim, alt) and 1 opposes 5 (axle)
    assert got == {"tooth": (1, 1.75, 0, ["central", "round"]), "edge": (2, 0.5, 1, ["round"]), "wheel": (3, 0.0, 1, []), "rod": (4, 0.0, 1, [])}
    words = spark.createDataFrame([("wheel",)], "word string")
    found = {r.lemma: r for r in retrieval.suggest(words, lemmas, curated, vocab, ant, synsets, spark.createDataFrame([("wheel", [1.0, 0.0]), ("tooth", [0.0, 1.0])], "lemma string, embedding array<float>")).collect()}
    assert set(found) == {"edge", "tooth"}  # the word's own senses and what only contrasts are out
    # edge shares 0.5 with the sense hub, 4.0 with alt; its contrast is 1 over hub (2-3) and none over alt
    assert (found["edge"].source_synset_id, found["edge"].salience_sum, found["edge"].contrast_count, found["edge"].tier) == ("alt", 4.0, 1, "legendary")
    assert (found["tooth"].source_synset_id, found["tooth"].salience_sum, found["tooth"].domain_distance) == ("hub", 1.75, 1.0)
    assert found["tooth"].composite_score == pytest.approx(2 * 1.75**0.5) and (found["edge"].rank, found["tooth"].rank) == (1, 2)


def test_retrieval_does_not_depend_on_how_the_join_is_dealt(spark, monkeypatch):
    import random

    draw = random.Random(4)
    curated = spark.createDataFrame([(f"s{k}", c, draw.randint(1, 40) / 8) for k in range(60) for c in draw.sample(range(12), 4)], "synset_id string, cluster_id long, salience_sum double")
    vocab = spark.createDataFrame([(k, f"p{k}") for k in range(11)], "vocab_id long, lemma string")
    ant = spark.createDataFrame([(0, 1), (1, 0), (4, 7), (7, 4)], "a long, b long")
    synsets = spark.createDataFrame([(f"s{k}", "n", "d") for k in range(60)], "synset_id string, pos string, definition string")
    lemmas = spark.createDataFrame([(f"w{k % 3}", f"s{k}") for k in range(60)], "lemma string, synset_id string")
    words = lemmas.select(F.col("lemma").alias("word")).distinct()
    run = lambda: sorted(map(str, retrieval.forge_by_lemma(words, lemmas, curated, vocab, ant, synsets, 7).collect()))
    whole = run()
    deal = retrieval.top_targets
    monkeypatch.setattr(retrieval, "top_targets", lambda *a, **kw: deal(*a, **kw, block_rows=40, task_rows=50))
    assert len(whole) == 21 and run() == whole


def test_formulas(spark):
    for sal, con, want in ((4, 3, "complex"), (1, 3, "ironic"), (3, 3, "strong"), (4, 0, "legendary"), (2, 2, "strong"), (1, 1, "unlikely")):
        assert one(spark, scores.classify_tier(F.col("s"), F.col("c")), s=sal, c=con) == want
    assert one(spark, scores.composite_score(F.lit(0.0), F.lit(0.9))) == 0 and one(spark, scores.composite_score(F.lit(4.0), F.lit(7.0))) == 4
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, scores.cosine_distance(arr(1.0, 0.0), arr(0.0, 0.0))) == 1 and one(spark, scores.cosine_distance(arr(1.0), arr(1.0, 2.0))) == 1
    assert one(spark, text.rarity(F.lit(None).cast("double"), F.lit(4.5))) == "common" and one(spark, text.rarity(F.lit(3.4), F.lit(9.0))) == "rare"
    assert one(spark, text.suffix_variants(F.lit("flickering"))) == ["flicker", "flickere"] and one(spark, text.suffix_variants(F.lit("ring"))) == []
    assert one(spark, text.extract_marked(F.lit("a <b>x\ny</b> <b>z</b>"))) == "x\ny" and one(spark, text.extract_marked(F.lit("none"))) is None
    assert one(spark, text.filter_mwe(F.lit("two words"))) is False and one(spark, text.filter_mwe(F.lit(""))) is True


def test_enrichment_documents(spark):
    v1 = {"synsets": [{"id": "syn001", "lemma": "candle", "definition": "d", "pos": "n", "properties": ["Warm", "wax-like", "warm", "x/y"], "lemma_metadata": [{"lemma": "candle", "register": "neutral", "connotation": "neutral"}]}]}
    v2 = {"results": [{"id": "syn002", "lemma": "storm", "definition": "d", "pos": "n", "properties": [{"text": "loud", "salience": 0.5, "type": "physical"}, {"salience": 1}, {"text": "dark"}]}], "config": {"model": "m"}}
    docs = tables.parse_enrichment(spark.createDataFrame([(json.dumps(v1),), (json.dumps(v2),)], "json string"))
    props = tables.explode_properties(docs)
    assert sorted((r.text, r.salience, r.property_type) for r in props.collect() if r.synset_id == "syn002") == [("dark", 1.0, None), ("loud", 0.5, "physical")]
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("warm", [1.0, 1.0])], "lemma string, embedding array<float>")
    vocab = enrichment.curate_properties(props, vectors)
    assert {r.text: (r.property_id, r.is_oov) for r in vocab.collect()} == {"dark": (1, True), "loud": (2, True), "warm": (3, False), "x/y": (4, False)}
    assert next(r.embedding for r in vocab.collect() if r.text == "x/y") == [0.5, 0.5]
    assert enrichment.populate_properties(props, vocab).count() == 4 and enrichment.rejected_properties(props).first().n == 1
    bad = tables.parse_enrichment(spark.createDataFrame([('{"other": 1}',)], "json string"))
    with pytest.raises(Exception, match="neither"):
        bad.collect()


def test_pair_scores(spark):
    words = spark.createDataFrame([("tide", "T"), ("crowd", "C"), ("ledger", "L"), ("moth", "M"), ("bare", "B")], "word string, synset_id string")
    bags = spark.createDataFrame([("T", 10, 2.0), ("T", 20, 1.0), ("T", 30, 3.0), ("C", 10, 0.5), ("C", 30, 4.0), ("L", 40, 1.0), ("M", 50, 2.0)], "synset_id string, cluster_id long, salience_sum double")
    pairs = spark.createDataFrame([("a", "apt", "tide", "crowd"), ("b", "inapt", "ledger", "moth"), ("c", "apt", "tide", "bare"), ("d", "apt", "tide", "who")], "pair_id string, class string, word_a string, word_b string")
    got = {r.pair_id: r for r in evaluation.score_pairs(pairs, words, bags).collect()}
    # common 10 and 30: least 0.5 + 3, greatest 2 + 1 + 4
    assert got["a"]["jaccard_salience"] == 0.5 and got["a"]["jaccard_raw"] == round(2 / 3, 6)
    assert got["a"]["cosine_salience"] == pytest.approx(13 / (14 * 16.25) ** 0.5, abs=1e-6)
    assert got["b"]["status"] == "scored" and got["b"]["jaccard_salience"] == 0 and 0 <= got["b"]["null"] < 1
    assert [got[k]["status"] for k in "cd"] == ["no_properties", "unresolved"] and got["c"]["jaccard_raw"] is None
    with pytest.raises(ValueError, match="jaccard_raw"):
        evaluation.check_scorings(["nope"])


def test_pairs_are_resolved(spark):
    pairs = spark.createDataFrame([("1", "sun", "lamp", "strong"), ("2", "sun", "nil", "weak"), ("3", "nil", "none", "weak")], "pair_id string, source string, target string, tier string")
    lemmas = spark.createDataFrame([("sun", "s2"), ("sun", "s1"), ("lamp", "s9")], "lemma string, synset_id string")
    full = evaluation.resolve_pairs(pairs, lemmas)
    assert {r.pair_id: r.reason for r in full.collect()} == {"1": None, "2": "target not found", "3": "source not found"}
    assert sorted(r.synset_id for r in evaluation.needed_synsets(full).collect()) == ["s1", "s2", "s9"]
    assert {r.pair_id: r.reason for r in evaluation.resolve_pairs(pairs, lemmas, sides=("source",)).collect()} == {"1": None, "2": None, "3": "source not found"}
    assert [r.pair_id for r in evaluation.resolve_pairs(pairs, lemmas, pairs.filter("pair_id = '2'")).collect()] == ["2"]


def test_auc_and_ranks(spark):
    rows = lambda w, *d: [(w, k, x) for k, x in enumerate(d, 1)]
    df = spark.createDataFrame(rows("best", "cross", "cross", "same") + rows("worst", "same", "cross") + rows("half", "cross", None), "word string, rank long, domain string")
    assert {r.word: r.rank_auc for r in evaluation.rank_auc(df).collect()} == {"best": 1.0, "worst": 0.0, "half": None}
    ranks = spark.createDataFrame([("a", 2), ("b", None)], "pair_id string, rank long")
    assert tuple(evaluation.mrr(ranks).first()) == ("all", 0.25, 1, 2)


def test_trials(spark):
    t = spark.createDataFrame([("p", 0, 0.5, False), ("p", 1, 0.6, True), ("p", 2, 0.4, False), ("p", 3, 0.7, False)], "prompt_name string, generation int, mrr double, survived boolean").withColumn("valid", F.col("generation") != 2)
    assert [(r.parent_mrr, r.kept) for r in trials.lineage_timeline(t).orderBy("generation").collect()] == [(0.5, False), (0.5, True), (0.6, False), (0.6, False)]
    assert tuple(trials.trailing_failures(t, limit=1).first()) == ("p", 1, True)
    r = 1500.0
    for s in (1.0, 0.0, 0.5):
        r += 32 * (s - 1 / (1 + 10 ** ((1500 - r) / 400)))
    elo = spark.createDataFrame([("p", 2, 0.5), ("p", 0, 1.0), ("p", 1, 0.0)], "prompt_name string, order int, score double")
    assert trials.elo_ratings(elo).first().rating == pytest.approx(r)
    pool = spark.createDataFrame([(f"p{k:02d}", "strong" if k < 12 else "weak", "archetypal" if k % 5 == 0 else None) for k in range(20)], "pair_id string, tier string, register string")
    first = trials.rotate_subset(pool, seed=1)
    second = trials.rotate_subset(pool, seed=2, previous=first)
    assert first.count() >= 13 and second.filter("is_carried").count() == round(0.5 * 8) + round(0.5 * 5) and second.filter("is_fresh").join(first, "pair_id").count() == 0


def test_loaders(spark):
    raw = spark.createDataFrame([(1, "Dog", None, "1", "NA", "W"), (2, "dog ", "5.5", "1", "x", "W"), (3, "dog", "6", "1", "4", "W"), (4, "two words", "2", "1", "3", "M")], "row_no long, Word string, Fam string, Dom string, Zipf string, EntryType string")
    assert [tuple(r) for r in tables.load_familiarity(raw).collect()] == [("dog", 5.5, 1, None)]
    counts = spark.createDataFrame([(1, "A", "x", "1"), (2, "a", "4.5", "1,234")], "row_no long, word string, zipf string, frequency string")
    assert [tuple(r) for r in tables.load_word_frequency(counts).collect()] == [("a", 4.5, 1234)]
    lines = spark.createDataFrame([(1, "2 2"), (2, "a 1 2"), (3, "a 3 4"), (4, "b 1"), (5, "c x 1")], "n long, value string")
    vec, skipped = tables.parse_vectors(lines, 2, ["n"])
    assert [tuple(r) for r in vec.collect()] == [("a", [1.0, 2.0])] and {r.reason: r.n for r in skipped.collect()} == {"malformed": 2, "duplicate": 1}
    blobs = tables.decode_vectors(spark.createDataFrame([(bytearray(b"\x00\x00\x80?\x00\x00\x00@"),), (bytearray(b"x"),), (None,)], "embedding binary"), 2)
    assert [r[0] for r in blobs.collect()] == [[1.0, 2.0], None, None]
    good, bad = tables.parse_controls(spark.createDataFrame([('{"label": "inapt", "target": "t"}',), ('{"label": "apt"}',), ("[1]",), ("{oops",)], "value string"))
    assert good.count() == 1 and bad.first().n == 2
    with pytest.raises(ValueError, match="Bigram"):
        tables.load_concreteness(spark.createDataFrame([("a",)], "Word string"))
    version = lambda *rows: tables.load_pairs(spark.createDataFrame(rows, "source string, target string, tier string")).first().version
    assert version(("a", "b", "x"), ("c", "d", "x")) == version(("c", "d", "x"), ("a", "b", "x")) != version(("a", "b", "y"), ("c", "d", "x"))
    assert len(version(("a", "b", "x"))) == 16
    with pytest.raises(Exception, match="lacks"):
        tables.load_pairs(spark.createDataFrame([("a", None)], "source string, target string")).collect()


def test_load_files(spark, tmp_path):
    (tmp_path / "v.vec").write_text("1 2\nw 0.5 1\nw 9 9\n")
    assert [tuple(r) for r in tables.load_vectors(spark, str(tmp_path / "v.vec"), 2)[0].collect()] == [("w", [0.5, 1.0])]
    (tmp_path / "e.json").write_text(json.dumps({"synsets": [{"id": "s", "properties": ["a"]}]}))
    assert tables.load_enrichment(spark, str(tmp_path / "e.json")).count() == 1
    (tmp_path / "more").mkdir()
    for name, text_ in (("b.json", "second"), ("a.json", "first " * 4000)):  # the larger file would come first by size
        (tmp_path / "more" / name).write_text(json.dumps({"results": [{"id": "t", "properties": [text_.split()[0]], "usage_example": text_}]}))
    docs = tables.load_enrichment(spark, str(tmp_path / "more"), str(tmp_path / "e.json"))
    assert [r.properties[0] for r in docs.orderBy("doc_no").collect()] == ["first", "second", "a"]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="bad.json"):
        tables.load_enrichment(spark, str(tmp_path / "more"), str(tmp_path / "bad.json"))
    sinks.write_table(spark.range(3), str(tmp_path / "t"))
    sinks.write_table(spark.range(2), str(tmp_path / "t"))
    sinks.write_jsonl(spark.range(2), str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError, match="missing tables: nope"):
        sinks.require_tables(spark, ["nope"])


def test_frequencies(spark):
    lemmas = spark.createDataFrame([("ice-cream",), ("dog",), ("zzz",)], "lemma string")
    fam = spark.createDataFrame([("ice cream", 6.0, 1, None), ("dog", 3.0, 1, 5.0)], "word string, familiarity double, familiarity_dominant int, zipf double")
    freq = frequency.build_frequencies(lemmas, fam)
    assert {r.lemma: (r.rarity, r.source) for r in freq.collect()} == {"ice-cream": ("common", "brysbaert"), "dog": ("rare", "brysbaert"), "zzz": ("unusual", None)}
    sub = spark.createDataFrame([("zzz", 1.0, 3), ("dog", 6.0, 9)], "word string, zipf double, frequency long")
    assert {r.lemma: (r.rarity, r.source, r.zipf) for r in frequency.backfill_frequency(freq, sub).collect()} == {"ice-cream": ("common", "brysbaert", None), "dog": ("rare", "brysbaert+subtlex", 6.0), "zzz": ("rare", "subtlex", 1.0)}


def test_regression(spark):
    train = spark.createDataFrame([("a", [0.0, 0.0], 1.0), ("b", [2.0, 0.0], 5.0)], "id string, embedding array<float>, score double")
    ask = spark.createDataFrame([("q", [0.0, 0.0]), ("r", [1.0, 0.0])], "id string, embedding array<float>")
    assert {r.id: r.prediction for r in similarity.knn_regress(train, ask).collect()} == {"q": 1.0, "r": 3.0}
    filled = concreteness.fill_concreteness(ask.withColumnRenamed("id", "synset_id").union(train.select("id", "embedding")), train.select(F.col("id").alias("synset_id"), "score", F.lit("brysbaert").alias("source")))
    kept, counts = concreteness.revert_predictions(filled)
    assert filled.count() == 4 and kept.count() == 2 and tuple(counts.first()) == (2, 2)


def test_ridge_from_sums_of_folds(spark):
    rng = np.random.default_rng(8)
    x, fold = rng.normal(size=(400, 6)), rng.integers(0, 5, 400)
    y = x @ rng.normal(size=6) + 3 + 0.5 * rng.normal(size=400)
    rows = spark.createDataFrame([([float(v) for v in a], float(b), int(f)) for a, b, f in zip(x, y, fold, strict=True)], "embedding array<double>, label double, fold int").repartition(4)
    alphas = (0.01, 1.0, 30.0, 3000.0)
    alpha, weights, intercept = concreteness.ridge(concreteness.fold_sums(rows), alphas)

    def fit(a, b, penalty):  # by the augmented system of centred rows
        m, c = a.mean(axis=0), b.mean()
        w = np.linalg.lstsq(np.vstack([a - m, np.eye(6) * penalty**0.5]), np.append(b - c, np.zeros(6)), rcond=None)[0]
        return w, c - m @ w

    def error(penalty):
        found = []
        for f in range(5):
            w, c = fit(x[fold != f], y[fold != f], penalty)
            found.append(np.sqrt(np.mean((y[fold == f] - x[fold == f] @ w - c) ** 2)))
        return np.mean(found)

    assert alpha == min(alphas, key=error)
    w, c = fit(x, y, alpha)
    assert np.allclose(weights, w, atol=1e-6) and intercept == pytest.approx(c, abs=1e-6)
    got = concreteness.predicted(rows, weights, intercept).toPandas()
    assert np.allclose(sorted(got["prediction"]), sorted(x @ w + c), atol=1e-6)


def test_model_shootout(spark):
    import random

    draw = random.Random(0)
    rows = []
    for k in range(120):
        x = [draw.gauss(0, 1) * scale for scale in (1.0, 10.0, 0.1)]
        rows.append((f"s{k}", x, 3 + 0.5 * x[0] - 0.02 * x[1] + draw.gauss(0, 0.05), "brysbaert"))
    training = spark.createDataFrame(rows, "synset_id string, embedding array<double>, score double, source string")
    out = {r.model: r for r in concreteness.model_shootout(training, alphas=(5.0,), trees=(5,), depths=(4,), ks=(3, 5)).collect()}
    # the same split and the ridge solution by hand, with a free intercept and a penalty on the raw weights
    import numpy as np

    split = {r.synset_id: r.d for r in training.select("synset_id", F.pmod(F.xxhash64("synset_id", F.lit(42)), F.lit(100)).alias("d")).collect()}
    part = lambda test: [r for r in rows if (split[r[0]] >= 80) == test]
    x, y = np.array([r[1] for r in part(False)]), np.array([r[2] for r in part(False)])
    w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 5.0 * np.eye(3), (x - x.mean(0)).T @ (y - y.mean()))
    tx, ty = np.array([r[1] for r in part(True)]), np.array([r[2] for r in part(True)])
    rmse = float(np.sqrt(np.mean((ty - (tx - x.mean(0)) @ w - y.mean()) ** 2)))
    assert out["ridge"].rmse == pytest.approx(rmse, abs=1e-4) and out["ridge"].train_samples == len(y)
    assert set(out) == {"ridge", "random_forest", "knn"} and out["ridge"].pearson_r > 0.95
    with pytest.raises(ValueError, match="at least 50"):
        concreteness.model_shootout(training.limit(20))


def test_graphs(spark):
    rel = spark.createDataFrame([("w", "a", "1", "synonym"), ("w", "a", "1", "hypernym"), ("w", "b", "2", "similar"), ("a", "c", "3", "synonym"), ("a", "b", "2", "synonym"), ("a", "w", "1", "synonym")], "word string, node_id string, synset_id string, relation_type string")
    nodes, links = thesaurus.word_graph(rel.filter("word = 'w'"))
    assert {(r.node_id, r.relation_type) for r in nodes.collect()} == {("w", "central"), ("a", "synonym"), ("b", "similar")}
    n2, l2 = thesaurus.expand_graph(nodes, links, spark.createDataFrame([("w", "a")], "word string, selected string"), rel)
    assert {r.node_id for r in n2.filter("node_order = 2").collect()} == {"c"} and l2.count() == links.count() + 3
    n3, l3 = thesaurus.strip_second_order(n2, l2)
    assert n3.count() == 3 and l3.filter("target = 'c'").count() == 0


def test_quality_gates(spark):
    df = spark.createDataFrame([("n", 0.5), ("x", 0.5), (None, 2.0)], "pos string, v double")
    good, bad = sinks.validate_rows(df, {"pos": F.col("pos").isin("n", "v"), "v": F.col("v").between(0, 1)})
    assert good.count() == 1 and sorted(tuple(r.broken) for r in bad.collect()) == [("pos",), ("v",)]
