"""Every operator on rows with nulls, empty and long texts, ties, repeats, no rows, and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexispark.llm import decontaminate, exact_dedup, language, mixing, ngram_join, quality, sharding, suffix_dedup, toxicity, warc
from lexispark.llm.shingles import Hashing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, key long, shard int, tokens long, items int, kept string"
LONG = "word%d and another of the kind. " * 4000
BASE = " ".join(f"w{k}" for k in range(60))


def rows():
    texts = [None, "", " \t\n", "one", BASE, BASE, BASE.upper(), BASE + " extra", LONG, "é" * 80, "42 ???", "\x00\x01", "a b c d e f g h i j k l", "你好 мир text"]
    out = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if k % 2 else k, 0.5, "h", k, 1, 7, 3, "x") for k, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, BASE, "en", "s", 1, 0.1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None), (2**60 + 1, BASE, "fr", "t", 1, 0.1, "", 1, 1, 1, 1, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(14)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20, 35))), (2, "one"), (3, None), (None, "zzz yyy"), (1, "one")], "item_id long, text string")


N = len(rows())


def test_exact_dedup(docs, none):
    assert exact_dedup.exact_dedup(none).count() == 0
    out = exact_dedup.exact_dedup(docs).collect()
    same = [r for r in out if r.group_size > 1 and r.keep_id == 2**60 + 1]
    assert len(out) == N and len(same) == 7 and sum(r.kept for r in same) == 1
    assert {r.keep_id for r in out if r.doc_id in (0, 1)} == {1} and sum(r.kept for r in out if r.doc_id == 4) == 0


def test_exact_dedup_compares_texts_behind_colliding_digests(docs):
    key = lambda df: sorted(map(str, df.collect()))
    weak = exact_dedup.exact_dedup(docs, digest=lambda t: F.lit("same"))
    assert key(weak) == key(exact_dedup.exact_dedup(docs))


def test_sharding(docs, none):
    assert sharding.kd_shards(none, n_shards=8).count() == 0
    out = sharding.kd_shards(docs, n_shards=5).collect()
    assert len(out) == N and {r.shard for r in out} <= set(range(5))
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.kd_shards(docs, target_bytes=10**9).agg(F.max("shard")).first()[0] == 0


def test_sharding_splits_equal_metadata(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sizes = [r["count"] for r in sharding.kd_shards(same, n_shards=8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2


def test_mixing(docs, none):
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0
    out = mixing.mix(docs).collect()
    assert len(out) == N and all(0 <= r.rate <= 1 for r in out) and all(r.sampled for r in out if r.n_tokens == 0 and r.rate == 1)
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.sampled for r in out)


def test_raking_meets_the_margins(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), "en" if k % 3 else "de", f"s{k % 4}") for k in range(400)], "doc_id long, text string, lang string, source string")
    want = spark.createDataFrame([("lang", "en", 0.5), ("lang", "de", 0.5), *[("source", f"s{k}", 0.25) for k in range(4)], ("topic", "prose", 1.0)], "margin string, value string, share double")
    cells = docs.select(*[c.alias(k) for k, c in mixing.cell_columns(docs).items()], mixing.token_count(docs["text"]).alias("tokens")).groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens"))
    raked = mixing.rake(cells, want)
    for m in ("lang", "source"):
        for r in raked.groupBy(m).agg(F.sum("weight").alias("w")).collect():
            assert abs(r.w - (0.5 if m == "lang" else 0.25)) < 1e-6


def test_decontamination(docs, none, bench, spark):
    assert decontaminate.find_benchmark(none, bench).count() == 0
    empty = spark.createDataFrame([], bench.schema)
    assert decontaminate.decontaminate(docs, empty).count() == N
    found = {(r.doc_id, r.n_words): r for r in decontaminate.contamination_report(decontaminate.find_benchmark(docs, bench)).collect()}
    assert found[(4, 60)].n_hit == 15 and found[(3, 1)].n_hit == 1 and found[(0, 0)].n_hit == 0
    one_block = sorted(map(str, found.values()))
    many = decontaminate.contamination_report(decontaminate.find_benchmark(docs, bench, block_bytes=20))
    assert sorted({str(r) for r in many.collect()}) == sorted(set(one_block))
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} >= {0, 1, 2, 8, 9}


def test_wu_manber_finds_what_a_plain_search_finds():
    import random

    draw = random.Random(5)
    for _ in range(300):
        m = draw.randint(1, 4)
        patterns = {tuple(draw.choices("abc", k=m)): {"i"} for _ in range(draw.randint(1, 5))}
        words = draw.choices("abcd", k=30)
        got = [at for at, _ in decontaminate.WuManber(patterns, m).search(words)]
        assert got == [k for k in range(len(words) - m + 1) if tuple(words[k : k + m]) in patterns]


def test_ngram_join(docs, none):
    assert ngram_join.jaccard_components(none).count() == 0
    out = ngram_join.jaccard_components(docs).collect()
    assert len(out) == N
    assert {r.component_id for r in out if r.doc_id in (4, 5, 6, 7, 2**60 + 1)} == {4}
    assert all(r.component_id == r.doc_id for r in out if r.n_shingles == 0 or r.doc_id is None)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 8, 9, 10, 11, 12, 13]


def jaccard_brute(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = [x if c == y else c for c in comp]
    return comp


def test_ngram_join_against_brute_force(spark):
    import random

    draw = random.Random(3)
    texts = []
    for _ in range(12):  # families of near and less near copies, some larger than a short list
        base = [f"v{draw.randint(0, 400)}" for _ in range(draw.randint(4, 70))]
        for _ in range(draw.choice([1, 3, 14])):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = f"n{draw.randint(0, 9)}"
            texts.append(" ".join(copy))
    got = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(jaccard_brute(texts)))


def test_ngram_join_never_pairs_members_of_one_component(spark):
    # 30 lists of one component of 20,000 members and an outsider: a self-join would try 12 billion pairs
    lists = spark.range(20_000).selectExpr("id AS key", "explode(sequence(1L, 30L)) AS token", "100L AS n", "token - 1 AS pos", "0L AS component")
    outsider = spark.range(20_000, 20_001).selectExpr("id AS key", "explode(array(7L, 9L)) AS token", "100L AS n", "token - 1 AS pos", "id AS component")
    got = ngram_join.across(ngram_join.mixed_lists(lists.union(outsider), 0)).collect()
    assert {r.b for r in got} == {20_000} and sorted(r.a for r in got) == list(range(20_000))


def test_ngram_join_pairs_components_as_a_plain_search_does(spark):
    import random

    draw = random.Random(5)
    sets = {k: (draw.randint(0, 9) if k % 3 else k, draw.randint(60, 120), sorted(draw.sample(range(40), 12))) for k in range(20, 120)}
    rows_ = [(k, t if t % 2 else t + 1000, n, pos, c) for k, (c, n, ts) in sets.items() for pos, t in enumerate(sorted(ts, key=lambda t: (t % 2 == 0, t)))]
    places = {k: {t: pos for key, t, _, pos, _ in rows_ if key == k} for k in sets}
    want = set()
    for a in sets:
        for b in sets:
            both = sorted(set(places[a]) & set(places[b]))
            if a < b and sets[a][0] != sets[b][0] and both and ngram_join.possible(sets[a][1], sets[b][1], places[a][both[0]], places[b][both[0]]):
                want.add((a, b))
    got = ngram_join.across(ngram_join.mixed_lists(spark.createDataFrame(rows_, "key long, token long, n long, pos long, component long"), 1000)).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_ngram_join_deals_a_large_group_to_many_tasks(spark):
    # 300 near copies share all but the last words, so all their prefixes are lists of the whole group
    texts = [(k, " ".join([f"w{j}" for j in range(60)] + [f"x{k}", f"y{k}"])) for k in range(300)]
    docs = spark.createDataFrame(texts, "_id long, text string").selectExpr("_id", "CAST(text AS BINARY) AS text").repartition(2)
    hashing = Hashing(5)
    table, step = ngram_join.shingle_counts(docs, 2, hashing)
    packed = ngram_join.prefixes(docs, table, ngram_join.heavy_from(step), 16, hashing).toPandas()
    entries = packed["pos"].map(len).groupby(packed["frag"]).sum() // 4
    assert len(entries) >= 12 and entries.max() < 0.2 * entries.sum()
    out = ngram_join.jaccard_components(docs, "_id").collect()
    assert len(out) == 300 and {r.component_id for r in out} == {0}


def removal_brute(rows_):
    seen, out = set(), {}
    for k, t in sorted(rows_):
        b = t.encode()
        mark = [False] * len(b)
        for j in range(len(b) - 49):
            if b[j : j + 50] in seen:
                mark[j : j + 50] = [True] * 50
        seen |= {b[j : j + 50] for j in range(len(b) - 49)}
        out[k] = bytes(c for c, m in zip(b, mark, strict=True) if not m)
    return out


def test_suffix_dedup(docs, none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    out = suffix_dedup.remove_repeats(docs).collect()
    assert len(out) == N and all(bytes(r.kept) == b"" for r in out if r.doc_id in (5, 2**60 + 1))
    assert all(len(r.kept) == r.n_bytes for r in out if r.doc_id in (None, 4, 8, 9))


def test_suffix_dedup_against_brute_force(spark):
    import random

    draw = random.Random(11)
    passages = ["".join(draw.choices("ab c", k=draw.randint(45, 130))) for _ in range(8)] + ["x" * 120, "é" * 60]
    texts = []
    for _ in range(60):
        texts.append("".join(draw.choice(passages)[draw.randint(0, 9) :] if draw.random() < 0.5 else "".join(draw.choices("abcdefgh ", k=draw.randint(1, 90))) for _ in range(draw.randint(0, 5))))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == removal_brute(list(enumerate(texts)))


def test_suffix_array():
    import random

    from lexispark.llm.suffix_array import suffix_array

    draw = random.Random(1)
    for _ in range(2000):
        s = [draw.randint(0, draw.choice([1, 2, 6])) for _ in range(draw.randint(0, 25))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_toxicity(docs, none, labels, spark):
    no_labels = spark.createDataFrame([], labels.schema)
    assert {r.score < 0.7 for r in toxicity.score(docs, toxicity.fit(docs, no_labels)).collect()} == {True}
    model = toxicity.fit(docs, labels)
    assert toxicity.score(none, model).count() == 0
    out = toxicity.score(docs, model)
    assert set(out.columns) == set(docs.columns) and out.count() == N and out.filter("score between 0 and 1").count() == N
    kept = toxicity.reject_toxic(docs, model, 2.0)
    assert kept.columns == docs.columns and kept.count() == N and kept.filter(F.col("doc_id") == 2**60 + 1).count() == 1


def test_toxicity_learns_marked_words(spark):
    texts = [(k, f"some plain words number {k} here" + (" you moron" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.filter("doc_id < 100").select("doc_id", "toxic"))
    wrong = toxicity.score(docs.filter("doc_id >= 100"), model).filter((F.col("score") >= 0.7).cast("int") != F.col("toxic")).count()
    assert wrong == 0


def test_quality(docs, none, labels, spark):
    no_labels = spark.createDataFrame([], labels.schema)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, no_labels).collect()} == {0.5}
    out = quality.quality_scores(docs, labels)
    assert out.count() == N and out.filter("score between 0 and 1").count() == N


def test_isotonic_pooling():
    import numpy as np

    assert quality.pool(np.array([1.0, 3, 2, 2, 5]), np.ones(5)).tolist() == [1, *[pytest.approx(7 / 3)] * 3, 5]


def test_language(docs, none, spark):
    nothing = language.fit(none)
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    out = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert len(out) == len({r[0] for r in rows()}) and all(out[k].lang_pred == "und" for k in (0, 1, 2, 10, 11)) and out[4].lang_pred in ("en", "fr")


def test_language_labels_spans(spark):
    en, de = "the house and the garden with water", "das haus und der garten mit wasser"
    train = spark.createDataFrame([(k, " ".join([en, de][k % 2].split()[:: 1 if k % 3 else -1]), ["en", "de"][k % 2]) for k in range(40)], "doc_id long, text string, lang string")
    model = language.fit(train)
    (spans,) = model.spans([f"{en} {en} {de} {de}"])
    assert [s[2] for s in spans] == ["en", "de"] and spans[0][1] == 14


def test_language_keeps_small_languages_beside_a_large_one(spark):
    import random

    draw = random.Random(2)
    large = [(k, " ".join("b" + "".join(draw.choices("aeiou", k=2)) + "k" for _ in range(60)), "xx") for k in range(400)]
    small = [(1000, "\u03b1\u03b2\u03b3 \u03b4\u03b5\u03b6 \u03b7\u03b8\u03b9", "el"), (1001, "wyz wyz zyw", "yy")]
    docs = spark.createDataFrame(large * 3 + small, "doc_id long, text string, lang string")
    model = language.fit(docs, per_lang=50)
    assert model.langs == ["el", "xx", "yy"]
    out = language.identify(docs.filter("doc_id >= 1000"), model).collect()
    assert {r.lang_pred for r in out if r.lang == "el"} == {"el"} and {r.lang_pred for r in out if r.lang == "yy"} == {"yy"}


def test_language_model_of_many_languages_keeps_each(spark):
    name = [f"q{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)]
    rows_ = [(k * 30 + j, f"{name[k]} {name[k]}{'xyz'[j % 3]} zz", f"l{k}") for k in range(120) for j in range(30)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    model = language.fit(docs, max_docs=100)  # 20 each all the same
    assert len(model.langs) == 120 and set(name) <= set(model.words)
    assert language.identify(docs, model).filter("lang_pred = lang").count() > 3500


def plain_viterbi(s, penalty):
    import numpy as np

    value, back = s[0].astype(float), []
    for t in range(1, len(s)):
        top = int(value.argmax())
        back.append(np.where(value < value[top] - penalty, top, np.arange(s.shape[1])))
        value = np.maximum(value, value[top] - penalty) + s[t]
    return value.max()


def test_best_path_against_plain_viterbi():
    import numpy as np

    draw = np.random.default_rng(0)
    cases = [(draw.normal(0, 2, (12, 3)), 3.0) for _ in range(100)]
    for _ in range(600):  # scores from 0 to FLOOR, half of the texts change language in the middle
        n, langs = int(draw.integers(2, 40)), int(draw.integers(2, 5))
        s = np.maximum(draw.normal(-3, 3, (n, langs)), language.FLOOR).clip(max=0)
        if draw.random() < 0.5:
            x, y = draw.choice(langs, 2, replace=False)
            s[: n // 2, x], s[n // 2 :, x], s[: n // 2, y], s[n // 2 :, y] = 0, language.FLOOR, language.FLOOR, 0
        cases.append((s, language.PENALTY))
    a, b, c = [0] * 4 + [-6] * 4, [-6] * 4 + [0] * 4, [-2] * 8  # two halves, and a third language in between
    cases.append((np.array([a, b, c]).T, 12.0))
    for s, penalty in cases:
        s = s.astype(np.float32)
        got = language.best_path(s, penalty)
        mine = sum(float(s[t, got[t]]) for t in range(len(s))) - penalty * np.count_nonzero(np.diff(got))
        assert mine == pytest.approx(plain_viterbi(s, penalty), abs=1e-4)


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 300
    pages = [(1, "http://a/ b", big), (2, "http://c", big), (3, None, big + "!"), (4, "u", None), (5, "u", ""), (6, "u", "s"), (7, "u", "s"), (None, "u", big), (2, "http://c", big), (2**60 + 1, "u", "z")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, file int").repartition(3)
    out = warc.archive_pages(df).collect()
    assert len(out) == len(pages) and 2**60 + 1 in {r.page_id for r in out}
    by = {r.page_id: r for r in out if r.page_id not in (2, None)}
    assert (by[1].record_type, by[1].refers_to, by[1].payload, by[1].payload_bytes) == ("revisit", 2, None, len(big.encode()))
    assert bytes(by[3].payload).decode() == big + "!" and by[4].payload_bytes == 0 and by[6].record_type == by[7].record_type == "response"
    assert all(r.record_type == "response" for r in out if r.page_id in (2, None))
    index = warc.write_archives(warc.classify(df))
    some = warc.read_records(index.filter("record_id = '3'")).collect()
    assert len(some) == 1 and bytes(some[0].payload).decode() == big + "!"
    assert warc.archive_pages(df.filter("page_id < 0")).count() == 0


def test_ranges_are_coalesced():
    runs = list(warc.coalesced([(0, 10), (10, 5), (20, 5), (200_000, 5)]))
    assert runs == [(0, 3, 0, 25), (3, 4, 200_000, 200_005)]


def test_pipeline_stages(spark, docs, none, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{'some' if start is docs else 'none'}-{name.replace(' ', '-')}")
            if stage is not corpus_pipeline.shard:
                assert out.columns == docs.columns
                now = spark.read.parquet(f"{tmp_path}/{'some' if start is docs else 'none'}-{name.replace(' ', '-')}")
