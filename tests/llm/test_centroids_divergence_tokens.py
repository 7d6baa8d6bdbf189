"""Centroid clustering, divergence audit and token counts against brute force, and on odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexispark.llm import centroids, divergence, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- centroids


def plain_clusters(rows, k, rounds, dim, scale=1024, seed=3):
    kept = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((apart(v, c), n) for n, c in enumerate(at))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        at = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(at)]
    out = [(i, near(v)[1], near(v)[0], ",".join(map(str, at[near(v)[1]]))) for i, v in kept]
    own = Counter()
    for _, c, d, _ in out:
        own[c] += d
    return sorted([(i, c, d, own[c], sum(own.values()), t) for i, c, d, t in out], key=str)


def clustered(df, **kw):
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, ",".join(r.centroid)) for r in centroids.cluster_vectors(df, **kw).collect()], key=str)


@pytest.mark.parametrize("dim,k,spread", [(3, 8, 1.0), (2, 40, 0.004), (5, 1, 1.0)])
def test_clusters_as_brute_force(spark, dim, k, spread):
    rng = random.Random(dim)
    rows = [(n, [rng.gauss(0, spread) for _ in range(dim)]) for n in range(300)]  # the small spread makes whole numbers tie
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert clustered(df, k=k, rounds=4, dim=dim) == plain_clusters(rows, k, 4, dim)


def test_clusters_of_odd_rows(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [None, 1.0]), (None, [0.25, 0.0]), (7, [-0.0001, 3.0]), (8, [0.5, 1.0]), (9, [3e30, 1.0]), (10, [])]
    schema = "vec_id long, embedding array<double>, cluster string, extra int"
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], schema)
    want = [(i, c, d if d < 2**63 else None, o if o < 2**63 else None, n if n < 2**63 else None, t) for i, c, d, o, n, t in plain_clusters(rows, 4, 3, 2)]
    assert clustered(df, k=4, rounds=3, dim=2) == want
    out = centroids.cluster_vectors(df, k=4, rounds=3, dim=2)
    assert {r.extra for r in out.collect()} == {7} and dict(out.dtypes)["cluster"] == "int"
    assert clustered(df.limit(0), k=4, rounds=3, dim=2) == [] and clustered(df.filter("vec_id = 2"), dim=2) == []


def test_tree_finds_the_nearest_with_fewer_distances():
    rng = np.random.default_rng(1)
    spots = rng.integers(-3000, 3000, size=(16, 4))
    points = (spots[rng.integers(0, 16, 400)] + rng.integers(-30, 30, size=(400, 4))).tolist()
    tree, vectors = centroids.Tree.over(points), np.array(points[:200]) + 1
    number, distance, taken = tree.nearest(vectors)
    every = ((vectors[:, None, :] - np.array(points)[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert taken < every.size / 3


def test_tree_gives_ties_to_the_smallest_number():
    tree = centroids.Tree.over([[0, 4], [4, 0], [0, -4], [-4, 0], [0, 4], [4, 0], [9, 9]])
    number, distance, _ = tree.nearest(np.array([[0, 0], [1, 1], [4, 0], [9, 8]]))
    assert number.tolist() == [0, 0, 1, 6] and distance.tolist() == [16, 10, 0, 1]


# --- divergence


def plain_audit(rows, top):
    docs = [((lang or ""), (source or ""), divergence.TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))) for text, lang, source in rows]
    groups = sorted({(lang, s) for lang, s, _ in docs})
    out = []
    for lang in sorted({g[0] for g in groups}):
        seen, n, whole = Counter(), defaultdict(Counter), Counter()
        for own, s, terms in docs:
            if own == lang:
                seen.update(set(terms))
                n[s].update(terms)
                whole.update(terms)
        kept = [t for t in whole if seen[t] >= 3]
        smooth = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        q, sources = smooth(whole), [s for own, s in groups if own == lang]
        p = {s: smooth(n[s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def audited(df, **kw):
    return sorted(map(tuple, divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("top", [5, 200])
def test_audit_as_brute_force(spark, top):
    rng = random.Random(top)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Éte", "naïve", "日本", "the"]
    rows = [(" ".join(rng.choices(words, weights=[1 / (k + 1) + (k % 7 == s) for k in range(len(words))], k=40)) + " The", "en" if rng.random() < 0.7 else "fr", f"s{s}") for s in range(5) for _ in range(25)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert audited(df, top=top) == plain_audit(rows, top)


def test_audit_of_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("Only once", "en", "b"), ("x y z", "en", "a"), ("x y", "en", "b"), ("X", "en", None), ("x", "en", "a"), ("x", "en", "a"), ("42 1 ?", "de", "q"), ("t t t", "de", "r"), ("long " * 250_000 + "x", "en", "c"), ("a", "fr", "s"), ("a", "fr", "s"), ("a", "fr", "s")]
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], "text string, lang string, source string, value int, term string")
    assert audited(df) == plain_audit(rows, 200)
    assert audited(df.limit(0)) == []


def test_skyband_holds_every_row_of_the_top():
    rng = np.random.default_rng(2)
    n, total = rng.integers(1, 12, 3000), rng.integers(12, 40, 3000)
    place = rng.permutation(3000)
    for k in (1, 7, 200):
        over = (n[None] >= n[:, None]) & (total[None] <= total[:, None]) & (place[None] < place[:, None])
        assert sorted(divergence.thinned(n, total, place, k)) == np.flatnonzero(over.sum(axis=1) < k).tolist()


# --- token counts


@pytest.fixture(scope="module")
def texts():
    return [(0, None), (1, ""), (2, "Hello  world"), (3, "Hello  world"), (None, "hello\n\n\tWORLD 123's"), (5, "<|endoftext|> inside <|endoftext|>"), (6, "héé 你好 \U0001f600"), (7, "word and more " * 150_000), (8, "a" * 100_000), (8, "a" * 100_000)]


def test_counts_as_the_library(spark, texts, tmp_path):
    df = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, n_tokens string, digest int").repartition(3)
    plain = Tokenizer.from_file(VOCABULARY)
    want = sorted((str(i), len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids), 1) for i, t in texts)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time everything is in the cache
        out = token_counts.count_tokens(df, VOCABULARY, cache)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.digest) for r in out.collect()) == want
    assert token_counts.count_tokens(df.limit(0), VOCABULARY, cache).count() == 0


def test_only_distinct_misses_are_encoded(spark, texts, tmp_path):
    model, cache = open(VOCABULARY, "rb").read(), str(tmp_path / "cache")
    df = spark.createDataFrame(texts, "doc_id long, text string")
    first = df.filter("doc_id < 6")
    missed = lambda docs, m, kind: token_counts.encode_missing(docs, token_counts.keyed(docs, "text").select("digest").distinct(), m, kind, cache)
    assert missed(first, model, "json") == 3  # null and empty are one text
    assert missed(df, model, "json") == 4
    assert missed(df, model, "json") == 0
    pieces = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    assert missed(first, pieces, "model") == 3  # another tokenizer has counts of its own
    assert spark.read.parquet(cache).count() == 10


def test_many_misses_go_another_way(spark, texts, tmp_path, monkeypatch):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    few = sorted(map(str, token_counts.count_tokens(df, VOCABULARY, str(tmp_path / "a")).collect()))
    monkeypatch.setattr(token_counts, "SENT", 0)
    assert sorted(map(str, token_counts.count_tokens(df, VOCABULARY, str(tmp_path / "b")).collect())) == few


def test_counts_by_words_add_up(monkeypatch):
    plain = Tokenizer.from_file(VOCABULARY)
    many = lambda ts: [len(plain.encode(t, add_special_tokens=False)) for t in ts]
    draw, bits = random.Random(9), ["a", "the", " ", "  ", " ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2028", "'s", "'", "don't", "12", "3", ".", ", ", "é", " à", "ñandú", "²", "Ⅷ", "日本", "\u0301", "ſ", "<|endoftext|>", "<|", "|>", "_", "\U0001f600", "-"]
    texts = ["", " ", "a b"] + ["".join(draw.choices(bits, k=draw.randint(1, 40))) for _ in range(3000)] + ["word " * 50_000]
    count = token_counts.by_words(many)
    assert count(texts) == many(texts) and count(texts) == many(texts)
    monkeypatch.setattr(token_counts, "KNOWN", 3)  # what is remembered is dropped all the time
    count = token_counts.by_words(many)
    for k in range(0, 300, 7):
        assert count(texts[k : k + 7]) == many(texts[k : k + 7])


def test_tokenizers_of_other_kinds_take_whole_texts():
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        count = token_counts.counter(open(path, "rb").read(), path.rsplit(".", 1)[1])
        assert count(["Hello  World again", ""])[1] == 0 and count(["a b", "a"]) == [count(["a b"])[0], count(["a"])[0]]
