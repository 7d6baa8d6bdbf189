"""Hashes of the n-gram join: texts made to collide, sets told apart by their second hash, long words."""

import pytest

from lexispark.llm import ngram_join
from lexispark.llm.shingles import Hashing


def thue_morse(n):
    return [bin(k).count("1") & 1 for k in range(n)]


#: Under any polynomial of the letters with an odd base modulo 2^64 the two words are equal; they differ everywhere.
ONE = "".join("mn"[b] for b in thue_morse(1024))
OTHER = "".join("nm"[b] for b in thue_morse(1024))


def components(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, **kw).collect()}


def test_words_made_to_collide_are_different(spark):
    around = "a b c d %s e f g h i"
    rows = [(1, ONE), (2, OTHER), (3, around % ONE), (4, around % OTHER), (5, ONE)]
    assert components(spark, rows) == {1: (1, 1), 2: (1, 2), 3: (6, 3), 4: (6, 4), 5: (1, 1)}


def test_words_hash_as_their_bytes_only():
    hashing = Hashing(11)
    words = [b"", b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefgh\xc3\xa9", b"x" * 255, b"x" * 256, b"x" * 257, b"y" * 3000, ONE.encode(), OTHER.encode()]
    alone = [next(hashing.sets([w])).tolist() for w in words]
    assert [s.tolist() for s in hashing.sets(words)] == alone
    assert len({tuple(a) for a in alone}) == len(words)
    assert alone != [next(Hashing(12).sets([w])).tolist() for w in words]


@pytest.fixture
def weak(monkeypatch):
    monkeypatch.setattr(Hashing, "first", lambda self, tokens: len(tokens) % 3)


def test_sets_with_one_key_are_told_apart(spark, weak):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join([*base, "x"]), "one", "two", " ".join(reversed(base)), "one", "", " ".join(f"v{k}" for k in range(60))]
    found = components(spark, list(enumerate(texts)))
    assert {k: c for k, (_, c) in found.items()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 2, 6: 6, 7: 7}


def test_keep_one_with_one_key_for_all(spark, weak):
    docs = spark.createDataFrame(list(enumerate(["one", "two", "one", "three a b", ""])), "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [0, 1, 3, 4]
