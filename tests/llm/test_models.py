"""Operators that SQL cannot express against plain versions of themselves, and texts longer than a piece."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import language, quality, sharding, shingles, suffix_dedup, toxicity


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(8)
    plain = ["river", "stone", "walks", "slowly", "evening", "paper", "garden", "before", "house", "window"]
    rude = ["moron", "idiot", "scum"]
    rows = []
    for k in range(160):
        toxic = int(k % 3 == 0)
        words = draw.choices(plain, k=draw.randint(5, 40)) + (draw.choices(rude, k=3) if toxic else [])
        draw.shuffle(words)
        rows.append((k, " ".join(words) + ("." if k % 2 else "!!!???" * 5), toxic, int(k % 2)))
    return rows


def test_toxicity_against_a_dense_fit(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int, quality int")
    known = texts[:100]
    model = toxicity.fit(docs, docs.filter("doc_id < 100").select("doc_id", "toxic"), l2=1e-3, steps=400)
    distinct = toxicity.Distinct()
    used = sorted({int(b) for r in known for b in distinct(r[1])})
    place = {b: k for k, b in enumerate(used)}
    x = np.zeros((len(known), len(used)))
    for i, r in enumerate(known):
        x[i, [place[int(b)] for b in distinct(r[1])]] = 1
    y = np.array([r[2] for r in known], dtype=float)
    one, none = x[y == 1].sum(0), x[y == 0].sum(0)
    ratio = np.log((one + 1) / (y.sum() + 2)) - np.log((none + 1) / ((1 - y).sum() + 2))
    z = x * ratio * toxicity.UNIT
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def loss(w, b):
        s = z @ w + b
        return float(np.sum(weight * (np.logaddexp(0, s) - y * s)) + 1e-3 / 2 * w @ w)

    w, b = np.zeros(len(used)), 0.0
    rate = 1 / (0.25 * np.linalg.norm(z.T @ (weight[:, None] * z), 2) + 0.3)
    for _ in range(20_000):
        g = weight * (1 / (1 + np.exp(-(z @ w + b))) - y)
        w, b = w - rate * (z.T @ g + 1e-3 * w), b - rate * g.sum()
    own = model.weights[used] / np.where(ratio == 0, 1, ratio * toxicity.UNIT)
    assert loss(own, model.bias) < loss(w, b) + 2e-3
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    margin = {r[0]: sum(float(model.weights[int(c)]) for c in distinct(r[1])) + model.bias for r in texts}
    assert len(model.knots) == len(known) and all(got[k] == pytest.approx(float(model.calibrated(np.array([m]))[0]), abs=1e-6) for k, m in margin.items())
    assert sum((got[r[0]] >= 0.7) != bool(r[2]) for r in texts[100:]) <= 2  # at this strong a penalty


def test_quality_against_a_dense_fit(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int, quality int").repartition(5)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, docs.filter("doc_id < 100").select("doc_id", "quality"), ridge=1e-2, features=24).collect()}
    stats = np.array([quality.statistics(r[1]) for r in texts])
    rng = np.random.default_rng(quality.SEED)
    omega, phase = rng.normal(0, 1 / 2.5, (stats.shape[1], 24)), rng.uniform(0, 2 * np.pi, 24)
    x = np.clip((stats - stats.mean(0)) / np.maximum(stats.std(0), 1e-6), -6, 6)
    z = np.hstack([np.sqrt(2 / 24) * np.cos(x @ omega + phase), np.ones((len(x), 1))])
    y = np.array([r[3] for r in texts[:100]], dtype=float)
    w = np.linalg.solve(z[:100].T @ z[:100] + 1e-2 * 100 * np.eye(25) / 24, z[:100].T @ y)
    raw = z @ w
    bins = np.floor(np.clip(raw[:100], -0.5, 1.5) * quality.BINS / 2)
    means = sorted((raw[:100][bins == b].mean(), y[bins == b].mean(), float((bins == b).sum())) for b in np.unique(bins))
    level, span = [], []
    for _, v, n in means:  # pool what falls
        level.append([v, n])
        span.append(1)
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            (v1, n1), (v2, n2) = level[-2:]
            level[-2:] = [[(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2]]
            span[-2:] = [span[-2] + span[-1]]
    flat = np.repeat([v for v, _ in level], span)
    want = np.clip(np.interp(raw, [m[0] for m in means], flat), 0, 1)
    assert max(abs(got[r[0]] - want[k]) for k, r in enumerate(texts)) < 1e-6
    assert sum((got[r[0]] >= 0.5) != bool(r[3]) for r in texts[100:]) == 0


def plain_tree(points, first, leaves, dims, out):
    """Shards of ``(row, weight, positions, tie)`` by recursive weighted medians."""
    if leaves == 1 or not points:
        out.update({p[0]: first for p in points})
        return
    wide = [max(p[2][k] for p in points) - min(p[2][k] for p in points) for k in range(dims)]
    dim = wide.index(max(wide))
    want = sum(p[1] for p in points) * (leaves // 2) / leaves
    key = lambda p: (p[2][dim], p[3])
    weights = {}
    for p in points:
        weights[key(p)] = weights.get(key(p), 0) + p[1]
    below, cut = 0.0, None
    for k in sorted(weights):
        cut = k
        if below + weights[k] >= want:
            break
        below += weights[k]
    keep = below + weights[cut] - want <= want - below
    left = [p for p in points if key(p) < cut or (keep and key(p) == cut)]
    chosen = {p[0] for p in left}
    plain_tree(left, first, leaves // 2, dims, out)
    plain_tree([p for p in points if p[0] not in chosen], first + leaves // 2, leaves - leaves // 2, dims, out)


@pytest.mark.parametrize("n_shards", [2, 5, 8])
def test_sharding_against_a_plain_tree(spark, n_shards):
    draw = random.Random(n_shards)
    rows = [(k, "x" * draw.choice([3, 40, 41, 500, draw.randint(0, 3000)]), draw.choice(["en", "de", None]), draw.choice(["web"] * 6 + ["book", "news"])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    top = float((1 << sharding.POSITION_BITS) - 1)
    dims = [F.log2(sharding.text_bytes(F.col("text"))) / 40.0, sharding.categorical(F.col("source")), sharding.categorical(F.col("lang"))]
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("tie")), 64 - sharding.TIE_BITS)
    points = [(r[0], r[1], list(r[3:]), r[2]) for r in docs.select("doc_id", sharding.text_bytes(F.col("text")), tie, *[F.floor(d * top).cast("long").alias(f"d{k}") for k, d in enumerate(dims)]).collect()]
    want: dict = {}
    plain_tree(points, 0, n_shards, 3, want)
    assert {r.doc_id: r.shard for r in sharding.kd_shards(docs, n_shards=n_shards).collect()} == want


def test_suffix_dedup_compares_bytes_where_hashes_agree(spark):
    # the runs of the common anchor agree in 32 bits of their hash, but no 50 bytes are common
    one = "vphuvuygnkexsqr ha kpefbakopdytakyioxsfibbhzqsxhiotbeyfscxrnnwqkgmjvremgtfbmpgyw"
    two = "ittsocdtamgewvjogvqkjjnne mwwytakyioxsfibbhzqsxhiojzrcmivwvkprqvz rqwfyogdbqrrve"
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(1, one), (2, two), (3, two)], "doc_id long, text string")).collect()
    assert {r.doc_id: bytes(r.kept).decode() for r in out} == {1: one, 2: two, 3: ""}


def test_parts_with_one_hash_are_refused():
    import pyarrow as pa

    rows = pa.table({"code": [5, 5], "run": [7, 7], "lo": [1, 2], "hi": [3, 3], "text": [b"a" * 60, b"b" * 60]})
    with pytest.raises(ValueError, match="same 64-bit hash"):
        suffix_dedup.resolve(rows)


def test_many_suffix_arrays_at_once():
    from lexispark.llm.suffix_array import suffix_array, suffix_arrays

    draw = random.Random(6)
    for _ in range(300):
        sets = [[draw.randint(0, draw.choice([0, 1, 4])) for _ in range(draw.randint(1, 20))] for _ in range(draw.randint(1, 7))]
        got = suffix_arrays(np.array(sum(sets, [])), np.array([len(s) for s in sets]))
        at = 0
        for s in sets:
            assert (got[at : at + len(s)] - at).tolist() == suffix_array(s) == sorted(range(len(s)), key=lambda i, s=s: s[i:])
            at += len(s)


def test_suffix_dedup_of_texts_longer_than_a_piece(spark):
    draw = random.Random(3)
    letters = "abcdefghijklmnop "
    long = "".join(draw.choices(letters, k=(1 << 20) + 300_000))
    part = long[(1 << 20) - 30_000 : (1 << 20) + 30_000]  # lies across the end of a piece
    other = "".join(draw.choices(letters, k=1 << 20))
    docs = [(1, long), (2, "#" * 70 + part + other), (3, part)]
    out = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: (len(long), []), 2: (70 + len(part) + len(other), [(70, 70 + len(part))]), 3: (len(part), [(0, len(part))])}


def test_toxicity_scores_are_calibrated_on_unseen_rows():
    rng = np.random.default_rng(4)
    y, own = np.arange(240) % 4 == 0, rng.integers(1000, 1 << 18, size=(240, 20))
    texts = [np.concatenate([own[k], [7] if y[k] and k % 20 else [], [9] if k % 3 else []]).astype(np.uint32) for k in range(240)]  # bucket 7 tells four of five
    rows = pa.table({"y": pa.array(y.astype(np.int32)), "fold": pa.array((np.arange(240) // 4 % 3).astype(np.int32)), "b": pa.array([t.tobytes() for t in texts], type=pa.binary())})
    knots, levels = toxicity.calibration(rows, 1.0, 1e-5)
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all() and 0 <= levels[0] and levels[-1] == 1
    model = toxicity.solve(rows, 1.0, 1e-5, 100)
    model.knots, model.levels = knots, levels
    margins = np.array([model.weights[t].sum() for t in texts]) + model.bias
    scores = model.calibrated(margins)
    assert (np.diff(scores[np.argsort(margins)]) > -1e-12).all() and scores.min() >= 0 and scores.max() <= 1
    told = y & (np.arange(240) % 20 != 0)
    assert (scores[told] >= 0.7).all() and (scores[~y] < 0.7).all()
    few = toxicity.calibration(rows.slice(0, 8), 1.0, 1e-5)
    assert len(few[0]) == 0


def test_features_of_texts_longer_than_a_piece(monkeypatch):
    text = "".join(random.Random(1).choices("abc defgh", k=5000))
    whole = sorted(toxicity.Distinct()(text).tolist())
    monkeypatch.setattr(toxicity, "PIECE", 700)
    assert sorted(toxicity.Distinct()(text).tolist()) == whole
    words = " ".join(f"w{k % 700}" for k in range(400_000)).encode()  # over 1 MiB
    assert len(words) > shingles.CHUNK
    alone, with_others = next(shingles.Hashing(7).sets([words])), list(shingles.Hashing(7).sets([b"a b", words, b"c"]))[1]
    assert len(alone) == 700 and (alone == with_others).all()


def test_language_of_texts_longer_than_a_batch(spark):
    train = spark.createDataFrame([(k, ["the house and garden", "das haus und garten"][k % 2], ["en", "de"][k % 2]) for k in range(20)], "doc_id long, text string, lang string")
    model = language.fit(train)
    long = "the house and garden " * 60_000 + "das haus und garten " * 60_000
    (short, spans) = model.spans(["das haus", long])
    assert len(long) > 1 << 21 and [s[2] for s in short] == ["de"]
    assert [s[2] for s in spans] == ["en", "de"] and spans[0][1] == 240_000
