"""Every stage of the pipeline against a plain version of it on real rows, each on what the stage before it kept; long texts."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from lexispark.llm import decontaminate, exact_dedup, quality, queries, toxicity, warc

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, rows in, rows out)] with rows as dictionaries by id."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, str(DATA)).write.parquet(path)
        kept = spark.read.parquet(path)
        out.append((name, {r.doc_id: r.asDict() for r in docs.collect()}, {r.doc_id: r.asDict() for r in kept.collect()}))
        assert kept.count() == len(out[-1][2])
        docs = kept
    return out


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_toxicity_stage(spark, stages):
    _, before, after = stages[0]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = dict(zip(before, model.scores([r["text"] for r in before.values()]), strict=True))
    assert after == {k: r for k, r in before.items() if scores[k] < 0.7} and len(after) < len(before)


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    sets = {}
    for k, r in before.items():
        words = SPACE.findall(low(r["text"]))
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    group = {k: k for k in before}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    ids = sorted(before)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low_, high = sorted((find(a), find(b)))
                group[high] = low_
    assert after == {k: r for k, r in before.items() if find(k) == k} and len(after) < len(before)


def test_benchmark_stage(spark, stages):
    _, before, after = stages[2]
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        words = decontaminate.WORD.findall(low(r.text))
        m = min(10, len(words))
        windows[m] |= {tuple(words[i : i + m]) for i in range(len(words) - m + 1)} if m else set()

    def clean(text):
        words = decontaminate.WORD.findall(low(text))
        return not any(tuple(words[i : i + m]) in w for m, w in windows.items() for i in range(len(words) - m + 1))

    assert after == {k: r for k, r in before.items() if clean(r["text"])} and len(after) < len(before)


def test_mixing_stage(spark, stages):
    _, before, after = stages[3]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(list(before.values())).toPandas())
    rows = con.execute(queries.mixing_sql(temperature=corpus_pipeline.TEMPERATURE, budget=corpus_pipeline.BUDGET)).fetchdf()
    assert after == {k: before[k] for k in rows[rows["sampled"]]["doc_id"].tolist()} and 0 < len(after) < len(before)


def test_sharding_stage(stages):
    _, before, after = stages[4]
    sizes = {k: len((r["text"] or "").encode()) + 1 for k, r in before.items()}
    assert {k: r["size"] for k, r in after.items()} == sizes
    assert all(r["text_crc32"] == zlib.crc32((before[k]["text"] or "").encode()) for k, r in after.items())
    held = defaultdict(list)
    for r in after.values():
        held[r["shard"]].append(r)
    total = [sum(r["size"] for r in held[s]) for s in range(corpus_pipeline.SHARDS)]
    assert sorted(held) == list(range(corpus_pipeline.SHARDS)) and max(total) - min(total) <= 2 * max(sizes.values())
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in held.values())


LONG = "the quick evening river walks slowly, " * 40_000  # over 1 MiB


def test_long_texts(spark):
    assert len(LONG) > 1 << 20
    pages = spark.createDataFrame([(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, "http://a/3", LONG + "x")], "page_id long, url string, html string")
    out = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert [(k, r.record_type, r.refers_to, r.payload_bytes) for k, r in sorted(out.items())] == [(1, "revisit", 2, len(LONG)), (2, "response", None, len(LONG)), (3, "response", None, len(LONG) + 1)]
    assert out[1].payload_digest == hashlib.sha1(LONG.encode()).hexdigest()
    docs = spark.createDataFrame([(1, LONG), (2, LONG.upper()), (3, LONG + "y")], "doc_id long, text string")
    kept = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    assert kept[1] == kept[2] == (2, 2, hashlib.sha256(LONG.encode()).hexdigest()) and kept[3][:2] == (3, 1)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == 3 and all(0 <= r.score <= 1 for r in scored)
    bench = spark.createDataFrame([(5, "river walks slowly the quick evening river walks slowly the")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination_report(decontaminate.find_benchmark(docs, bench)).collect()}
    # occurrences begin at words 3, 9, ... 239,985; the third text has one more word
    assert {k: (r.n_words, r.n_hit) for k, r in found.items()} == {1: (240_000, 239_992), 2: (240_000, 239_992), 3: (240_001, 239_992)}
