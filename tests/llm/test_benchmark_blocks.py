"""A benchmark of many blocks: one written pass for each, the same rows as in one pass."""

import random

from lexispark.llm import decontaminate


def test_ten_blocks_give_the_rows_of_one(spark, monkeypatch):
    draw = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(draw.choices(words, k=30))) for k in range(60)] + [(60, "w1"), (61, None), (None, "w2 w3")]
    size = sum(len(t or "") for _, t in items)
    texts = [" ".join(draw.choices(words, k=50)) for _ in range(30)] + [f"a b {items[k][1]} c d {items[k + 1][1]}" for k in range(40)] * 2 + [None, "", "w2 w3", "word " * 250_000 + items[5][1]]
    docs = spark.createDataFrame([(k, t, "mine", 3) for k, t in enumerate(texts)], "doc_id long, text string, hits string, extra int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    report = lambda df: sorted(map(str, decontaminate.contamination_report(df).collect()))
    one = report(decontaminate.find_benchmark(docs, bench))

    written, write = [], decontaminate.materialize
    monkeypatch.setattr(decontaminate, "materialize", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    many = decontaminate.find_benchmark(docs, bench, block_bytes=size // 9)
    assert len(written) == 11 and all(p.count("MapInArrow") == 1 for p in written)  # ten blocks and what they give together
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert report(many) == one
    assert sum("contaminated=True" in r for r in one) >= 82
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench, block_bytes=size // 9).collect()) == sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect())
