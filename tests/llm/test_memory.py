"""Memory of one task's table of counts and of the driver while it fits."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lexispark.llm import ngram_join, toxicity


def test_counts_in_bytes(monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD", 1000)
    rng = np.random.default_rng(2)
    at = np.concatenate([rng.integers(0, 4096, 5000), np.full(70_000, 77), np.full(256, 78), np.full(255, 79)]).astype(np.uint64)
    rng.shuffle(at)
    table = ngram_join.Counts(4096)
    for part in np.array_split(at, 37):
        table.add(part)
    assert np.concatenate(list(table.parts(16))).tolist() == np.bincount(at.astype(np.int64), minlength=4096).tolist()


def test_a_task_counts_in_little_more_than_a_byte_a_place():
    tracemalloc.start()
    table = ngram_join.Counts(ngram_join.TABLE)
    for _ in range(40):
        table.add(np.random.default_rng(1).integers(0, ngram_join.TABLE, 50_000).astype(np.uint64))
    sum(int(p.sum()) for p in table.parts(ngram_join.TABLE_SLICES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * ngram_join.TABLE  # four bytes a place before


def test_a_fit_holds_no_wide_copy_of_all_ngrams():
    rng = np.random.default_rng(3)
    texts = [rng.choice(1 << toxicity.BITS, 4000, replace=False).astype(np.uint32).tobytes() for _ in range(1500)]
    rows = pa.table({"y": pa.array([k % 2 for k in range(1500)], type=pa.int32()), "b": pa.array(texts, type=pa.binary())})
    tracemalloc.start()
    toxicity.solve(rows, 1.0, 1e-5, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * 4000 * 8  # 48 MB of 8-byte numbers before, beside the working memory
