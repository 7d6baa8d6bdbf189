"""Quality: random Fourier features over document statistics, ridge regression, isotonic calibration.

The statistics of every document are computed once and written; they are some hundred bytes a
row. Each task sums its part of the normal equations over all labelled rows; what meets in the
driver has the size of the feature space, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexispark.functions.lineage import materialize
from lexispark.llm.text import append

FEATURES = 192
BINS = 1024
SEED = 7
STATS = ("log_bytes", "letters", "upper", "digits", "spaces", "lines", "sentence_marks", "other_marks", "non_ascii", "repeated_mark", "word_length", "distinct_words", "distinct_lines", "words_a_line", "marked_words")

_CLASS = np.full(256, 7, dtype=np.uint8)  # other marks
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\f\v", b"\n", b".,;:'\"-", b"!?")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 8


def statistics(text: str | None) -> list[float]:
    """Shares and counts that describe the form of a text; all 0 for null or empty text."""
    if not text:
        return [0.0] * len(STATS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n, kind = len(raw), _CLASS[raw]
    lower, upper, digits, spaces, breaks, marks, stops, others, wide = np.bincount(kind, minlength=9).tolist()
    doubled = int(np.count_nonzero((raw[1:] == raw[:-1]) & (kind[1:] >= 6) & (kind[1:] <= 7)))
    after = int(np.count_nonzero((kind[:-1] >= 6) & (kind[:-1] <= 7) & ((kind[1:] == 3) | (kind[1:] == 4))))
    words, lines = text.split(), text.split("\n")
    n_words = max(1, len(words))
    return [
        np.log1p(n), (lower + upper + wide) / n, upper / n, digits / n, spaces / n, breaks / n, marks / n, (others + stops) / n, wide / n, doubled / n,
        min(40.0, (n - spaces - breaks) / n_words) / 10, len(set(words)) / n_words, len(set(lines)) / len(lines), min(200.0, n_words / len(lines)) / 50, after / n_words,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, stats``, one row per input row, as a written table."""
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("text"))
    return materialize(append(rows, ["text"], "stats array<double>", lambda: lambda texts: [[statistics(t) for t in texts]]).select("_id", "stats"), "statistics")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # calibrated, not falling

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(x @ self.omega + self.phase), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def matrix(rows: Sequence[list[float]]) -> np.ndarray:
    return np.array(list(rows), dtype=np.float64).reshape(-1, len(STATS))


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-falling sequence nearest to ``values`` in weighted squares."""
    out: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        out.append([v, w, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            v2, w2, n2 = out.pop()
            v1, w1, n1 = out.pop()
            out.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in out])


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", features: int = FEATURES, ridge: float = 1e-3, bandwidth: float = 2.5) -> Model:
    """Fit on every labelled row. Rows of a repeated id count as often as they stand in either table."""
    d = len(STATS)
    sums = stats.agg(*[F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(d)], *[F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(d)]).first()
    rng = np.random.default_rng(SEED)
    part = Model(
        np.array([sums[f"m{k}"] or 0.0 for k in range(d)]), np.array([max(sums[f"s{k}"] or 0.0, 1e-6) for k in range(d)]),
        rng.normal(0, 1 / bandwidth, (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]),
    )
    known = labels.filter(labels[label_col].isin(0, 1)).select(labels[id_col].alias("_id"), labels[label_col].cast("double").alias("y"))
    train = materialize(stats.join(known, "_id").select("stats", "y"), "labelled-statistics")
    size = features + 1
    upper = np.triu_indices(size)

    def sums_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, moment, n = np.zeros((size, size)), np.zeros(size), 0
        for b in batches:
            if len(b):
                z = part.features(matrix(b["stats"]))
                gram += z.T @ z
                moment += z.T @ b["y"].to_numpy()
                n += len(b)
        if n:
            flat = np.concatenate([gram[upper], moment, [n]])
            yield pd.DataFrame({"k": np.arange(len(flat)), "v": flat})

    total = train.mapInPandas(sums_of, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    if not len(total):
        return part
    flat = total.sort_values("k")["v"].to_numpy()
    gram = np.zeros((size, size))
    gram[upper] = flat[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    n = flat[-1]
    part.weights = np.linalg.solve(gram + ridge * n * np.eye(size) / features, flat[len(upper[0]) : -1])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                raw = part.raw(matrix(b["stats"]))
                yield pd.DataFrame({"bin": np.floor(np.clip(raw, -0.5, 1.5) * BINS / 2).astype("int64"), "raw": raw, "y": b["y"].to_numpy()})

    bins = train.mapInPandas(binned, "bin long, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("raw")
    part.knots, part.levels = bins["raw"].to_numpy(), pool(bins["y"].to_numpy(), bins["n"].to_numpy(dtype=float))
    return part


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``_id, score`` for the rows of :func:`with_statistics`."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    return append(stats, ["stats"], "score double", lambda: lambda rows: [shared.value.scores(matrix(rows))]).select("_id", "score")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, score`` per row of ``docs``, learned from ``labels`` (id, quality).

    Null and empty texts have statistics of 0 and are scored like any other; null ids are scored and
    never trained on; without labelled rows every score is 0.5. Repeated rows get equal scores, an
    empty table gives an empty result, other columns are ignored.
    """
    stats = with_statistics(docs, id_col, text_col)
    return score(stats, fit(stats, labels, id_col=id_col, **options)).withColumnRenamed("_id", id_col)
