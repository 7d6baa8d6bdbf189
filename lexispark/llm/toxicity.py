"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Fitting reads a bounded sample of labelled rows (``MAX_PER_CLASS`` of each label, those with the
smallest hash of the id). The driver gets their hashed n-grams, computes the log-count ratios and
minimises the regularised logistic loss. Margins of rows that a fit has not seen, from ``FOLDS`` fits
on the others, then say which share of rows at a margin is labelled 1 where both labels are equally
frequent, as in the loss: an isotonic map. Scoring runs over whole texts in map tasks, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexispark.llm.quality import pool
from lexispark.llm.text import append

#: Bound of the sample that the classifier is fitted on, for each of the two labels.
MAX_PER_CLASS = 1200
ORDERS = (4, 5, 6)
BITS = 18
#: Training rows whose n-grams are looked at together; bounds the driver's working memory.
BLOCK = 128
#: Scale of a feature's value, so that margins start near 0.
UNIT = 1 / 30
#: Fits that give margins of unseen rows, their steps, and the share of the plain logistic score in a calibrated one, which keeps scores apart that the map joins.
FOLDS, FOLD_STEPS, PLAIN = 3, 100, 0.02
#: Characters that are hashed at once; longer texts are read in overlapping pieces.
PIECE = 1 << 20


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased text between spaces, piece by piece."""
    if not text:
        return
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(chars), PIECE):
        piece = chars[at : at + PIECE + max(ORDERS) - 1]
        h = piece * np.uint32(0x9E3779B1)
        for n in range(2, max(ORDERS) + 1):
            if len(piece) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + piece[n - 1 :]
            if n in ORDERS:
                mixed = h * np.uint32(0xC2B2AE35)
                yield ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS))[: PIECE]


class Distinct:
    """Distinct buckets of a text, found with a table of marks instead of sorting."""

    def __init__(self) -> None:
        self.marks = np.zeros(1 << BITS, dtype=bool)
        self.last = np.empty(1 << BITS, dtype=np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        found = []
        for b in buckets(text):
            b = b[~self.marks[b]]
            self.marks[b] = True
            found.append(b)
        out = np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)
        if len(out):  # a bucket may stand in one piece more than once
            order = np.arange(len(out), dtype=np.int32)
            self.last[out] = order
            out = out[self.last[out] == order]
            self.marks[out] = False
        return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))  # margins of unseen rows, ascending
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))  # shares of label 1 there, not falling

    def scores(self, texts: list[str | None]) -> np.ndarray:
        distinct = Distinct()
        return self.calibrated(np.array([self.weights[distinct(t)].sum() for t in texts]) + self.bias)

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        plain = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
        return PLAIN * plain + (1 - PLAIN) * np.interp(margin, self.knots, self.levels) if len(self.knots) else plain


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """``y, text, fold`` of at most ``per_class`` labelled rows of either label, by the hash of the id."""
    known = labels.filter(labels[label_col].isin(0, 1) & labels[id_col].isNotNull()).select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of 12 bytes
    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(picked), "_id").select("y", "text", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))


def packed(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, number of each row's) of at most BLOCK rows at a time, as views of the Arrow buffers."""
    for chunk in column.chunks:
        kind = np.int64 if chunk.type == pa.large_binary() else np.int32
        for at in range(0, len(chunk), BLOCK):
            part = chunk.slice(at, BLOCK)
            ends = np.frombuffer(part.buffers()[1], dtype=kind)[part.offset : part.offset + len(part) + 1]
            data = np.frombuffer(part.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if part.buffers()[2] else np.zeros(0, dtype=np.uint8)
            yield data.view(np.uint32), np.diff(ends) // 4


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = MAX_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, l2: float = 1e-5, steps: int = 150) -> Model:
    """Fit on the labelled rows; without rows of both labels the score is the share of label 1, or 0.

    Labels other than 0 and 1 and rows without id are not used. A label or document that repeats counts
    each time, so an id labelled both ways counts for both. With fewer than ``FOLDS`` rows of either
    label in any fold's complement the score is the plain logistic one.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distinct = Distinct()
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "fold": b["fold"], "b": [distinct(t).astype(np.uint32).tobytes() for t in b["text"]]})

    rows = sample_labelled(docs, labels, label_col, per_class, id_col, text_col).mapInPandas(extract, "y int, fold int, b binary").toArrow()
    model = solve(rows, alpha, l2, steps)
    model.knots, model.levels = calibration(rows, alpha, l2)
    del rows
    pa.default_memory_pool().release_unused()  # the n-grams' memory goes back before the driver goes on
    return model


def calibration(rows: pa.Table, alpha: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the isotonic map from margins of unseen rows to shares of label 1; both labels weigh the same."""
    y, fold = rows["y"].to_numpy(), rows["fold"].to_numpy()
    if any(np.count_nonzero((fold != f) & (y == label)) < FOLDS for f in range(FOLDS) for label in (0, 1)):
        return np.zeros(0), np.zeros(0)
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        model, held = solve(rows.filter(pa.array(fold != f)), alpha, l2, FOLD_STEPS), np.flatnonzero(fold == f)
        found = [model.weights[part].sum() for index, sizes in packed(rows["b"].take(pa.array(held))) for part in np.split(index, np.cumsum(sizes)[:-1])] if len(held) else []
        margin[held] = np.array(found) + model.bias
    order = np.lexsort((y, margin))
    weight = np.array([1 / np.count_nonzero(y == k) for k in (0, 1)])
    return margin[order], pool(y[order].astype(float), weight[y[order]])


def summed_rows(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``, of which some may be empty."""
    out, full = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def solve(rows: pa.Table, alpha: float, l2: float, steps: int) -> Model:
    """The uncalibrated model of rows ``y, b`` (label, packed distinct buckets)."""
    y = rows["y"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    gathered = list(packed(rows["b"]))  # views: wider numbers are made a block at a time
    past = np.cumsum([len(sizes) for _, sizes in gathered])
    blocks = [slice(p - len(sizes), p) for p, (_, sizes) in zip(past.tolist(), gathered, strict=True)]

    def counts(weights: np.ndarray) -> np.ndarray:
        """Sum of the rows' weights for each bucket."""
        return sum(np.bincount(index, weights=np.repeat(weights[k], sizes), minlength=1 << BITS) for k, (index, sizes) in zip(blocks, gathered, strict=True))

    df1, df0 = counts((y == 1) * 1.0), counts((y == 0) * 1.0)
    ratio = np.log((df1 + alpha) / (y.sum() + 2 * alpha)) - np.log((df0 + alpha) / (len(y) - y.sum() + 2 * alpha))
    scale = ratio * UNIT
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both labels count the same

    def forward(v: np.ndarray) -> np.ndarray:
        scaled = v * scale
        return np.concatenate([summed_rows(scaled[index], sizes) for index, sizes in gathered])

    def backward(g: np.ndarray) -> np.ndarray:
        return counts(g) * scale

    u = np.random.default_rng(0).normal(size=1 << BITS)
    for _ in range(8):  # power iteration: the largest curvature gives the step
        u = backward(weight * forward(u / max(1e-30, float(np.linalg.norm(u)))))
    rate = 1 / (0.3 * (float(np.linalg.norm(u)) + 1) + l2)
    w, bias = np.zeros(1 << BITS), 0.0
    v, vb = w, bias
    for k in range(steps):  # accelerated gradient descent
        g = weight * (1 / (1 + np.exp(-np.clip(forward(v) + vb, -35, 35))) - y)
        new, new_b = v - rate * (backward(g) + l2 * v), vb - rate * g.sum()
        v, vb = new + k / (k + 3) * (new - w), new_b + k / (k + 3) * (new_b - bias)
        w, bias = new, new_b
    return Model((w * ratio * UNIT).astype(np.float32), float(bias))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` in [0, 1]; null and empty text have the score of no evidence.

    A column of ``docs`` named ``score`` is replaced, all others and every row are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights
    return append(docs, [text_col], "score double", lambda: lambda texts: [shared.value.scores(texts)])


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = append(docs, [text_col], "_toxicity double", lambda: lambda texts: [shared.value.scores(texts)])
    return scored.filter(F.col("_toxicity") < threshold).select(*docs.columns)
