"""Metric cells: vectors are grouped around pivots, and the triangle inequality says which cells need not meet.

Pivots are rows of the table itself, spread out among a sample by hash, at most ``MOST_PIVOTS``; every task
gets them. A
vector belongs to the cell of its nearest pivot. Cells of more than ``block`` rows are worked on in parts,
so a place where many vectors lie is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexispark.functions.lineage import materialize
from lexispark.operators.components import TOGETHER, connected_components, smallest_reached

#: Rows of a part of a cell, rows of a cell on average, and pivots at most.
BLOCK, CELL, MOST_PIVOTS = 2048, 1024, 4096
#: Rows of the sample for each pivot wanted.
SAMPLE = 4
#: Room for rounding in bounds, for distances of about 1.
SLACK = 1e-4


def stacked(rows: pd.Series, unit: bool = False) -> np.ndarray:
    """The vectors as rows of doubles; with ``unit`` of length 1, zero vectors as they are."""
    if not len(rows):
        return np.zeros((0, 0))
    m = np.stack([np.asarray(x, dtype=np.float32 if unit else np.float64) for x in rows]).astype(np.float64)
    if unit:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(n == 0, 1, n)
    return m


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))


@dataclass
class Cells:
    """Pivots with the distance of the farthest and the number of the members of each cell."""

    pivots: np.ndarray
    unit: bool
    radius: np.ndarray
    size: np.ndarray

    def home(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and the distances to all, in slices of rows."""
        d = distances(vectors, self.pivots)
        return d.argmin(axis=1), d


def cells_of(base: DataFrame, id_col: str, unit: bool, cell: int = CELL) -> tuple[Cells, DataFrame]:
    """The cells of ``base`` and its rows with ``_cell``, a written table."""
    n = base.count()
    wanted = max(1, min(MOST_PIVOTS, ceil(n / cell)))
    sample = base.orderBy(F.xxhash64(id_col, F.lit("pivot")), id_col).limit(wanted if wanted == 1 else SAMPLE * wanted).select("embedding").toPandas()
    cells = Cells(spread(np.unique(stacked(sample["embedding"], unit), axis=0), wanted) if n else np.zeros((0, 0)), unit, np.zeros(0), np.zeros(0))
    if not n:
        return cells, base.withColumn("_cell", F.lit(0))
    placed = materialize(with_columns(base, "_cell int, _reach double", cells, lambda c, x: dict(zip(("_cell", "_reach"), nearest_of(c, x), strict=True))), "cells")
    found = placed.groupBy("_cell").agg(F.max("_reach").alias("r"), F.count(F.lit(1)).alias("n")).toPandas()  # a row a pivot
    cells.radius, cells.size = np.full(len(cells.pivots), -np.inf), np.zeros(len(cells.pivots), dtype=np.int64)
    cells.radius[found["_cell"]], cells.size[found["_cell"]] = found["r"], found["n"]
    return cells, placed.drop("_reach")


def spread(points: np.ndarray, wanted: int) -> np.ndarray:
    """Up to ``wanted`` of the points, each the farthest from those before it, so that the cells' radii are small."""
    taken = [0]
    gap = distances(points, points[:1])[:, 0]
    while len(taken) < min(wanted, len(points)):
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(points, points[taken[-1:]])[:, 0])
    return points[taken]


def nearest_of(cells: Cells, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, d = cells.home(x)
    return own.astype(np.int32), d[np.arange(len(x)), own]


def with_columns(df: DataFrame, added: str, cells: Cells, compute: Callable, extra: str | None = None) -> DataFrame:
    """``df`` (with ``embedding``) and the columns ``added`` that ``compute(cells, vectors[, extra column])`` gives."""
    shared = df.sparkSession.sparkContext.broadcast(cells)  # at most MOST_PIVOTS vectors
    names = [c.split()[0] for c in added.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 1024):
                f = whole.iloc[at : at + 1024].copy()
                x = stacked(f["embedding"], shared.value.unit)
                out = compute(shared.value, x, *([f[extra].to_numpy()] if extra else []))
                for c in names:
                    f[c] = list(out[c]) if out[c].dtype == object else out[c]
                yield f

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, {added}")


def comparable(vectors: DataFrame, threshold: float, id_col: str) -> DataFrame:
    """``id, embedding`` of the rows that can have a partner."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), "embedding").filter("id is not null and size(embedding) > 0")
    return rows.filter(F.exists("embedding", lambda x: x != 0)) if threshold > 0 else rows


def pairs_within(vectors: DataFrame, threshold: float, id_col: str, block: int = BLOCK, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(``a, b, similarity`` of every pair a < b of cosine ``threshold`` or more, the rows ``_to, _home`` dealt to cells).

    A vector is compared in its own cell and goes to a later cell only if a member could be within the
    angle: its distance from that pivot is at most the cell's radius and the reach of the threshold,
    and it lies near enough to the border between both pivots. For a threshold of 0 or less no cell can be
    left out; above it zero vectors have no partners.
    """
    cells, placed = cells_of(comparable(vectors, threshold, id_col), "id", True, cell if threshold > 0 else 1 << 60)
    reach = max(0.0, 2 - 2 * threshold) ** 0.5 + SLACK  # as a distance of unit vectors

    def visits(c: Cells, x: np.ndarray, own: np.ndarray) -> dict:
        d = distances(x, c.pivots)
        mine = d[np.arange(len(x)), own][:, None]
        go = (d <= c.radius[None] + reach) & (d - mine <= 2 * reach) & (np.arange(d.shape[1])[None] > own[:, None])
        go[np.arange(len(x)), own] = True
        out = np.empty(len(x), dtype=object)
        out[:] = [np.flatnonzero(g).astype(np.int32) for g in go]
        return {"_to": out}

    if not len(cells.pivots):
        return vectors.sparkSession.createDataFrame([], "a long, b long, similarity double"), placed.select(F.lit(0).alias("_to"), F.lit(True).alias("_home"))
    sent = with_columns(placed, "_to array<int>", cells, visits, "_cell").withColumn("_to", F.explode("_to")).withColumn("_home", F.col("_to") == F.col("_cell")).drop("_cell")
    sent = materialize(sent, "visits")
    # parts of a cell, and of those that visit it
    counts = sent.groupBy("_to").agg(F.ceil(F.count_if("_home") / block).cast("int").alias("_p"), F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("_home")) / block)).cast("int").alias("_q"))  # a row a pivot
    dealt = sent.join(F.broadcast(counts), "_to")
    part = F.pmod(F.xxhash64("id"), F.when(F.col("_home"), F.col("_p")).otherwise(F.col("_q"))).cast("int")
    dealt = dealt.withColumn("_part", part)
    # members meet members in cells of a triangle (i <= j, kind 0) and visitors in cells of a rectangle (kind 1)
    own = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda o: F.struct(F.lit(0).alias("kind"), F.least(o, F.col("_part")).alias("i"), F.greatest(o, F.col("_part")).alias("j")))
    base = F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda o: F.struct(F.lit(1).alias("kind"), F.col("_part").alias("i"), o.alias("j")))
    guest = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda o: F.struct(F.lit(1).alias("kind"), o.alias("i"), F.col("_part").alias("j")))
    tasks = dealt.withColumn("_task", F.explode(F.when(F.col("_home"), F.concat(own, base)).otherwise(guest))).select("id", "embedding", "_home", "_part", "_to", "_task.*")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["kind"].iat[0]:
            x, y = pdf[pdf["_home"]], pdf[~pdf["_home"]]
        else:
            x, y = pdf[pdf["_part"] == pdf["i"].iat[0]], pdf[pdf["_part"] == pdf["j"].iat[0]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        s = stacked(x["embedding"], True) @ stacked(y["embedding"], True).T
        p, q = np.nonzero(s >= threshold)
        a, b = x["id"].to_numpy()[p], y["id"].to_numpy()[q]
        keep = a < b if not pdf["kind"].iat[0] and pdf["i"].iat[0] == pdf["j"].iat[0] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": np.clip(s[p, q][keep], -1, 1)})

    return tasks.groupBy("_to", "kind", "i", "j").applyInPandas(compare, "a long, b long, similarity double"), sent.select("_to", "_home")


def nearest(queries: DataFrame, base: DataFrame, k: int, unit: bool, block: int = BLOCK, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(``query_id, base_id, score`` of the ``k`` nearest of ``base`` (base_id, embedding) to each of ``queries`` (query_id, embedding) and perhaps some more, the visits ``query_id, _to``).

    The score is the cosine with ``unit``, else the Euclidean distance, and is compared to nine places.
    A query looks into the cell of its nearest pivot first; the distance of the k-th there says which other
    cells can hold one as near, and only those are looked into. An equal bound counts, so ties are whole.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, base_id {base.schema['base_id'].dataType.simpleString()}, score double"
    cells, placed = cells_of(base.select("base_id", "embedding"), "base_id", unit, cell)
    if not len(cells.pivots):
        none = queries.sparkSession.createDataFrame([], kinds)
        return none, none.select("query_id", F.lit(0).alias("_to"))
    sign = -1.0 if unit else 1.0

    def look(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "base_id": [], "score": []})
        y = y.sort_values("base_id")
        a, b = stacked(x["embedding"], unit), stacked(y["embedding"], unit)
        if unit:
            s = np.clip(np.round(a @ b.T, 9), -1, 1)
        else:
            s = distances(a, b)
            s[s < 1e-7] = 0
        d = np.round(sign * s, 9)
        if d.shape[1] > k:  # all that are as near as the k-th, of which the first k are kept
            i, j = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        else:
            i, j = np.nonzero(np.ones_like(d, dtype=bool))
        by = np.lexsort((j, d[i, j], i))
        i, j = i[by], j[by]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[first], j[first]
        return pd.DataFrame({"query_id": x["query_id"].to_numpy()[i], "base_id": y["base_id"].to_numpy()[j], "score": s[i, j]})

    def met(visits: DataFrame) -> DataFrame:
        counts = visits.groupBy("_to").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_q"))
        sizes = placed.groupBy(F.col("_cell").alias("_to")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_p"))
        parts = materialize(counts.join(sizes, "_to"), "parts")  # a row a pivot
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = visits.join(F.broadcast(parts), "_to").withColumn("_i", F.pmod(F.xxhash64("query_id"), "_q").cast("int")).withColumn("_j", every("_p"))
        b = placed.withColumnRenamed("_cell", "_to").join(F.broadcast(parts), "_to").withColumn("_j", F.pmod(F.xxhash64("base_id"), "_p").cast("int")).withColumn("_i", every("_q"))
        keys = ["_to", "_i", "_j"]
        return q.select("query_id", "embedding", *keys).groupBy(*keys).cogroup(b.select("base_id", "embedding", *keys).groupBy(*keys)).applyInPandas(look, kinds)

    own = materialize(with_columns(queries.select("query_id", "embedding"), "_to int", cells, lambda c, x: {"_to": nearest_of(c, x)[0]}), "visits")
    found = materialize(met(own), "nearest")
    if len(cells.pivots) == 1:
        return found, own.select("query_id", "_to")
    kth = found.groupBy("query_id").agg(F.get(F.array_sort(F.collect_list(F.lit(sign) * F.col("score"))), k - 1).alias("_kth"))  # at least k scores from each part of one cell
    bounded = own.join(kth, "query_id", "left")

    def others(c: Cells, x: np.ndarray, kth: np.ndarray) -> dict:
        d = distances(x, c.pivots)
        bound = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(0, 2 + 2 * kth)) if unit else kth)
        go = d - c.radius[None] <= bound[:, None] + SLACK * (1 + np.where(np.isfinite(bound), bound, 0))[:, None]
        go[np.arange(len(x)), d.argmin(axis=1)] = False
        out = np.empty(len(x), dtype=object)
        out[:] = [np.flatnonzero(g).astype(np.int32) for g in go]
        return {"_more": out}

    more = with_columns(bounded.withColumn("_kth", F.col("_kth").cast("double")), "_more array<int>", cells, others, "_kth")
    more = materialize(more.select("query_id", "embedding", F.explode("_more").alias("_to")), "visits")
    return found.unionByName(met(more)), own.select("query_id", "_to").unionByName(more.select("query_id", "_to"))


#: Rows of a block whose links are looked at together.
SLICE = 256


def star(x: np.ndarray, y: np.ndarray, x_id: np.ndarray, y_id: np.ndarray, threshold: float) -> pd.DataFrame:
    """Edges ``a, b`` that connect the ids of ``x`` and ``y`` as all their pairs of the threshold do, fewer than there are rows."""
    a = b = np.zeros(0, dtype=np.int64)
    for at in range(0, len(x), SLICE):
        p, q = np.nonzero(x[at : at + SLICE] @ y.T >= threshold)
        if len(p):
            node, low = smallest_reached(np.concatenate([a, p + at]), np.concatenate([b, q + len(x)]))
            a, b = node[node != low], low[node != low]
    ids = np.concatenate([x_id, y_id])
    a, b = ids[a], ids[b]
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def linked_within(vectors: DataFrame, threshold: float, id_col: str, block: int = BLOCK, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(``node, component`` of every vector with a partner of cosine ``threshold`` or more, the rows ``id, _to`` that looked beyond their cell).

    The components are those of :func:`pairs_within`, but its pairs are never listed: a task sends on what
    connects its rows. Members of a cell meet, and all vectors meet one member of each cell. A pair
    that could still join components has a side outside the largest one. Only such vectors look into other
    cells that are near enough and hold another component. Where there are many components of similar sizes, most do.
    """
    cells, placed = cells_of(comparable(vectors, threshold, id_col), "id", True, cell if threshold > 0 else 1 << 60)
    none = placed.sparkSession.createDataFrame([], "node long, component long")
    if not len(cells.pivots):
        return none, placed.select("id", F.lit(0).alias("_to"))
    sizes = placed.groupBy(F.col("_cell").alias("_to")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_p"))  # a row a pivot
    parted = placed.withColumnRenamed("_cell", "_to").join(F.broadcast(sizes), "_to").withColumn("_part", F.pmod(F.xxhash64("id"), "_p").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_p") - 1))
    own = parted.withColumn("_o", every).withColumns({"i": F.least("_o", "_part"), "j": F.greatest("_o", "_part")}).select("id", "embedding", "_part", "_to", "i", "j")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["_part"] == pdf["i"].iat[0]], pdf[pdf["_part"] == pdf["j"].iat[0]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        return star(stacked(x["embedding"], True), stacked(y["embedding"], True), x["id"].to_numpy(), y["id"].to_numpy(), threshold)

    first = placed.groupBy("_cell").agg(F.min_by("embedding", "id").alias("embedding"), F.min("id").alias("id")).toPandas()  # a row a pivot
    heads = placed.sparkSession.sparkContext.broadcast((stacked(first["embedding"], True), first["id"].to_numpy()))  # at most MOST_PIVOTS vectors

    def to_heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 1024):
                f = whole.iloc[at : at + 1024]
                yield star(stacked(f["embedding"], True), heads.value[0], f["id"].to_numpy(), heads.value[1], threshold)

    edges = own.groupBy("_to", "i", "j").applyInPandas(inside, "a long, b long")
    edges = materialize(edges.union(placed.select("id", "embedding").mapInPandas(to_heads, "a long, b long")), "cell-links")
    known = connected_components(edges, alone=TOGETHER)
    labelled = materialize(placed.select("id", "_cell").join(known.withColumnRenamed("node", "id"), "id", "left").select("id", "_cell", F.coalesce("component", "id").alias("component")).distinct(), "labelled")
    largest = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "component").first()["component"]
    held = labelled.groupBy("_cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.col("component") == largest).alias("big")).toPandas()  # a row a pivot
    lo, hi, big = np.zeros(len(cells.pivots), dtype=np.int64), np.zeros(len(cells.pivots), dtype=np.int64), np.zeros(len(cells.pivots), dtype=bool)
    lo[held["_cell"]], hi[held["_cell"]], big[held["_cell"]] = held["lo"], held["hi"], held["big"]
    reach = max(0.0, 2 - 2 * threshold) ** 0.5 + SLACK

    def visits(c: Cells, x: np.ndarray, component: np.ndarray) -> dict:
        d = distances(x, c.pivots)
        own = d.argmin(axis=1)
        go = (d <= c.radius[None] + reach) & (d - d.min(axis=1, keepdims=True) <= 2 * reach) & ((lo[None] != component[:, None]) | (hi[None] != component[:, None]))
        go &= big[None] | (np.arange(d.shape[1])[None] > own[:, None])  # of two sides outside the largest one looks
        go[np.arange(len(x)), own] = False
        out = np.empty(len(x), dtype=object)
        out[:] = [np.flatnonzero(g).astype(np.int32) for g in go]
        return {"_to": out}

    rest = placed.join(labelled.filter(F.col("component") != largest).select("id", "component"), "id")
    sent = with_columns(rest.select("id", "embedding", "component"), "_to array<int>", cells, visits, "component").select("id", "embedding", F.explode("_to").alias("_to"))
    sent = materialize(sent, "visits")
    looked = sent.select("id", "_to")
    if looked.isEmpty():
        return known, looked
    counts = materialize(sent.groupBy("_to").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_q")).join(sizes, "_to"), "parts")  # a row a pivot
    guests = sent.join(F.broadcast(counts), "_to").withColumns({"j": F.pmod(F.xxhash64("id"), "_q").cast("int")}).withColumn("i", every).select("_to", "i", "j", "id", "embedding")
    hosts = parted.drop("_p").join(F.broadcast(counts), "_to").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_q") - 1))).select("_to", F.col("_part").alias("i"), "j", "id", "embedding")

    def across(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        return star(stacked(x["embedding"], True), stacked(y["embedding"], True), x["id"].to_numpy(), y["id"].to_numpy(), threshold)

    more = guests.groupBy("_to", "i", "j").cogroup(hosts.groupBy("_to", "i", "j")).applyInPandas(across, "a long, b long")
    return connected_components(edges.union(materialize(more, "cell-links")), alone=TOGETHER), looked
