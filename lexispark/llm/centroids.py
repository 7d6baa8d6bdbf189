"""Centroid clustering in whole numbers: the nearest of many centroids is found in a vantage-point tree.

Each round builds a tree over the centroids on the driver and sends it to the tasks. A vector looks at
the tree's nodes in the order of their lower bounds, its own order for each vector, and leaves out
those whose bound is above its best distance so far. Bounds are inclusive: a node that could hold an
equally near centroid is looked at, so ties go to the smallest number exactly. The distances that
decide are sums of squares of whole numbers; only bounds are floating, with room for their rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexispark.llm.text import slices

#: Centroids of a leaf of the tree.
LEAF = 2
#: Vectors of a block are so many that their table of bounds has about this many entries.
BOUNDS = 1 << 20
#: Bits of a limb of a sum.
LIMB = 32
_LONG = (1 << 63) - 1


def wide(dim: int) -> int:
    """Components up to this size have squared distances that fit in 64 bits; larger ones are computed with Python's numbers."""
    return math.isqrt((1 << 60) // max(1, dim))


def integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors and their components floor(scale * x), as int64 or, beyond ``wide(dim)``, as Python's ints.

    Usable are vectors of ``dim`` components, none null, NaN or infinite (nor infinite when scaled).
    """
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64).reshape(len(rows), dim) * scale
    usable = np.isfinite(values).all(axis=1)
    values = np.floor(values[usable])
    if values.size and np.abs(values).max() > wide(dim):
        return rows[usable], np.array([[int(x) for x in v] for v in values.tolist()], dtype=object).reshape(-1, dim)
    return rows[usable], values.astype(np.int64)


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``vectors`` to one point."""
    gap = vectors - point
    return (gap * gap).sum(axis=1)


@dataclass
class Node:
    numbers: list[int]  # of a leaf its centroids, else the vantage point alone
    radius: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # distances of the near side from the vantage point: least, most; of the far side
    near: int = -1
    far: int = -1


@dataclass
class Tree:
    """Vantage-point tree over ``centroids``; node 0 is the root."""

    centroids: list[list[int]]
    nodes: list[Node] = field(default_factory=list)
    inertia: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def over(centroids: list[list[int]]) -> Tree:
        tree = Tree(centroids)
        if centroids:
            tree._add(list(range(len(centroids))))
        return tree

    def _apart(self, a: int, b: int) -> int:
        return sum((x - y) ** 2 for x, y in zip(self.centroids[a], self.centroids[b], strict=True))

    def _add(self, numbers: list[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(Node(numbers))
        if len(numbers) > LEAF:
            first = numbers[0]  # the vantage point: the one farthest from some centroid
            vantage = max(numbers, key=lambda n: (self._apart(first, n), -n))
            rest = sorted((self._apart(vantage, n), n) for n in numbers if n != vantage)
            cut = (len(rest) + 1) // 2
            inside, outside = rest[:cut], rest[cut:]
            root = lambda d: float(d) ** 0.5
            out = (root(outside[0][0]), root(outside[-1][0])) if outside else (0.0, 0.0)
            self.nodes[at] = node = Node([vantage], (root(inside[0][0]), root(inside[-1][0]), *out))
            node.near = self._add([n for _, n in inside])
            node.far = self._add([n for _, n in outside]) if outside else -1
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and exact squared distance for each vector, and how many distances were taken."""
        if not len(vectors):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=vectors.dtype), 0
        large = vectors.dtype == object or max(abs(x) for c in self.centroids for x in c) > wide(vectors.shape[1])
        if large and vectors.dtype != object:
            vectors = vectors.astype(object)
        points = np.array(self.centroids, dtype=object if large else np.int64)
        step = max(1, BOUNDS // max(64, len(self.nodes)))
        parts = [self._block(vectors[k : k + step], points) for k in range(0, len(vectors), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)

    def _block(self, vectors: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, taken = len(vectors), 0
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0.0
        best, number = np.full(n, np.inf), np.full(n, len(points), dtype=np.int64)
        exact = np.zeros(n, dtype=vectors.dtype)
        open_ = np.arange(n)
        while len(open_):
            pick = bound[open_].argmin(axis=1)  # each vector's own most promising node
            low = bound[open_, pick]
            going = (low < np.inf) & (low <= best[open_])  # inclusive: an equal bound may hide a tie
            open_, pick = open_[going], pick[going]
            bound[open_, pick] = np.inf
            for at in np.unique(pick).tolist():
                node, rows = self.nodes[at], open_[pick == at]
                for c in node.numbers:
                    d = squared(vectors[rows], points[c])
                    taken += len(rows)
                    first = number[rows] == len(points)
                    better = first | (d < exact[rows]) | ((d == exact[rows]) & (c < number[rows]))
                    won = rows[better]
                    exact[won], number[won] = d[better], c
                    root = np.sqrt(d.astype(np.float64))
                    best[won] = root[better]
                for child, least, most in ((node.near, *node.radius[:2]), (node.far, *node.radius[2:])):
                    if child >= 0:  # no centroid of the child is nearer than the gap to its ring, less what rounding may add
                        gap = np.maximum(root - most, least - root)
                        bound[rows, child] = np.maximum(0.0, gap - 1e-9 * (root + most + 1))
        return number, exact, taken


def limbs(kind: str, cluster: int, total: list[int]) -> Iterator[tuple[str, int, int, int, int]]:
    """A vector of whole numbers as (kind, cluster, position, limb, value): sums of limbs stay in 64 bits however large the sums are."""
    for position, x in enumerate(total):
        sign, x, k = (-1 if x < 0 else 1), abs(x), 0
        while x or not k:
            yield kind, cluster, position, k, sign * (x & ((1 << LIMB) - 1))
            x, k = x >> LIMB, k + 1


def exact_sums(block: np.ndarray) -> list[int]:
    """Componentwise sum as Python's ints; blocks of 64-bit numbers are small enough not to overflow."""
    return [int(x) for x in block.sum(axis=0)]


def sums(vectors: DataFrame, tree: Tree, column: str, dim: int, scale: int) -> dict[tuple[str, int], dict[int, int]]:
    """For each cluster its count, componentwise sum and summed distance: ``(kind, cluster) -> {position: total}``.

    A task sends one row for each cluster, position and limb; Spark adds them up.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], list[int]] = {}
        for b in (part for whole in batches for part in slices(whole)):
            _, points = integers(b.column(0), dim, scale)
            number, distance, _ = shared.value.nearest(points)
            for c in np.unique(number).tolist():
                mine = number == c
                for kind, add in (("sum", exact_sums(points[mine])), ("count", [int(mine.sum())]), ("distance", [sum(distance[mine].tolist())])):
                    total[kind, c] = [x + y for x, y in zip(total.get((kind, c), [0] * len(add)), add, strict=True)]
        rows = [row for (kind, c), x in total.items() for row in limbs(kind, c, x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["kind", "cluster", "position", "limb", "value"])

    parts = vectors.select(column).mapInArrow(run, "kind string, cluster int, position int, limb int, value long")
    out: dict[tuple[str, int], dict[int, int]] = {}
    for r in parts.groupBy("kind", "cluster", "position", "limb").agg(F.sum("value").alias("value")).collect():  # a row per centroid component and limb
        at = out.setdefault((r.kind, r.cluster), {})
        at[r.position] = at.get(r.position, 0) + (r.value << (LIMB * r.limb))
    shared.destroy()
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int, id_col: str, column: str, dim: int, scale: int) -> list[list[int]]:
    """The ``k`` usable vectors of smallest SHA-256 of ``seed:id``, in that order; equal ids go by their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, points = integers(b.column(1), dim, scale)
            digits = [",".join(map(str, p)) for p in points.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(digits, type=pa.string())], names=["h", "digits"])

    # the ids' hashes are cut to the k smallest before vectors are turned into text, unless some of them can't be used
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("h"), F.col(column).alias("v"))
    x = F.transform("v", lambda c: c.cast("double") * scale)
    usable = hashed.filter((F.size("v") == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    found = usable.orderBy("h", "v").limit(k).mapInArrow(run, "h string, digits string").collect()
    return [[int(n) for n in r.digits.split(",")] for r in sorted(found, key=lambda r: (r.h, [int(n) for n in r.digits.split(",")]))]


def moved(centroids: list[list[int]], found: dict[tuple[str, int], dict[int, int]]) -> list[list[int]]:
    """Each centroid that has vectors goes to the floor of their mean, the others stay."""
    out = []
    for c, old in enumerate(centroids):
        n = found.get(("count", c), {}).get(0, 0)
        out.append([found["sum", c][p] // n for p in range(len(old))] if n else old)
    return out


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vectors`` that can be used, with ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid``.

    Components become floor(scale * x). The first centroids are the vectors of smallest hash of the id;
    each round assigns every vector to the nearest centroid (ties: smallest number) and moves centroids
    to the floor of their vectors' mean; then vectors are assigned once more. Vectors that are null, of
    other length than ``dim``, or with a null, NaN or infinite component are left out. A null id hashes
    as empty text. With fewer than ``k`` usable vectors there are fewer centroids, with none no rows.
    Repeated rows count each. Distances and sums beyond 64 bits are null, though the clustering is
    exact there too. Columns of ``vectors`` with the names of the new ones are replaced, others kept.
    """
    spark = vectors.sparkSession
    tree = Tree.over(first_centroids(vectors, k, seed, id_col, column, dim, scale))
    for _ in range(rounds if tree.centroids else 0):
        tree = Tree.over(moved(tree.centroids, sums(vectors, tree, column, dim, scale)))
    if tree.centroids:
        last = sums(vectors, tree, column, dim, scale)
        tree.inertia = {c: last.get(("distance", c), {}).get(0, 0) for c in range(len(tree.centroids))}
    new = StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid array<string>")
    base = vectors.drop(*[c for c in new.names if c not in (id_col, column)])
    rest = [f for f in base.schema.fields if f.name not in new.names]
    schema = StructType([*rest, *new.fields])
    kinds, names = list(to_arrow_schema(new).types), [f.name for f in rest]
    shared = spark.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        fits = lambda x: x if abs(x) <= _LONG else None
        whole = fits(sum(tree.inertia.values()))
        for b in (part for full in batches for part in slices(full)):
            rows, points = integers(b.column(column), dim, scale)
            number, distance, _ = tree.nearest(points)
            of = number.tolist()
            cols = [of, [fits(int(d)) for d in distance], [fits(tree.inertia[c]) for c in of], [whole] * len(of)]
            text = pa.array([[str(x) for x in c] for c in tree.centroids], type=kinds[4])
            kept = b.select(names).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(x, type=t) for x, t in zip(cols, kinds, strict=False)], text.take(pa.array(number))], names=[*names, *new.names])

    return (base if tree.centroids else base.limit(0)).mapInArrow(run, schema)


def centroid_digest(centroid: str = "centroid") -> Column:
    """SHA-256 of a centroid's components as decimal numbers with commas between."""
    return F.sha2(F.concat_ws(",", F.col(centroid)), 256)
