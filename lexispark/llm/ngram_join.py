"""N-gram Jaccard join with vertical partitioning.

Texts with the same shingle set are one class. All shingles have one global order: by how
frequent they are in the whole corpus, then by hash. The order is cut into fragments. Frequencies are
logarithms of counts in a table of ``TABLE`` places, to which shingles go by hash, so the table has
one size for every corpus.

1. Candidates: two sets that link share a shingle among the first of each set's order (prefix
   filter). Each fragment gets its part of the prefixes and yields pairs of classes. Where more than
   ``SHORT`` classes share a shingle, all are paired with the smallest only; the list is kept. Lists
   of shingles counted ``HEAVY`` times are never in one task: their members are dealt by set.
2. Overlaps: each fragment counts the common shingles of its segments of the candidate pairs; the
   partial counts are summed per pair and give the exact similarity. A pair is dropped as soon as
   it can't reach the threshold with all shingles not counted yet.
3. Components of the links found. In the kept lists, only pairs that lie in different components
   are still open. Members of long lists first meet some others, in ``ROUNDS``, after each of which
   there are fewer components; at last all pairs that are still open are counted, and then the
   components are final. So the members of a large group of near copies are never all paired. A
   pair whose sketches already differ in more places than linked sets can is left out before.

The order only decides how many candidates there are, never which links exist.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexispark.functions.lineage import materialize
from lexispark.llm.shingles import Hashing
from lexispark.llm.text import append, slices
from lexispark.operators.components import TOGETHER, connected_components

WORDS, PERCENT = 5, 75
#: Lists of at most so many classes give all their pairs at once.
SHORT = 8
#: Places of the table of counts, in how many slices tasks send it, and steps of the order for a doubled count.
TABLE_BITS, TABLE_SLICES, STEPS = 24, 256, 8
TABLE = 1 << TABLE_BITS
#: Shingles that a task counts together.
HELD = 1 << 18
#: Shingles counted at least so often, beyond twice what a place of the table holds on average, have their lists dealt by set.
HEAVY = 64
#: Bytes of text a fragment stands for, and fragments that count overlaps.
FRAGMENT_BYTES, COUNT_FRAGMENTS = 16 << 20, 4
#: About the bytes of text of a task that reads the table.
TASK_BYTES = 64 << 20
#: Parts to which the members of a list are dealt, and partners of a member in the rounds before all open pairs are taken.
SALTS, ROUNDS = 32, (16, 128)
#: Up to so many wanted classes, a few numbers each, are sent to the tasks that read the texts.
SENT = 1 << 18
#: Pairs of a cell in which segments are compared.
CELL_PAIRS = 2000
#: Places of a sketch.
SKETCH = 1024


def _distinct_sets(texts: list[bytes | None], hashing: Hashing) -> dict[int, np.ndarray]:
    """The texts' sets by key, without empty ones."""
    return {hashing.key(s): s for s in hashing.sets(texts, WORDS) if len(s)}


def signed(numbers: list[int]) -> np.ndarray:
    return np.array(numbers, dtype=np.uint64).view(np.int64)


def _signature(texts: list[bytes | None], hashing: Hashing) -> tuple[list[int], np.ndarray, np.ndarray]:
    sets = list(hashing.sets(texts, WORDS))
    return [len(s) for s in sets], signed([hashing.key(s) for s in sets]), signed([hashing.second(s) for s in sets])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """For each of ``SKETCH`` places whether an odd number of the tokens falls there, packed into longs.

    The sketches of two sets differ in no more places than the sets differ in tokens.
    """
    odd = np.bincount((tokens & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketched(texts: list[bytes | None], hashing: Hashing) -> tuple[list[int], np.ndarray, np.ndarray, list[np.ndarray]]:
    sets = list(hashing.sets(texts, WORDS))
    return [len(s) for s in sets], signed([hashing.key(s) for s in sets]), signed([hashing.second(s) for s in sets]), [sketch(s) for s in sets]


def signatures(texts: DataFrame, hashing: Hashing) -> DataFrame:
    """``_id, n, key, second, sketch`` of every row."""
    return append(texts, ["text"], "n long, key long, second long, sketch array<long>", lambda: lambda t: _sketched(t, hashing)).select("_id", "n", "key", "second", "sketch")


def identified(texts: DataFrame, hashing: Hashing) -> tuple[DataFrame, Hashing]:
    """:func:`signatures` as a written table, by keys of which each stands for one set as far as 128 bits tell, and their hashing.

    Sets that share 64 bits by chance are told apart by the second hash. There are fewer than a
    thousand of them among 10^11 sets; they go to all tasks.
    """
    sigs = materialize(signatures(texts, hashing), "signatures")
    same = sigs.filter("n > 0").groupBy("key").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).filter("lo <> hi").collect()
    if not same:
        return sigs, hashing
    unsigned = lambda x: x % (1 << 64)
    hashing = Hashing(hashing.seed, {unsigned(r.key): unsigned(r.lo) for r in same})
    return materialize(signatures(texts, hashing), "signatures"), hashing


def steps(count: np.ndarray) -> np.ndarray:
    """The place of a count in the order."""
    return np.minimum(255, np.round(STEPS * np.log2(1.0 + count))).astype(np.uint8)


class Counts:
    """Counts of ``size`` places in a byte each; what exceeds a byte is kept by place."""

    def __init__(self, size: int) -> None:
        self.low, self.more = np.zeros(size, dtype=np.uint8), {}
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def add(self, at: np.ndarray) -> None:
        for k in range(0, len(at), HELD):
            self.held.append(at[k : k + HELD].astype(np.uint32))
            self.waiting += len(self.held[-1])
            if self.waiting >= HELD:
                self.flush()

    def flush(self) -> None:
        if self.held:
            at = np.sort(np.concatenate(self.held))
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            place, total = at[first], np.diff(np.append(first, len(at)))
            total += self.low[place]
            self.low[place] = total & 255
            for k in np.flatnonzero(total > 255).tolist():
                self.more[int(place[k])] = self.more.get(int(place[k]), 0) + int(total[k] & ~255)
            self.held, self.waiting = [], 0

    def parts(self, n: int) -> Iterator[np.ndarray]:
        """The counts in ``n`` parts."""
        self.flush()
        width, by = len(self.low) // n, {}
        for place, count in self.more.items():
            by.setdefault(place // width, []).append((place % width, count))
        for k in range(n):
            out = self.low[k * width : (k + 1) * width].astype(np.uint32)
            for place, count in by.get(k, ()):
                out[place] += np.uint32(count)
            yield out


def shingle_counts(texts: DataFrame, tasks: int, hashing: Hashing) -> tuple[np.ndarray, int]:
    """:func:`steps` of the number of sets of the batches that hold a shingle, by its place in the table, and the first heavy one.

    A task counts into a table of its own and sends it in slices; ``tasks`` is about their number, by
    which slices are first added up in several groups.
    """
    width, salts = TABLE // TABLE_SLICES, max(1, -(-tasks // 1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, salt = Counts(TABLE), uuid.uuid4().int % salts
        for b in (part for whole in batches for part in slices(whole)):
            for s in _distinct_sets(b.column("text").to_pylist(), hashing).values():
                table.add(s >> np.uint64(64 - TABLE_BITS))
        for k, part in enumerate(table.parts(TABLE_SLICES)):
            if part.any():
                yield pa.RecordBatch.from_pylist([slice_row(k, salt, part)], schema=_COUNTS)

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.uint64)
        for r in rows.to_pylist():
            total += np.frombuffer(pa.decompress(r["low"], width, "zstd"), dtype=np.uint8)
            total[np.frombuffer(r["at"], dtype=np.uint32)] += np.frombuffer(r["more"], dtype=np.uint32)
        return pa.Table.from_pylist([slice_row(rows["slice"][0].as_py(), 0, np.minimum(total, np.uint64((1 << 32) - 1)).astype(np.uint32))], schema=_COUNTS)

    sent = texts.mapInArrow(run, COUNTS)
    for keys in (["slice", "salt"], ["slice"]) if salts > 1 else (["slice"],):
        sent = sent.groupBy(*keys).applyInArrow(add, COUNTS)
    out, total = np.zeros(TABLE, dtype=np.uint8), 0
    for r in sent.toLocalIterator():
        counts = np.frombuffer(pa.decompress(bytes(r["low"]), width, "zstd"), dtype=np.uint8).astype(np.uint32)
        counts[np.frombuffer(r["at"], dtype=np.uint32)] += np.frombuffer(r["more"], dtype=np.uint32)
        out[r["slice"] * width : (r["slice"] + 1) * width] = steps(counts)
        total += int(counts.sum(dtype=np.uint64))
    return out, int(steps(np.array(HEAVY + 2 * total / TABLE)))


COUNTS = "slice int, salt int, low binary, at binary, more binary"
_COUNTS = pa.schema([("slice", pa.int32()), ("salt", pa.int32()), ("low", pa.binary()), ("at", pa.binary()), ("more", pa.binary())])


def slice_row(k: int, salt: int, counts: np.ndarray) -> dict:
    """A slice of the table: counts up to 255 as compressed bytes, and what exceeds them with its places."""
    at = np.flatnonzero(counts > 255).astype(np.uint32)
    return {"slice": k, "salt": salt, "low": pa.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), "zstd", asbytes=True), "at": at.tobytes(), "more": (counts[at] - np.uint32(255)).astype(np.uint32).tobytes()}


def places(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The tokens as integers in the global order, which keep 56 bits of them."""
    step = table[(tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.uint64)
    return ((step << np.uint64(56) | tokens >> np.uint64(8)) ^ np.uint64(1 << 63)).view(np.int64)


def heavy_from(step: int) -> int:
    """The first place of heavy shingles."""
    return (step << 56) - (1 << 63)


def prefixes(texts: DataFrame, table: np.ndarray, heavy: int, fragments: int, hashing: Hashing) -> DataFrame:
    """Per batch and fragment the prefix parts of its sets, as packed arrays; from ``fragments`` on those of heavy shingles, by set."""
    shared = texts.sparkSession.sparkContext.broadcast(table)  # TABLE bytes
    part_of = lambda x: ((x >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            sets = _distinct_sets(b.column("text").to_pylist(), hashing)
            if not sets:
                continue
            keys = np.fromiter(sets, dtype=np.uint64, count=len(sets))
            sizes = np.array([len(s) for s in sets.values()])
            tokens, of = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), sizes)
            place = places(tokens, shared.value)
            order = np.lexsort((place, of))
            tokens, place = tokens[order], place[order]
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            lead = pos < (sizes - -(-sizes * PERCENT // 100) + 1)[of]
            tokens, place, of, pos = tokens[lead], place[lead], of[lead], pos[lead]
            frag = np.where(place >= heavy, fragments + part_of(keys)[of], part_of(tokens))
            by = np.argsort(frag, kind="stable")
            out: dict[str, list] = {c: [] for c in _PREFIXES.names}
            for part in np.split(by, np.flatnonzero(np.diff(frag[by])) + 1):
                d, count = np.unique(of[part], return_counts=True)
                for c, v in zip(_PREFIXES.names, (int(frag[part[0]]), keys[d].tobytes(), sizes[d].astype(np.int32).tobytes(), count.astype(np.int32).tobytes(), pos[part].astype(np.int32).tobytes(), place[part].tobytes()), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_PREFIXES)

    return texts.mapInArrow(run, "frag int, keys binary, sizes binary, counts binary, pos binary, tokens binary")


_PREFIXES = pa.schema([("frag", pa.int32()), *[(c, pa.binary()) for c in ("keys", "sizes", "counts", "pos", "tokens")]])


def possible(na, nb, pa, pb):
    """Whether sets of these sizes may link if their first common token has these places (numpy or Columns)."""
    rest_a, rest_b = na - pa, nb - pb
    need = PERCENT * (na + nb)
    return (100 * na >= PERCENT * nb) & (100 * nb >= PERCENT * na) & ((100 + PERCENT) * rest_a >= need) & ((100 + PERCENT) * rest_b >= need)


def alike(x: Column, y: Column, nx: Column, ny: Column) -> Column:
    """Whether sets of these sketches and sizes may link; true without a sketch. Linked sets differ in few tokens, and sketches in no more places."""
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, k: total + k)
    return F.coalesce((100 + PERCENT) * differ <= (100 - PERCENT) * (nx + ny), F.lit(True))


def candidates(rows: pd.DataFrame, fragments: int) -> pd.DataFrame:
    """Of one fragment: pairs (b set, token null) and the members of long lists (b null); of heavy shingles members only."""
    cat = lambda c, t: np.concatenate([np.frombuffer(x, dtype=t) for x in rows[c]])
    keys, sizes, counts = cat("keys", np.uint64), cat("sizes", np.int32), cat("counts", np.int32)
    _, first = np.unique(keys, return_index=True)
    kept = np.zeros(len(keys), dtype=bool)
    kept[first] = True  # copies in other batches have the same segment
    of = np.repeat(np.arange(len(keys)), counts)
    use = kept[of]
    of, pos, token = of[use], cat("pos", np.int32)[use].astype(np.int64), cat("tokens", np.int64)[use]
    order = np.lexsort((keys[of], token))
    of, pos, token = of[order], pos[order], token[order]
    key, n = keys[of].view(np.int64), sizes[of].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, dtype=np.int64)
    length = np.diff(np.concatenate([start, [len(token)]]))
    size, head = np.repeat(length, length), np.repeat(start, length)
    if rows["frag"].iloc[0] >= fragments:
        return pd.DataFrame({"a": key, "b": pd.array([None] * len(key), dtype="Int64"), "token": token, "n": n, "pos": pos})
    left, right = [], []
    for d in range(1, SHORT):
        i = np.flatnonzero((size[:-d] <= SHORT) & (head[:-d] == head[d:])) if len(token) > d else np.zeros(0, dtype=np.int64)
        left.append(i)
        right.append(i + d)
    i = np.flatnonzero((size > SHORT) & (head != np.arange(len(head))))
    left.append(head[i])
    right.append(i)
    a, b = np.concatenate(left), np.concatenate(right)
    ok = possible(n[a], n[b], pos[a], pos[b])
    pairs = pd.DataFrame({"a": np.minimum(key[a], key[b])[ok], "b": np.maximum(key[a], key[b])[ok]}).drop_duplicates()
    long = np.flatnonzero(size > SHORT)
    lists = pd.DataFrame({"a": key[long], "token": token[long], "n": n[long], "pos": pos[long]})
    out = pd.concat([pairs.astype({"b": "Int64"}), lists.astype({"token": "Int64", "n": "Int64", "pos": "Int64"})], ignore_index=True)
    return out.reindex(columns=["a", "b", "token", "n", "pos"])


def with_heads(lists: DataFrame) -> DataFrame:
    """The pairs (a, b) of the members of lists ``key, token, n, pos`` with the smallest member, which may link."""
    heads = lists.groupBy("token").agg(F.min(F.struct("key", "n", "pos")).alias("head")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = lists.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(heads, ["token", "salt"]).filter("head.key < key")
    return met.filter(possible(F.col("n"), F.col("head.n"), F.col("pos"), F.col("head.pos"))).select(F.col("head.key").alias("a"), F.col("key").alias("b"))


def segments(texts: DataFrame, wanted: DataFrame, hashing: Hashing) -> DataFrame:
    """``of_cell, frag, key, n, tokens``: the fragments of the sets of the wanted ``_id, key, cells``, for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            out: dict[str, list] = {c: [] for c in _SEGMENTS.names}
            for s, key, cells in zip(hashing.sets(b.column("text").to_pylist(), WORDS), b.column("key").to_pylist(), b.column("cells").to_pylist(), strict=True):
                if len(s) and hashing.key(s) == key % (1 << 64):  # an id may stand for several texts
                    cuts = [0, *np.searchsorted(s, np.array([f << 62 for f in range(1, COUNT_FRAGMENTS)], dtype=np.uint64)).tolist(), len(s)]
                    for f in range(COUNT_FRAGMENTS):
                        tokens = s[cuts[f] : cuts[f + 1]].tobytes()
                        for c in cells:
                            for name, v in zip(_SEGMENTS.names, (c, f, key, len(s), tokens), strict=True):
                                out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_SEGMENTS)

    return texts.join(wanted, "_id").select("key", "cells", "text").mapInArrow(run, "of_cell int, frag int, key long, n long, tokens binary")


_SEGMENTS = pa.schema([("of_cell", pa.int32()), ("frag", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])


PARTIAL = "a long, b long, na long, nb long, sa long, sb long, common long"


def partial_overlaps(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """Sizes and common shingles of one fragment's segments, per pair of one cell that may still link."""
    by_key = {k: (n, np.frombuffer(t, dtype=np.uint64)) for k, n, t in zip(sets["key"], sets["n"], sets["tokens"], strict=True)}
    out = []
    for a, b in zip(pairs["a"], pairs["b"], strict=True):
        if a in by_key and b in by_key:
            (na, x), (nb, y) = by_key[a], by_key[b]
            small, large = (x, y) if len(x) < len(y) else (y, x)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            common = int(np.count_nonzero(large[at] == small)) if len(large) else 0
            if (100 + PERCENT) * (common + min(na - len(x), nb - len(y))) >= PERCENT * (na + nb):
                out.append((a, b, na, nb, len(x), len(y), common))
    return pd.DataFrame(out, columns=["a", "b", "na", "nb", "sa", "sb", "common"])


def overlaps(pairs: DataFrame, texts: DataFrame, classes: DataFrame, hashing: Hashing) -> DataFrame:
    """``PARTIAL`` of the distinct pairs, by fragment.

    Classes are dealt to blocks and pairs to cells of two blocks, so a class goes to no more cells
    than there are blocks, whatever the number of its partners, and a cell is bounded too.
    """
    amount = pairs.count()
    blocks = max(4, ceil((amount / CELL_PAIRS * 2) ** 0.5))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = materialize(pairs.select("a", "b", (F.least(place("a"), place("b")) * blocks + F.greatest(place("a"), place("b"))).alias("cell")), "cells")
    members = placed.select(F.col("cell").alias("of_cell"), F.col("a").alias("key")).union(placed.select("cell", "b")).distinct()
    wanted = members.join(classes, "key").groupBy(F.col("_first").alias("_id"), "key").agg(F.collect_set("of_cell").alias("cells"))
    wanted = F.broadcast(wanted) if 2 * amount <= SENT else wanted  # else the texts are shuffled by id
    wide = placed.withColumn("frag", F.explode(F.sequence(F.lit(0), F.lit(COUNT_FRAGMENTS - 1))))
    return wide.groupBy("cell", "frag").cogroup(segments(texts, wanted, hashing).groupBy("of_cell", "frag")).applyInPandas(partial_overlaps, PARTIAL)


def links(pairs: DataFrame, texts: DataFrame, classes: DataFrame, hashing: Hashing) -> DataFrame:
    """The pairs (a, b) whose partial overlaps sum up to the threshold.

    A pair that a fragment ends has no partial overlap there, so it does not have ``COUNT_FRAGMENTS`` of them.
    """
    summed = overlaps(pairs, texts, classes, hashing).groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("common").alias("common"), F.count(F.lit(1)).alias("_counted"))
    linked = (F.col("_counted") == COUNT_FRAGMENTS) & ((100 + PERCENT) * F.col("common") >= PERCENT * (F.col("na") + F.col("nb")))
    return materialize(summed.filter(linked).select("a", "b"), "links")


def mixed_lists(lists: DataFrame, heavy: int, least: int = 1, sketches: DataFrame | None = None) -> DataFrame:
    """The rows of the lists ``key, token, n, pos, component`` of more than ``least`` members that hold several components, a written table.

    With ``salt``, to which members of heavy lists (tokens from ``heavy`` on) are dealt, ``members`` of the
    list, all such ``tokens`` of the key and, from ``sketches`` (key, sketch), its sketch.
    """
    mixed = lists.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("members")).filter((F.col("_lo") < F.col("_hi")) & (F.col("members") > least))
    often = F.col("token") >= heavy
    salted = lists.withColumn("salt", F.when(often, F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0).cast("int"))
    some = salted.join(mixed.select("token", "members", F.explode(F.sequence(F.lit(0), F.when(often, SALTS - 1).otherwise(0))).alias("salt")), ["token", "salt"])
    of_key = some.groupBy("key").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    of_key = of_key.withColumn("sketch", F.lit(None).cast("array<bigint>")) if sketches is None else of_key.join(sketches.select("key", "sketch"), "key", "left")
    return materialize(some.join(of_key, "key"), "mixed-lists")


def first_shared(x: Column | str, y: Column | str, token: Column) -> Column:
    """Whether a list is the first that both keys are in: a pair is taken there only, and its places there tell whether it may link."""
    return F.array_min(F.array_intersect(x, y)) == token


def sampled(some: DataFrame, partners: int) -> DataFrame:
    """Distinct pairs (a, b) of different components, about ``partners`` for each member, from :func:`mixed_lists`.

    Members of a list are dealt to groups by hash, differently for each ``partners``, and meet in their group.
    """
    groups = F.ceil(F.col("members") / partners)
    dealt = some.withColumn("_group", F.pmod(F.xxhash64("key", F.lit(partners)), groups))
    x, y = dealt.alias("x"), dealt.alias("y")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x._group") == F.col("y._group")) & (F.col("x.component") < F.col("y.component"))
    ok = first_shared("x.tokens", "y.tokens", F.col("x.token")) & possible(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")) & alike(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"))
    return x.join(y, met & ok).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def across(some: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of different components that share a list of :func:`mixed_lists` and may link.

    Lists are first reduced to their components, so members of one component never meet. Only the
    pairs of components are expanded, in cells of ``SALTS`` parts of either side.
    """
    one = F.count(F.lit(1)) == 1
    per = some.groupBy("token", "component").agg(
        F.count(F.lit(1)).alias("amount"), F.collect_set("salt").alias("salts"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.when(one, F.min("key")).alias("key"), F.when(one, F.min("tokens")).alias("tokens"), F.when(one, F.min("sketch")).alias("sketch")
    )
    x, y = per.alias("x"), per.alias("y")
    need = PERCENT * (F.col("x.least") + F.col("y.least"))
    sized = (100 * F.col("x.most") >= PERCENT * F.col("y.least")) & (100 * F.col("y.most") >= PERCENT * F.col("x.least")) & ((100 + PERCENT) * F.least("x.rest", "y.rest") >= need)
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")) & sized & F.coalesce(first_shared("x.tokens", "y.tokens", F.col("x.token")), F.lit(True)) & alike(F.col("x.sketch"), F.col("y.sketch"), F.col("x.least"), F.col("y.least"))
    # the side with fewer members is expanded first and meets the other's members one by one
    column = lambda c: [F.when(F.col("x.amount") >= F.col("y.amount"), F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(f"{o}_{c}") for o, p, q in (("x", "x", "y"), ("y", "y", "x"))]
    sides = materialize(x.join(y, met).select(F.col("x.token").alias("token"), *column("component"), *column("key"), *column("salts")), "component-pairs")
    single = F.col("x_key").isNotNull() & F.col("y_key").isNotNull()
    direct = sides.filter(single).select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b"))

    members = lambda s: some.select("token", F.col("component").alias(f"{s}_component"), F.col("salt").alias(f"{s}_salt"), F.struct("key", "n", "pos", "tokens", "sketch").alias(s))
    few = sides.filter(~single).withColumn("y_salt", F.explode("y_salts")).join(members("y"), ["token", "y_component", "y_salt"]).withColumn("x_salt", F.explode("x_salts")).alias("few")
    many = members("x").alias("many")
    meet = (F.col("few.token") == F.col("many.token")) & (F.col("few.x_component") == F.col("many.x_component")) & (F.col("few.x_salt") == F.col("many.x_salt"))
    ok = first_shared("x.tokens", "y.tokens", F.col("few.token")) & possible(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")) & alike(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"))
    wide = few.join(many, meet & ok)
    return direct.union(wide.select(F.least("x.key", "y.key"), F.greatest("x.key", "y.key"))).distinct()


def classified(docs: DataFrame, hashing: Hashing, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Hashing]:
    """``_id, n, key, component_id`` per row, see :func:`jaccard_components`, and the hashing that gives the keys."""
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    sigs, hashing = identified(texts, hashing)
    classes = materialize(sigs.filter("n > 0 and _id is not null").groupBy("key").agg(F.min("_id").alias("_first"), F.first("sketch").alias("sketch")), "classes")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = min(65_536, max(16, ceil(size / FRAGMENT_BYTES)))
    table, step = shingle_counts(texts, ceil(size / TASK_BYTES), hashing)
    heavy = heavy_from(step)
    packed = prefixes(texts.filter("_id is not null"), table, heavy, fragments, hashing)
    found = packed.groupBy("frag").applyInPandas(lambda rows: candidates(rows, fragments), "a long, b long, token long, n long, pos long")
    found = materialize(found, "candidates")
    lists = found.filter("token is not null").select(F.col("a").alias("key"), "token", "n", "pos")
    pairs = materialize(found.filter("b is not null").select("a", "b").union(with_heads(lists.filter(F.col("token") >= heavy))).distinct(), "pairs")

    linked, labelled = links(pairs, texts, classes, hashing), None
    for partners in (*ROUNDS, None):
        if labelled is None:
            inside = connected_components(linked, alone=TOGETHER).select(F.col("node").alias("key"), "component")
            labelled = lists.join(inside, "key", "left").withColumn("component", F.coalesce("component", "key"))
        if partners:  # lists too long for all their pairs
            found = sampled(mixed_lists(labelled, heavy, 4 * partners, classes), partners)
        else:
            found = across(mixed_lists(labelled, heavy, sketches=classes))
        found = materialize(found.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        if not found.isEmpty():
            linked, pairs, labelled = linked.union(links(found, texts, classes, hashing)), pairs.union(found), None
    if labelled is None:
        inside = connected_components(linked, alone=TOGETHER).select(F.col("node").alias("key"), "component")
    member = classes.join(inside, "key", "left").withColumn("component", F.coalesce("component", "key"))
    firsts = member.groupBy("component").agg(F.min("_first").alias("component_id"))
    resolved = materialize(member.join(firsts, "component").select("key", "component_id"), "components")
    own = F.when((F.col("n") == 0) | F.col("_id").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return sigs.join(resolved, "key", "left").select("_id", "n", "key", own.alias("component_id")), hashing


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` per row.

    Words are runs of anything but ASCII space and \\t-\\r after lower-casing A-Z. Two rows link when
    their sets of 5-word shingles have a Jaccard similarity of at least 0.75; a text of fewer
    words is one shingle. Null text and text without words has no shingle and links with nothing.
    Rows that repeat an id and a text share a class like other copies; of rows that repeat an id
    with other texts each is compared. A row without id gets a null component and links nothing
    else. An empty table gives an empty result. Other columns are ignored.
    """
    return classified(docs, Hashing.fresh(), id_col, text_col)[0].select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, of which each group keeps the smallest id's.

    Rows without shingles or id stay. Of rows that repeat that id within the group one stays.
    """
    groups, hashing = classified(docs, Hashing.fresh(), id_col, text_col)
    loses = groups.filter("n > 0 and _id <> component_id").select("_id", F.col("key").alias("_key")).distinct()
    keyed = append(docs.withColumns({"_own_id": F.col(id_col), "_bytes": F.col(text_col).cast("binary")}), ["_bytes"], "_n long, _key long, _second long", lambda: lambda t: _signature(t, hashing)).drop("_bytes", "_second")
    first = Window.partitionBy("_own_id", "_key").orderBy(F.lit(0))
    left = keyed.join(loses.withColumnRenamed("_id", "_own_id"), ["_own_id", "_key"], "left_anti").withColumn("_nth", F.row_number().over(first))
    return left.filter("_nth = 1 or _n = 0 or _own_id is null").select(*docs.columns)
