"""Source divergence audit: which terms set a source apart within its language, and how far sources are from each other.

Every number is whole and exact. A term's rank within a group follows its divergence f, which grows
with the term's count in the group and falls with its count in the language. So a term that k others
dominate (count in the group at least as high, count in the language at most as high, earlier in UTF-8)
is never among the first k: partitions keep their dominance skyband, skybands are merged, and only the
merged ones are ranked.

Distances of sources need each term that two sources share once. They are summed in map tasks from one
row for each term, which lists the sources that have it; what a term adds where a source lacks it comes
from the sources' histograms of p and not from rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexispark.functions.lineage import materialize
from lexispark.llm.arrays import changes, ranges
from lexispark.llm.text import ascii_lower, slices

#: Matches of one term; the text's A-Z are lower case by then.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A term belongs to a language if it stands in so many of its documents.
MIN_DOCS = 3
#: Ranks of terms that are reported for each group.
TOP = 200
SCALE = 1_000_000_000
#: Distinct (group, term) of a map task that are held before they are sent on.
HELD = 1 << 18
#: Rows that a task holds before it thins them to their skybands, and that may be left before it sends them on.
THIN, MOST = 1 << 18, 1 << 17
#: Values of f that are worked out at once.
CELLS = 1 << 18
#: Counts under this are worked on as 64-bit numbers.
SAFE = 9_000_000_000


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, n_docs``: occurrences and documents of each term in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def held() -> pa.RecordBatch:
            parts = [[pa.repeat(pa.scalar(lang), len(seen)), pa.repeat(pa.scalar(source), len(seen)), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array(list(map(in_docs.__getitem__, seen)), pa.int64())] for (lang, source), (seen, in_docs) in count.items() if seen]
            count.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)] or [pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())], names=["lang", "source", "term", "n", "n_docs"])

        for b in (part for whole in batches for part in slices(whole)):
            for lang, source, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                terms = TERM.findall(text)
                seen, in_docs = count.setdefault((lang, source), (Counter(), Counter()))
                seen.update(terms)
                in_docs.update(set(terms))
            if sum(len(s) for s, _ in count.values()) > HELD:
                yield held()
        yield held()

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), ascii_lower(plain(text_col)).alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, n_docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def smoothed(n: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(SCALE * (n + 1) / (total + terms)), exact for any counts."""
    wide = lambda c: c.cast("decimal(20,0)")
    ratio = lambda a, b: F.call_function("div", a * F.lit(SCALE), b)
    return F.when(n < SAFE, ratio((n + 1).cast("long"), total + terms)).otherwise(ratio(wide(n + 1), wide(total + terms))) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def thinned(n: np.ndarray, total: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that fewer than ``k`` others dominate: ``n`` as high, ``total`` as low, ``place`` lower.

    Rows are taken so that what dominates comes first. Counting the dominating rows among those kept is
    enough: of the rows that dominate another, the first k are kept themselves.
    """
    order = np.lexsort((place, total, -n))
    total, place = total[order], place[order]
    kept_total, kept_place, kept = np.zeros(0, dtype=total.dtype), np.zeros(0, dtype=place.dtype), []
    step = max(k, 256)
    for at in range(0, len(order), step):
        t, p = total[at : at + step], place[at : at + step]
        before = np.concatenate([kept_total, t]), np.concatenate([kept_place, p])
        over = (before[0][None, :] <= t[:, None]) & (before[1][None, :] < p[:, None])
        own = len(kept_total) + np.arange(len(t))
        over[np.arange(len(before[0]))[None, :] >= own[:, None]] = False
        good = over.sum(axis=1) < k
        kept.append(order[at : at + step][good])
        kept_total, kept_place = np.concatenate([kept_total, t[good]]), np.concatenate([kept_place, p[good]])
    return np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)


def skyband(entries: DataFrame, k: int) -> DataFrame:
    """The rows ``lang, source, term, n, n_lang, f`` of each partition that fewer than ``k`` rows of their group in it dominate."""
    names = ["lang", "source", "term", "n", "n_lang", "f"]

    def thin(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("lang", "ascending"), ("source", "ascending"), ("n", "descending"), ("n_lang", "ascending"), ("term", "ascending")])
        n, total = rows["n"].to_numpy(), rows["n_lang"].to_numpy()
        code = lambda c: rows[c].combine_chunks().dictionary_encode().indices.to_numpy()
        fresh = changes(code("lang"), code("source"))
        start = np.flatnonzero(changes(np.cumsum(fresh), n, total))  # of equal counts the first k terms are enough
        first = np.arange(len(n)) - np.repeat(start, np.diff(np.append(start, len(n)))) < k
        rows, n, total, group = rows.filter(pa.array(first)), n[first], total[first], np.cumsum(fresh)[first]
        place = np.empty(len(n), dtype=np.int64)
        place[pc.sort_indices(rows["term"]).to_numpy()] = np.arange(len(n))
        starts = np.flatnonzero(changes(group))
        kept = [at + thinned(n[at:to], total[at:to], place[at:to], k) for at, to in zip(starts, np.append(starts[1:], len(n)), strict=True)]
        return rows.take(pa.array(np.concatenate(kept))) if kept else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]).select(names))
            if sum(t.num_rows for t in held) > THIN:
                held = [thin(pa.concat_tables(held))]
                if held[0].num_rows > MOST:
                    yield from held.pop().to_batches()
        if held:
            yield from thin(pa.concat_tables(held)).to_batches()

    return entries.select(names).mapInArrow(run, "lang string, source string, term string, n long, n_lang long, f long")


def shared_terms(entries: DataFrame) -> DataFrame:
    """``lang, a, b, value``: over the terms that sources a and b share, the sum of f(p_a, p_b) - f(p_a, r_b) - f(r_a, p_b) + f(r_a, r_b).

    r is a source's p for a term that it lacks. One row for each term lists its sources, at most those of
    the language; a task adds up all terms of its partition before it sends a row for each pair.
    """
    f = lambda x, y: (x[:, :, None] - y[:, None, :]) ** 2 // y[:, None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[dict[str, int], np.ndarray]] = {}
        for b in batches:
            found, length = b.column(1).flatten(), b.column(1).value_lengths().to_numpy()
            names, (p, rest) = found.field("source").dictionary_encode(), (found.field(c).to_numpy() for c in ("p", "rest"))
            langs, start = b.column(0).dictionary_encode(), np.cumsum(length) - length
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                number, sums = total.get(lang) or ({}, np.zeros((0, 0), dtype=np.int64))
                mine = np.flatnonzero(langs.indices.to_numpy() == k)
                at = ranges(start[mine], length[mine])
                here = names.dictionary.to_pylist()
                place = np.zeros(len(here), dtype=np.int64)
                for s in np.unique(names.indices.to_numpy()[at]).tolist():
                    place[s] = number.setdefault(here[s], len(number))
                if len(number) > len(sums):
                    grown = np.zeros((2 * len(number), 2 * len(number)), dtype=np.int64)
                    grown[: len(sums), : len(sums)] = sums
                    sums = grown
                total[lang] = number, sums
                for m in np.unique(length[mine]).tolist():  # terms of as many sources together
                    rows, step = mine[length[mine] == m], max(1, CELLS // m**2)
                    for k0 in range(0, len(rows), step):
                        take = start[rows[k0 : k0 + step], None] + np.arange(m)
                        x, r, i = p[take], rest[take], place[names.indices.to_numpy()[take]]
                        np.add.at(sums, (i[:, :, None], i[:, None, :]), f(x, x) - f(x, r) - f(r, x) + f(r, r))
        rows = [(lang, a, b, int(sums[i, j])) for lang, (number, sums) in total.items() for a, i in number.items() for b, j in number.items() if i != j and sums[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "a", "b", "value"])

    lists = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "rest")).alias("found")).filter(F.size("found") > 1)
    parts = lists.select("lang", "found").mapInArrow(run, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group its distance to every other source of the
    language (part ``pair``) and its ``top`` most divergent terms (part ``term``).

    Null text, lang and source count as ''. Groups without terms are reported too: against them, and for
    a language without kept terms, values are those of the smoothed p, 0 if no term is kept. Repeated rows
    are documents of their own. Equal values go by the item's UTF-8. A language with one source has no
    ``pair`` rows, an empty table no rows. Other columns of ``docs`` play no part. Sums of f stay within 64
    bits up to 10^9 kept terms of a language.
    """
    counted = materialize(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = materialize(kept.select("lang", "term", "n_lang"), "divergence-terms")
    entries = materialize(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "divergence-entries")

    # a row for each group and each language: N and V of all of them
    plain = lambda c, a: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
    every = docs.select(plain(lang_col, "lang"), plain(source_col, "source")).distinct()
    counts = materialize(entries.groupBy("lang", "source", "n").agg(F.count("*").alias("m")), "divergence-levels")  # how many terms of a group occur n times
    own = counts.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("own"), F.sum("m").alias("own_terms"))
    whole = kept.groupBy("lang").agg(F.sum("n_lang").alias("total"), F.count("*").alias("terms"))
    zero = {"own": 0, "own_terms": 0, "total": 0, "terms": 0}
    groups = every.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(zero)
    groups = materialize(groups.withColumn("rest", F.when(F.col("terms") > 0, smoothed(F.lit(0), F.col("own"), F.col("terms"))).otherwise(F.lit(1))), "divergence-groups")

    p, q = smoothed(F.col("n"), F.col("own"), F.col("terms")), smoothed(F.col("n_lang"), F.col("total"), F.col("terms"))
    full = entries.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "n_lang", p.alias("p"), q.alias("q"), "rest", "terms")

    above = full.filter("p > q").withColumn("f", divergence(F.col("p"), F.col("q")))
    # partitions' skybands meet by group and a part of the terms' hashes, then what is left is ranked
    merged = skyband(skyband(above, top).repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(16))), top)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = merged.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    # value of a pair: the terms of a against b without them, those of b against a without them, all others, and what shared terms change
    pairs = groups.alias("a").join(groups.select("lang", F.col("source").alias("item"), F.col("rest").alias("rest_b"), F.col("own_terms").alias("terms_b")).alias("b"), "lang").filter("source <> item")
    levels = counts.join(groups, ["lang", "source"]).select("lang", "source", p.alias("p"), "m")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    first = levels.join(pairs.select("lang", "source", "item", "rest_b"), ["lang", "source"]).groupBy("lang", "source", "item").agg(wide(F.col("m") * divergence(F.col("p"), F.col("rest_b"))).alias("x"))
    second = levels.withColumnRenamed("source", "item").join(pairs.select("lang", "source", "item", "rest"), ["lang", "item"]).groupBy("lang", "source", "item").agg(wide(F.col("m") * divergence(F.col("rest"), F.col("p"))).alias("x"))
    both = shared_terms(full).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.col("value").alias("x"))
    other = pairs.select("lang", "source", "item", ((F.col("terms") - F.col("own_terms") - F.col("terms_b")) * divergence(F.col("rest"), F.col("rest_b"))).cast("decimal(38,0)").alias("x"))
    value = first.unionByName(second).unionByName(both).unionByName(other).groupBy("lang", "source", "item").agg(F.sum("x").cast("long").alias("value"))
    distances = value.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return distances.unionByName(terms)
