"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the 10-word windows of the benchmark items. Per pattern length, a shift table of
two-word blocks says how far the search may jump; where a block allows no jump it is the suffix of
some window, its bucket lists them by their first word, and direct comparison of all words decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from lexispark.functions.lineage import materialize
from lexispark.llm.text import append

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Bytes of benchmark text that are searched for, and so broadcast, at once.
BLOCK_BYTES = 8 << 20

HITS = "array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(UPPER)) if text else []


class WuManber:
    """Tables for patterns of one length, each a tuple of words with the items that hold it."""

    def __init__(self, patterns: dict[tuple[str, ...], set[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], dict[str, list[tuple[tuple[str, ...], tuple[str, ...]]]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.buckets.setdefault(p[-self.block :], {}).setdefault(p[0], []).append((p, tuple(items)))

    def search(self, words: list[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(first word's position, items) of every occurrence, in ascending order."""
        m, block, shift, jump, at = self.length, self.block, self.shift, self.jump, self.length
        while at <= len(words):
            key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            for p, items in self.buckets[key].get(words[at - m], ()):
                if tuple(words[at - m : at]) == p:
                    yield at - m, items
            at += 1


def build(items: list[tuple[str, str]], window: int) -> list[WuManber]:
    """One searcher per pattern length; items shorter than the window are one pattern."""
    by_length: dict[int, dict[tuple[str, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[k : k + m]), set()).add(item)
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def found_in(texts: list[str | None], tables: list[WuManber]) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """Number of words, merged spans and sorted items of each text."""
    counts, hits, items = [], [], []
    for text in texts:
        words, spans, ids = words_of(text), [], set()
        for t in tables:
            for start, of in t.search(words):
                spans.append((start, start + t.length))
                ids.update(of)
        counts.append(len(words))
        hits.append([{"start": a, "end": b} for a, b in merged(spans)])
        items.append(sorted(ids))
    return counts, hits, items


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def hits_by_text(docs: DataFrame, items: DataFrame, blocks: int, window: int, text_col: str) -> DataFrame:
    """``_text, hits, items`` of the texts in which something occurs, by SHA-256.

    Each block of items is one pass over the texts that writes the hits of that block; its tables go
    before the next block's are built. Then the blocks' hits of a text are put together.
    """
    spark, found = docs.sparkSession, None
    texts = docs.select(docs[text_col].alias("_t"), text_key(docs[text_col]).alias("_text"))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()  # at most about block_bytes
        tables = spark.sparkContext.broadcast(build([(r["i"], r["t"]) for r in part], window))
        searched = append(texts, ["_t"], f"n_words long, hits {HITS}, items array<string>", lambda tables=tables: lambda t: found_in(t, tables.value))
        one = materialize(searched.filter(F.size("hits") > 0).select("_text", "hits", "items"), "benchmark-hits")
        found = one if found is None else found.unionByName(one)
        tables.destroy()

    def together(hits: list[list], ids: list[list]) -> tuple[list, list]:
        spans = [merged([(h["start"], h["end"]) for h in x]) for x in hits]
        return [[{"start": a, "end": b} for a, b in x] for x in spans], [sorted(set(x)) for x in ids]

    # copies of a text have the same hits in a block; blocks differ
    every = found.groupBy("_text").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.flatten(F.collect_set("items")).alias("items"))
    return materialize(append(every, ["hits", "items"], f"hits {HITS}, items array<string>", lambda: together), "benchmark-hits")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (merged word spans, end exclusive) and ``items`` (sorted ids as strings).

    A span is hit when a window of an item occurs there; an item of fewer words than ``window``, but
    not none, is one window. Null text, of documents or items, has no words. A null item id is "".
    Items that repeat an id count once. Columns of ``docs`` named like the results are replaced, all
    others kept; repeated rows each get their result. An empty benchmark hits nothing.

    A benchmark of at most ``block_bytes`` is searched for in one pass in which no row is shuffled.
    A larger one is cut into blocks of about that size, each searched for in a pass of its own that
    writes its hits (:func:`hits_by_text`); these are joined to the documents at last. So what is
    broadcast is one block, and a text is split into words once for each block.
    """
    items = benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("")).alias("i"), benchmark[item_text].cast("string").alias("t")).filter("t is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    if blocks == 1:
        tables = docs.sparkSession.sparkContext.broadcast(build([(r["i"], r["t"]) for r in items.collect()], window))
        return append(docs, [text_col], f"n_words long, hits {HITS}, items array<string>", lambda: lambda t: found_in(t, tables.value))
    found = hits_by_text(docs, items, blocks, window, text_col)
    counted = append(docs.drop("hits", "items"), [text_col], "n_words long", lambda: lambda t: [[len(words_of(x)) for x in t]])
    joined = counted.withColumn("_text", text_key(F.col(text_col))).join(found, "_text", "left").drop("_text")
    return joined.withColumns({"hits": F.coalesce("hits", F.array().cast(HITS)), "items": F.coalesce("items", F.array().cast("array<string>"))})


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their own columns, in which no window of the benchmark occurs."""
    keep = docs.columns
    tagged = docs.withColumnsRenamed({c: f"_own_{c}" for c in ("n_words", "hits", "items") if c in keep})
    clean = find_benchmark(tagged, benchmark, **options).filter(F.size("hits") == 0).drop("n_words", "hits", "items")
    return clean.withColumnsRenamed({f"_own_{c}": c for c in ("n_words", "hits", "items") if c in keep}).select(*keep)


def contamination_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated`` from :func:`find_benchmark`."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + (h["end"] - h["start"]).cast("long"))
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
