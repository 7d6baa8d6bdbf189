"""Bulk thesaurus lookups and word graphs."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexispark.functions.lineage import materialize

RELATIONS = {"1": "hypernym", "2": "hyponym", "11": "similar"}
TIERS = ("synonym", "hyponym", "hypernym", "similar")
DEFAULT_RARITY = "unusual"


def collocations(synsets: DataFrame, syntagms: DataFrame, lemmas: DataFrame, cap: int = 10) -> DataFrame:
    """``synset_id, partner, partner_synset_id``: the first ``cap`` distinct partner words in order, over edges of both directions."""
    one = syntagms.select(F.col("synset1id").alias("synset_id"), F.col("synset2id").alias("partner_synset_id"))
    edges = one.union(one.select("partner_synset_id", "synset_id"))
    # what stands after the first words of one partner cannot be among the first of all, so an edge carries no more
    lists = lemmas.groupBy(F.col("synset_id").alias("partner_synset_id")).agg(F.slice(F.array_sort(F.collect_set("lemma")), 1, cap).alias("_words"))
    met = edges.join(lists.hint("shuffle_hash"), "partner_synset_id").join(synsets.select("synset_id").hint("shuffle_hash"), "synset_id", "left_semi")
    words = met.select("synset_id", "partner_synset_id", F.explode("_words").alias("partner")).groupBy("synset_id", "partner").agg(F.min("partner_synset_id").alias("partner_synset_id"))
    return words.withColumn("_k", F.row_number().over(Window.partitionBy("synset_id").orderBy("partner"))).filter(F.col("_k") <= cap).drop("_k")


def lookup_synonyms(words: DataFrame, lemmas: DataFrame, relations: DataFrame, relation: str = "40") -> DataFrame:
    """``word, partner``: lemmas of the same synsets and of synsets linked by the relation, without the word."""
    mine = words.select(F.col("word").alias("lemma")).distinct().join(lemmas, "lemma").select(F.col("lemma").alias("word"), "synset_id")
    edges = relations.filter(F.col("relation_type") == relation).select(F.col("source_synset").alias("synset_id"), F.col("target_synset").alias("_to"))
    around = mine.union(mine.join(edges, "synset_id").select("word", F.col("_to").alias("synset_id"))).distinct()
    return around.join(lemmas, "synset_id").filter("lemma <> word").select("word", F.col("lemma").alias("partner")).distinct()


def lookup_senses(words: DataFrame, lemmas: DataFrame, synsets: DataFrame) -> DataFrame:
    """``word, synset_id, pos, definition, synonyms`` of each word's senses."""
    asked = words.select(F.lower(F.trim("word")).alias("word")).distinct()
    mine = asked.join(lemmas.withColumnRenamed("lemma", "word"), "word").join(synsets, "synset_id")
    others = lemmas.groupBy("synset_id").agg(F.array_sort(F.collect_set("lemma")).alias("_all"))
    return mine.join(others, "synset_id").select("word", "synset_id", "pos", "definition", F.array_remove("_all", F.col("word")).alias("synonyms"))


def lookup_relations(synsets: DataFrame, relations: DataFrame, lemmas: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """``synset_id, relation, partner_synset_id, partner``: one lemma per (synset, relation, target)."""
    types = RELATIONS if types is None else types
    edges = relations.filter(F.col("relation_type").isin(*types)).select(F.col("source_synset").alias("synset_id"), F.col("target_synset").alias("partner_synset_id"), F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[F.col("relation_type")].alias("relation")).distinct()
    first = lemmas.groupBy(F.col("synset_id").alias("partner_synset_id")).agg(F.min("lemma").alias("partner"))
    return edges.join(synsets.select("synset_id"), "synset_id", "left_semi").join(first, "partner_synset_id").select("synset_id", "relation", "partner_synset_id", "partner")


def attach_rarity(rows: DataFrame, frequencies: DataFrame, word_col: str = "word") -> DataFrame:
    known = frequencies.select(F.col("lemma").alias(word_col), "rarity")
    return rows.join(known, word_col, "left").withColumn("rarity", F.coalesce("rarity", F.lit(DEFAULT_RARITY)))


def attach_enrichment(senses: DataFrame, enrichment: DataFrame) -> DataFrame:
    return senses.join(enrichment.select("synset_id", "connotation", "register", "usage_example"), "synset_id", "left")


def full_senses(words: DataFrame, lemmas: DataFrame, synsets: DataFrame, relations: DataFrame, syntagms: DataFrame, frequencies: DataFrame, enrichment: DataFrame) -> DataFrame:
    """A row for each sense of each word with its enrichment and the lists ``synonyms``, ``related`` and ``collocations``."""
    senses = attach_enrichment(lookup_senses(words, lemmas, synsets), enrichment)
    ids = senses.select("synset_id").distinct()
    related = attach_rarity(lookup_relations(ids, relations, lemmas), frequencies, "partner").groupBy("synset_id").agg(F.array_sort(F.collect_list(F.struct("relation", "partner", "partner_synset_id", "rarity"))).alias("related"))
    near = collocations(ids, syntagms, lemmas).groupBy("synset_id").agg(F.array_sort(F.collect_list("partner")).alias("collocations"))
    return senses.join(related, "synset_id", "left").join(near, "synset_id", "left")


def lookup(words: DataFrame, lemmas: DataFrame, synsets: DataFrame, relations: DataFrame, syntagms: DataFrame, frequencies: DataFrame, enrichment: DataFrame) -> DataFrame:
    """One nested row per word: its rarity and its senses, ordered by part of speech and id. A word's senses are one value; :func:`full_senses` has them as rows."""
    full = full_senses(words, lemmas, synsets, relations, syntagms, frequencies, enrichment)
    nested = full.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("pos", "synset_id", "definition", "synonyms", "connotation", "register", "usage_example", "related", "collocations"))).alias("senses"))
    return attach_rarity(nested, frequencies)


def written_out(rows: DataFrame, order: list[str]) -> DataFrame:
    """``word, n_senses, senses_md5`` of ``rows`` (word, text and the columns of ``order``): how many rows a word has, and the digest of their texts in that order with bars between, nulls left out.

    The rows of a word stand together in a sorted partition and are digested as they come, so a task holds a
    batch of them and not all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n, begun, digest = None, 0, False, hashlib.md5()
        for b in batches:
            done = []
            for w, text in zip(b.column("word").to_pylist(), b.column("text").to_pylist(), strict=True):
                if w != word:
                    if n:
                        done.append((word, n, digest.hexdigest()))
                    word, n, begun, digest = w, 0, False, hashlib.md5()
                n += 1
                if text is not None:
                    digest.update((b"|" if begun else b"") + text.encode())
                    begun = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["word", "n_senses", "senses_md5"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (word, n, digest.hexdigest())], names=["word", "n_senses", "senses_md5"])

    stood = rows.repartition("word").sortWithinPartitions("word", *order).select("word", "text")
    return stood.mapInArrow(run, "word string, n_senses long, senses_md5 string")


def first_with_prefix(prefixes: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """``prefix, lemma``: for each distinct text of ``prefixes`` (prefix, _p) the first ``limit`` of ``words`` (lemma, _low) whose _low begins with _p, by _low, then lemma.

    The words are sorted into ranges, of which the first and last word are known. Words with a prefix
    stand together, so a prefix goes to the range where they begin and reads on only until ranges that lie
    wholly within have enough of them.
    """
    spark = words.sparkSession
    order = ["_low", "lemma"]
    ranged = materialize(words.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", *order), "sorted-words")
    bounds = sorted(((r.a.encode(), r.b.encode(), r["_part"], r.n) for r in ranged.groupBy("_part").agg(F.min("_low").alias("a"), F.max("_low").alias("b"), F.count(F.lit(1)).alias("n")).collect()), key=lambda r: r[:2])  # a row a range
    shared = spark.sparkContext.broadcast(bounds)
    lasts = spark.sparkContext.broadcast([b for _, b, _, _ in bounds])

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p in f["_p"]:
                key, had, parts = p.encode(), 0, []
                for a, b, part, n in shared.value[bisect_left(lasts.value, key) :]:
                    if had >= limit or not (a.startswith(key) or a < key):
                        break
                    parts.append(part)
                    had += n if a.startswith(key) and b.startswith(key) else 0
                out.append(parts)
            yield f.assign(_parts=out)

    def look(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        lows = [x.encode() for x in held["_low"]]
        by = sorted(range(len(lows)), key=lambda k: (lows[k], held["lemma"].iat[k].encode()))
        lows, lemmas = [lows[k] for k in by], [held["lemma"].iat[k] for k in by]
        found = []
        for prefix, p in zip(asked["prefix"], asked["_p"], strict=True):
            at = bisect_left(lows, p.encode())
            for k in range(at, min(at + limit, len(lows))):
                if not lows[k].startswith(p.encode()):
                    break
                found.append((prefix, lows[k].decode(), lemmas[k]))
        return pd.DataFrame(found, columns=["prefix", "_low", "lemma"])

    sent = prefixes.select("prefix", "_p").mapInPandas(places, "prefix string, _p string, _parts array<int>").withColumn("_part", F.explode("_parts")).drop("_parts")
    hits = sent.groupBy("_part").cogroup(ranged.groupBy("_part")).applyInPandas(look, "prefix string, _low string, lemma string")
    first = Window.partitionBy("prefix").orderBy(*order)
    return hits.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= limit).select("prefix", "lemma")


def autocomplete(prefixes: DataFrame, lemmas: DataFrame, synsets: DataFrame, frequencies: DataFrame, curated: DataFrame, limit: int = 10, shortest: int = 2) -> DataFrame:
    """``prefix, word, definition, sense_count, rarity``: the first words with each literal prefix (prefix), alphabetical, whatever the case; see :func:`first_with_prefix`."""
    asked = prefixes.select("prefix", F.lower("prefix").alias("_p")).filter(F.length("prefix") >= shortest).distinct()
    words = lemmas.filter("lemma is not null").select("lemma", F.lower("lemma").alias("_low")).distinct()
    top = first_with_prefix(asked, words, min(limit, 50))
    has = curated.select("synset_id").distinct().withColumn("_has", F.lit(0))
    sense = lemmas.join(top.select("lemma").distinct(), "lemma", "left_semi").join(synsets, "synset_id").join(has, "synset_id", "left").groupBy("lemma").agg(F.min(F.struct(F.coalesce("_has", F.lit(1)).alias("h"), "synset_id", "definition")).alias("s"), F.countDistinct("synset_id").alias("sense_count"))
    return attach_rarity(top.join(sense, "lemma").select("prefix", F.col("lemma").alias("word"), "s.definition", "sense_count"), frequencies)


def _tier(c: str):
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col(c))


def related_words(words: DataFrame, lemmas: DataFrame, synsets: DataFrame, relations: DataFrame) -> DataFrame:
    """``word, node_id, synset_id, relation_type`` of all synonyms and related words, in long form."""
    senses = lookup_senses(words, lemmas, synsets)
    syn = senses.select("word", "synset_id", F.explode("synonyms").alias("node_id"), F.lit("synonym").alias("relation_type"))
    rel = senses.select("word", "synset_id").join(lookup_relations(senses.select("synset_id").distinct(), relations, lemmas), "synset_id").select("word", F.col("partner_synset_id").alias("synset_id"), F.col("partner").alias("node_id"), F.col("relation").alias("relation_type"))
    return syn.select("word", "node_id", "synset_id", "relation_type").unionByName(rel.select("word", "node_id", "synset_id", "relation_type"))


def first_related(related: DataFrame) -> DataFrame:
    """One row for each (word, node_id) of ``related``, that of its first tier and synset, written once: graphs and their expansions need no other."""
    best = related.groupBy("word", "node_id").agg(F.min(F.struct(_tier("relation_type").alias("t"), "synset_id", "relation_type")).alias("m"))
    return materialize(best.select("word", "node_id", "m.synset_id", "m.relation_type"), "related")


def word_graph(related: DataFrame, most: int = 80) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of each word: the word itself and related words, one node per word in its first tier, at most ``most``. ``val`` is a node's size.

    Where nodes and links are both used, or expanded, pass the rows through :func:`first_related` before.
    """
    first = related.filter("node_id <> word").groupBy("word", "node_id").agg(F.min(F.struct(_tier("relation_type").alias("t"), "synset_id", "relation_type")).alias("m")).select("word", "node_id", "m.t", "m.synset_id", "m.relation_type")
    kept = first.withColumn("_k", F.row_number().over(Window.partitionBy("word").orderBy("t", "node_id"))).filter(F.col("_k") < most)
    centre = related.select("word").distinct().select("word", F.col("word").alias("node_id"), F.lit(None).cast("string").alias("synset_id"), F.lit("central").alias("relation_type"), F.lit(8).alias("val"), F.lit(0).alias("node_order"))
    size = F.when(F.col("relation_type") == "synonym", 4).otherwise(2)
    nodes = centre.unionByName(kept.select("word", "node_id", "synset_id", "relation_type", size.alias("val"), F.lit(1).alias("node_order")))
    return nodes, kept.select("word", F.col("word").alias("source"), F.col("node_id").alias("target"), "relation_type", F.lit(1).alias("link_order"))


def expand_graph(nodes: DataFrame, links: DataFrame, selected: DataFrame, related: DataFrame, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """The graph with second-order words of the selected node (word, selected): known words get a link, new ones node and link, until ``most`` are new."""
    around = selected.join(related.withColumnRenamed("word", "selected"), "selected").filter("node_id <> selected")
    first = around.groupBy("word", "selected", "node_id").agg(F.min(F.struct(_tier("relation_type").alias("t"), "synset_id", "relation_type")).alias("m")).select("word", "selected", "node_id", "m.t", "m.synset_id", "m.relation_type")
    known = nodes.select("word", "node_id", F.lit(True).alias("_known"))
    flagged = first.join(known, ["word", "node_id"], "left").withColumn("_new", F.col("_known").isNull().cast("int"))
    before = Window.partitionBy("word", "selected").orderBy("t", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    used = flagged.withColumn("_n", F.coalesce(F.sum("_new").over(before), F.lit(0))).filter(F.col("_n") < most)
    fresh = used.filter("_new = 1").select("word", "node_id", "synset_id", "relation_type", F.lit(1).alias("val"), F.lit(2).alias("node_order"))
    return nodes.unionByName(fresh), links.unionByName(used.select("word", F.col("selected").alias("source"), F.col("node_id").alias("target"), "relation_type", F.lit(2).alias("link_order")))


def with_rarity(nodes: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The nodes with the ``rarity`` of their word, null where it is not known."""
    return nodes.join(frequencies.select(F.col("lemma").alias("node_id"), "rarity"), "node_id", "left")


def strip_second_order(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = nodes.filter("node_order = 2").select("word", "node_id")
    end = lambda c: gone.withColumnRenamed("node_id", c)
    return nodes.filter("node_order < 2"), links.join(end("source"), ["word", "source"], "left_anti").join(end("target"), ["word", "target"], "left_anti").select(*links.columns)


def cross_links(nodes: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``word, a, b``: first-order nodes of a graph that share a synset."""
    inside = nodes.filter("node_order = 1").select("word", "node_id")
    known = lemmas.join(inside.select(F.col("node_id").alias("lemma")).distinct(), "lemma", "left_semi")
    # words of a common synset are found once, not for each graph that has them
    near = known.select("synset_id", F.col("lemma").alias("a")).join(known.select("synset_id", F.col("lemma").alias("b")), "synset_id").filter("a < b").select("a", "b").distinct()
    return inside.withColumnRenamed("node_id", "a").join(near, "a").join(inside.withColumnRenamed("node_id", "b"), ["word", "b"]).select("word", "a", "b").distinct()


def rarity_filter(nodes: DataFrame, hidden: list[str]) -> DataFrame:
    return nodes.filter(~F.coalesce("rarity", F.lit(DEFAULT_RARITY)).isin(hidden))
