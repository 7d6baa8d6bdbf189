"""The curated vocabulary: polysemy, familiarity, claiming of lemmas, antonyms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lexispark.functions.lineage import materialize
from lexispark.operators.components import connected_components


def lemma_polysemy(lemmas: DataFrame, distinct: bool = False) -> DataFrame:
    """``lemma, polysemy``: in how many synsets a lemma is. With ``distinct`` no row of ``lemmas`` is there twice, so rows are counted and pairs are not shuffled."""
    return lemmas.groupBy("lemma").agg((F.count if distinct else F.countDistinct)("synset_id").alias("polysemy"))


def synset_familiarity(lemmas: DataFrame, frequencies: DataFrame) -> DataFrame:
    joined = lemmas.join(frequencies.select("lemma", "familiarity"), "lemma", "left")
    return joined.groupBy("synset_id").agg(F.max(F.coalesce("familiarity", F.lit(0.0))).alias("max_familiarity"))


#: Parts to which components of claims are dealt.
PARTS = 256


def claimed(rows: pd.DataFrame) -> pd.DataFrame:
    """``vocab_id, lemma, polysemy, is_shared`` of synsets that claim in the order of vocab_id from their lists (vocab_id, lemma, polysemy, k)."""
    taken: set[str] = set()
    out = []
    rows = rows.sort_values(["vocab_id", "k"])
    for vocab_id, mine in rows.groupby("vocab_id", sort=False):
        free = next((k for k, lemma in enumerate(mine["lemma"]) if lemma not in taken), None)
        pick = mine.iloc[0 if free is None else free]
        if free is not None:
            taken.add(pick["lemma"])
        out.append((vocab_id, pick["lemma"], pick["polysemy"], free is None))
    return pd.DataFrame(out, columns=["vocab_id", "lemma", "polysemy", "is_shared"])


def build_vocabulary(synsets: DataFrame, lemmas: DataFrame, frequencies: DataFrame, top_n: int = 35_000, distinct: bool = False) -> DataFrame:
    """``vocab_id, synset_id, lemma, pos, polysemy, is_shared``: each of the ``top_n`` most familiar synsets with its best unclaimed lemma.

    Synsets claim in rank order. A synset never goes past the first lemma that no other has, nor past as
    many lemmas as its rank, so lists end there. Synsets that want a common lemma are connected, and what
    is not connected claims independently: components of claims are dealt to tasks, where they claim one
    by one. The largest has at most ``top_n`` synsets. A synset without lemma left shares its first one. For
    ``distinct`` see :func:`lemma_polysemy`.
    """
    fam = synset_familiarity(lemmas, frequencies)
    best = synsets.select("synset_id", "pos").join(fam, "synset_id").orderBy(F.desc("max_familiarity"), "synset_id").limit(top_n)
    ranked = materialize(best.withColumn("vocab_id", F.row_number().over(Window.orderBy(F.desc("max_familiarity"), "synset_id"))), "ranked")  # top_n rows
    polysemy = materialize(lemma_polysemy(lemmas, distinct), "polysemy")
    cand = lemmas.join(ranked.select("synset_id", "vocab_id"), "synset_id").distinct().join(polysemy, "lemma")
    order = Window.partitionBy("vocab_id").orderBy("polysemy", F.length("lemma"), "lemma")
    cand = materialize(cand.select("vocab_id", "lemma", "polysemy", F.row_number().over(order).alias("k")).filter(F.col("k") <= F.col("vocab_id")), "candidates")
    wanted = cand.groupBy("lemma").agg(F.count(F.lit(1)).alias("_n"), F.min("vocab_id").alias("_first"))
    sure = F.min(F.when(F.col("_n") == 1, F.col("k"))).over(Window.partitionBy("vocab_id"))
    lists = materialize(cand.join(wanted, "lemma").withColumn("_sure", sure).filter("_sure is null or k <= _sure"), "lists")
    alone = lists.filter("k = 1 and _sure = 1")
    rest = lists.filter("_sure is null or _sure > 1")
    together = connected_components(rest.select(F.col("vocab_id").alias("a"), F.when(F.col("_n") > 1, F.col("_first")).otherwise(F.col("vocab_id")).alias("b")))
    dealt = rest.join(together.withColumnRenamed("node", "vocab_id"), "vocab_id").withColumn("_part", F.pmod(F.xxhash64("component"), F.lit(PARTS)))
    own = dealt.select("_part", "vocab_id", "lemma", "polysemy", "k").groupBy("_part").applyInPandas(lambda rows: claimed(rows), "vocab_id int, lemma string, polysemy long, is_shared boolean")
    every = own.unionByName(alone.select("vocab_id", "lemma", "polysemy", F.lit(False).alias("is_shared")))
    return ranked.join(every, "vocab_id").select("vocab_id", "synset_id", "lemma", "pos", "polysemy", "is_shared")


def embedding_lookup(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """``word, embedding`` of the distinct words that have a vector (lemma, embedding)."""
    return words.select("word").distinct().join(vectors.select(F.col("lemma").alias("word"), "embedding"), "word")


def attach_lemma_embeddings(lemmas: DataFrame, vectors: DataFrame) -> DataFrame:
    return lemmas.select("lemma").distinct().join(vectors, "lemma")


def both_ways(pairs: DataFrame) -> DataFrame:
    low = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return low.union(low.select(F.col("b").alias("a"), F.col("a").alias("b")))


#: Members of an attribute that meet in one cell.
HUB = 512


def antonym_pairs(relations: DataFrame, vocab: DataFrame, relation: str = "60", hub: int = HUB) -> DataFrame:
    """``a, b`` of vocabulary entries under a common attribute, both ways. Entries outside the vocabulary go before the join."""
    known = vocab.select(F.col("synset_id").alias("source_synset"), "vocab_id")
    members = relations.filter(F.col("relation_type") == relation).join(known, "source_synset").select("target_synset", "vocab_id").distinct()
    return both_ways(pairs_of_groups(materialize(members, "members"), "target_synset", "vocab_id", hub))


def pairs_of_groups(members: DataFrame, group: str, member: str, hub: int = HUB) -> DataFrame:
    """``a, b`` of every unordered pair of distinct members of a group, once for each group.

    Members of a group are dealt to parts of about ``hub``; two parts meet in one cell of a triangular grid,
    so no task has more than a cell at a time, however large a group is.
    """
    parts = members.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / hub)).cast("int").alias("_parts"))
    dealt = members.join(parts, group).withColumn("_part", F.pmod(F.xxhash64(member), "_parts").cast("int"))
    left = dealt.select(group, F.col(member).alias("a"), F.col("_part").alias("_i"), F.explode(F.sequence("_part", F.col("_parts") - 1)).alias("_j"))
    right = dealt.select(group, F.col(member).alias("b"), F.explode(F.sequence(F.lit(0), "_part")).alias("_i"), F.col("_part").alias("_j"))
    met = left.join(right, [group, "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("a") < F.col("b")))
    return met.select("a", "b")


def cluster_antonyms(antonyms: DataFrame, clusters: DataFrame) -> DataFrame:
    """Antonyms lifted to clusters; an entry without cluster stands for itself, pairs within a cluster go."""
    side = lambda c: clusters.select(F.col("vocab_id").alias(c), F.col("cluster_id").alias(f"_{c}"))
    lifted = antonyms.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    return both_ways(lifted.filter("a <> b"))
