"""Vector similarity: pairs above a threshold, clusters, nearest entries and snapping."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from lexispark.functions.lineage import materialize
from lexispark.functions.text import morph_variants, normalise_text
from lexispark.operators import cells
from lexispark.operators.cells import BLOCK, pairs_within

METHODS = ("exact", "morphological", "embedding")


def similar_pairs(vectors: DataFrame, threshold: float = 0.8, id_col: str = "id", block: int = BLOCK) -> DataFrame:
    """``a, b, similarity`` of every pair a < b with at least the threshold, exactly; see :func:`lexispark.operators.cells.pairs_within`."""
    return pairs_within(vectors, threshold, id_col, block)[0]


def similar_pairs_lsh(vectors: DataFrame, threshold: float = 0.8, id_col: str = "id", tables: int = 8, bucket: float = 0.5, seed: int = 42) -> DataFrame:
    """As :func:`similar_pairs` by locality-sensitive hashing, for numbers of vectors whose blocks are too many.

    Pairs that share no bucket in any of the ``tables`` are missed; those found are exact. On unit vectors a
    cosine of t is a distance of sqrt(2 - 2t). Zero vectors have no partners.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = vectors.filter(F.size("embedding") > 0).select(F.col(id_col).cast("long").alias("id"), "embedding", norm.alias("_n")).filter("id is not null and _n > 0")
    units = rows.select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0))).alias("v"))
    if units.isEmpty():
        return units.sparkSession.createDataFrame([], "a long, b long, similarity double")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=bucket, seed=seed).fit(units)
    near = model.approxSimilarityJoin(units, units, max(0.0, 2 - 2 * threshold) ** 0.5 + 1e-9, "_d").filter("datasetA.id < datasetB.id")
    cosine = F.least(F.lit(1.0), 1 - F.col("_d") * F.col("_d") / 2)
    return near.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), cosine.alias("similarity"))


def cluster_vocab(vocab: DataFrame, vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``vocab_id, cluster_id, is_representative, is_singleton``: components of the similar pairs, named by their smallest member."""
    known = vocab.select("vocab_id", "lemma").join(vectors, "lemma").select("vocab_id", "embedding")
    inside = cells.linked_within(known, threshold, "vocab_id")[0].select(F.col("node").alias("vocab_id"), F.col("component").alias("cluster_id"))
    out = vocab.select("vocab_id").distinct().join(inside, "vocab_id", "left")
    return out.select("vocab_id", F.coalesce("cluster_id", "vocab_id").alias("cluster_id"), F.coalesce(F.col("cluster_id") == F.col("vocab_id"), F.lit(True)).alias("is_representative"), F.col("cluster_id").isNull().alias("is_singleton"))


def cluster_stats(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("k"))
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("k") == 1).alias("singletons"), F.coalesce(F.max("k"), F.lit(0)).alias("largest"))


def nearest(queries: DataFrame, base: DataFrame, block: int = BLOCK) -> DataFrame:
    """``query_id, base_id, score``: the entry of ``base`` (base_id, embedding) with the highest cosine for each of ``queries`` (query_id, embedding); lowest id on ties."""
    found, _ = cells.nearest(queries, base, 1, True, block)
    return found.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "base_id", "score")).alias("m")).select("query_id", "m.base_id", "m.score")


def snap_exact(links: DataFrame, vocab: DataFrame) -> DataFrame:
    lowest = vocab.groupBy(F.lower("lemma").alias("_t")).agg(F.min("vocab_id").alias("vocab_id"))
    return links.withColumn("_t", normalise_text(F.col("text"))).join(lowest, "_t").drop("_t").withColumns({"snap_method": F.lit("exact"), "snap_score": F.lit(None).cast("double")})


def snap_morphological(residue: DataFrame, vocab: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    lowest = vocab.groupBy(F.lower("lemma").alias("variant")).agg(F.min("vocab_id").alias("vocab_id"))
    words = residue.select(normalise_text(F.col("text")).alias("word")).distinct()
    hit = morph_variants(words, forms).join(lowest, "variant").groupBy("word").agg(F.min(F.struct("variant_no", "vocab_id")).alias("m")).select("word", "m.vocab_id")
    return residue.withColumn("word", normalise_text(F.col("text"))).join(hit, "word").drop("word").withColumns({"snap_method": F.lit("morphological"), "snap_score": F.lit(None).cast("double")})


def snap_embedding(residue: DataFrame, properties: DataFrame, vocab: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Links of the residue to the nearest vocabulary entry with a vector, if near enough. Each property is compared once."""
    vec = properties.filter("embedding is not null").select("property_id", F.col("text").alias("_t"), "embedding")
    base = vocab.select(F.col("vocab_id").alias("base_id"), F.lower("lemma").alias("_t")).join(vec, "_t").select("base_id", "embedding")
    asked = residue.select("property_id").distinct().join(vec, "property_id").filter(F.exists("embedding", lambda x: x != 0)).select(F.col("property_id").alias("query_id"), "embedding")
    found = nearest(asked, base).filter(F.col("score") >= threshold).select(F.col("query_id").alias("property_id"), F.col("base_id").alias("vocab_id"), F.col("score").alias("snap_score"))
    return residue.join(found, "property_id").withColumn("snap_method", F.lit("embedding"))


def snap_links(links: DataFrame, properties: DataFrame, vocab: DataFrame, threshold: float = 0.7, forms: DataFrame | None = None) -> DataFrame:
    """Every link (synset_id, property_id, text, salience) that snaps, with vocab_id, method and score: exact, else morphological, else embedding."""
    found = ["property_id", "text", "vocab_id", "snap_method", "snap_score"]
    links = materialize(links.select("synset_id", "property_id", "text", "salience"), "links")
    each = materialize(links.select("property_id", "text").distinct(), "linked-properties")  # a property is snapped once, whatever its links
    a = snap_exact(each, vocab).select(found)
    rest = each.join(a.select("property_id"), "property_id", "left_anti")
    b = snap_morphological(rest, vocab, forms).select(found)
    rest = rest.join(b.select("property_id"), "property_id", "left_anti")
    hits = materialize(a.unionByName(b).unionByName(snap_embedding(rest, properties, vocab, threshold).select(found)), "hits")
    return links.join(hits, ["property_id", "text"]).select("synset_id", "property_id", "text", "salience", "vocab_id", "snap_method", "snap_score")


def snap_properties(links: DataFrame, properties: DataFrame, vocab: DataFrame, clusters: DataFrame, threshold: float = 0.7, forms: DataFrame | None = None) -> DataFrame:
    """One row per (synset, cluster): the best method's entry and score, the sum of all salience."""
    snapped = snap_links(links, properties, vocab, threshold, forms).join(clusters.select("vocab_id", "cluster_id"), "vocab_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "vocab_id"))
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("snap_method"))
    best = F.min(F.struct(order.alias("o"), "property_id", "vocab_id", "snap_method", "snap_score")).alias("m")
    return snapped.groupBy("synset_id", "cluster_id").agg(best, F.sum("salience").alias("salience_sum")).select("synset_id", "m.vocab_id", "cluster_id", "m.snap_method", "m.snap_score", "salience_sum")


def snap_counts(links: DataFrame, snapped: DataFrame) -> DataFrame:
    """``stage, n``: links that snapped by each method, and those that were dropped."""
    by = snapped.groupBy(F.col("snap_method").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    dropped = links.join(snapped.select("property_id").distinct(), "property_id", "left_anti").agg(F.lit("dropped").alias("stage"), F.count(F.lit(1)).alias("n"))
    return by.unionByName(dropped)


def snap_rejects(links: DataFrame, snapped: DataFrame, properties: DataFrame, vocab: DataFrame) -> DataFrame:
    """``synset_id, text, salience, reason, best_score`` of the links that did not snap."""
    left = links.join(snapped.select("property_id").distinct(), "property_id", "left_anti").join(properties.select("property_id", "embedding"), "property_id", "left")
    zero = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x != 0)
    vec = properties.filter("embedding is not null").select("property_id", F.col("text").alias("_t"), "embedding")
    base = vocab.select(F.col("vocab_id").alias("base_id"), F.lower("lemma").alias("_t")).join(vec, "_t").select("base_id", "embedding")
    score = nearest(left.filter(F.col("embedding").isNotNull() & ~zero).select(F.col("property_id").alias("query_id"), "embedding").dropDuplicates(["query_id"]), base)
    reason = F.when(F.col("embedding").isNull(), "no_embedding").when(zero, "zero_norm").otherwise("below_threshold")
    return left.join(score.select(F.col("query_id").alias("property_id"), F.col("score").alias("best_score")), "property_id", "left").select("synset_id", "text", "salience", reason.alias("reason"), "best_score")


def nearest_rows(train: DataFrame, query: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``id, d, score, train_id, nth``: the k nearest of ``train`` (id, embedding, score) to each of ``query`` (id, embedding) by Euclidean distance, in order.

    Found by cells (:func:`lexispark.operators.cells.nearest`), compared to nine places; ties go by training id.
    """
    base = train.select(F.col("id").alias("base_id"), "embedding")
    found, _ = cells.nearest(query.select(F.col("id").alias("query_id"), "embedding"), base, k, False, block)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9), "base_id"))
    near = found.withColumn("nth", nth).filter(F.col("nth") <= k).select(F.col("query_id").alias("id"), F.col("score").alias("d"), F.col("base_id").alias("train_id"), "nth")
    return near.join(train.select(F.col("id").alias("train_id"), "score"), "train_id").select("id", "d", "score", "train_id", "nth")


def mean_of_nearest(rows: DataFrame, k: int, weights: str = "distance") -> DataFrame:
    """``id, prediction`` from :func:`nearest_rows`: mean of the first k scores, plain ("uniform") or by inverse distance; exact matches decide alone."""
    exact = F.avg(F.when(F.col("d") == 0, F.col("score")))
    mean = F.avg("score") if weights == "uniform" else F.coalesce(exact, F.sum(F.col("score") / F.nullif("d", F.lit(0.0))) / F.sum(1 / F.nullif("d", F.lit(0.0))))
    return rows.filter(F.col("nth") <= k).groupBy("id").agg(mean.alias("prediction"))


def knn_regress(train: DataFrame, query: DataFrame, k: int = 10, weights: str = "distance", block: int = BLOCK) -> DataFrame:
    """``id, prediction``: mean of the k nearest training scores, see :func:`nearest_rows` and :func:`mean_of_nearest`."""
    return mean_of_nearest(nearest_rows(train, query, k, block), k, weights)
