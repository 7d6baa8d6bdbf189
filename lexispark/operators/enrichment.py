"""Properties of synsets: curation, links, statistics, batches and selection for enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexispark.functions.lineage import materialize
from lexispark.functions.text import filter_mwe, normalise_text
from lexispark.sources.tables import first_wins

PHYSICAL_FLOORS = {"n": 4, "v": 2, "a": 2, "s": 2}


def dense_ids(df: DataFrame, order: str | Sequence[Column | str], id_col: str) -> DataFrame:
    """Ids from 1 in a unique order, of one column or several: range-partitioned, counted per partition, offset."""
    order = [order] if isinstance(order, str) else list(order)
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = materialize(parts, "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(offsets, "_part").withColumn(id_col, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).drop("_part", "_before")


def compound_embedding(texts: DataFrame, vectors: DataFrame, text_col: str = "text") -> DataFrame:
    """``text, embedding``: mean vector of the parts between hyphens, spaces and slashes that have one; others are absent."""
    parts = texts.select(F.col(text_col).alias("text")).distinct().withColumn("lemma", F.explode(F.filter(F.split("text", r"[-\s/]"), lambda x: x != "")))
    return mean_vectors(parts.join(vectors, "lemma"), "text")


def added_up(keys: pa.Array, sums: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct keys and, for each, the rows of ``sums`` and ``counts`` added up."""
    coded = keys.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    start = np.flatnonzero(np.diff(code[order], prepend=-1))
    return coded.dictionary.take(pa.array(code[order[start]])), np.add.reduceat(sums[order], start), np.add.reduceat(counts[order], start)


#: Up to so many vectors are sent to all tasks.
SENT_VECTORS = 1 << 16


def sent_vectors(vectors: DataFrame) -> tuple[pa.Array, np.ndarray] | None:
    """The lemmas and a matrix of few ``vectors`` (lemma, embedding) of one length and a lemma each; else None. Null elements are NaN."""
    if not 0 < vectors.count() <= SENT_VECTORS:
        return None
    table = vectors.select("lemma", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).toArrow()
    words, rows = (table[c].combine_chunks() for c in ("lemma", "embedding"))
    sizes = pc.unique(pc.list_value_length(rows))
    if words.null_count or rows.null_count or len(sizes) != 1 or not sizes[0].as_py() or len(pc.unique(words)) < len(words):
        return None
    return words, np.asarray(rows.flatten().fill_null(np.nan)).reshape(len(words), -1)


def mean_vectors(rows: DataFrame, key: str, table: tuple[pa.Array, np.ndarray] | None = None) -> DataFrame:
    """``key, embedding``: the element-wise mean of ``embedding`` per key, which has one length per key.

    With a ``table`` from :func:`sent_vectors` the rows have a ``lemma`` instead, whose vector tasks look up there.

    Map tasks add up the vectors of a key batch by batch, so a key sends a vector for each batch, not a
    row for each element. Null elements and vectors are left out of the means; rows without key too.
    """
    kind = rows.schema[key].dataType.simpleString()
    partial = f"`{key}` {kind}, size int, sums array<double>, counts array<long>"

    def listed(m: np.ndarray, t: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1), type=t))

    def combine(b: pa.RecordBatch, sums: Callable[[pa.RecordBatch, int], np.ndarray], counts: Callable[[pa.RecordBatch, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        size = b.column("size").to_numpy()
        for n in np.unique(size).tolist():  # mostly one length
            some = b.filter(pa.array(size == n))
            keys, s, c = added_up(some.column(0), sums(some, n), counts(some, n))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(keys), n, dtype=np.int32)), listed(s, pa.float64()), listed(c, pa.int64())], names=[key, "size", "sums", "counts"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda b, n: np.asarray(b.column(2).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, n)
        for b in batches:
            yield from combine(b, lambda b, n: np.nan_to_num(flat(b, n), nan=0.0), lambda b, n: (~np.isnan(flat(b, n))).astype(np.int64))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, matrix = shared.value
        sums, counts = np.nan_to_num(matrix, nan=0.0), (~np.isnan(matrix)).astype(np.int64)
        for b in batches:
            at = pc.index_in(b.column(1), value_set=words)
            keys, at = b.column(0).filter(at.is_valid()), at.drop_null().to_numpy()
            if len(at):
                keys, s, c = added_up(keys, sums[at], counts[at])
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(keys), matrix.shape[1], dtype=np.int32)), listed(s, pa.float64()), listed(c, pa.int64())], names=[key, "size", "sums", "counts"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda c: lambda b, n: b.column(c).flatten().to_numpy().reshape(-1, n)
        held = None  # the last key of a batch may go on in the next
        for b in batches:
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if held.num_rows and held.column(0)[0] != held.column(0)[-1]:
                last = held.num_rows - 1
                ahead = np.flatnonzero(np.asarray(pc.not_equal(held.column(0), held.column(0)[last])))[-1] + 1
                yield from combine(held.slice(0, ahead), flat("sums"), flat("counts"))
                held = held.slice(ahead)
            elif held.num_rows > 1:
                held = pa.Table.from_batches(list(combine(held, flat("sums"), flat("counts")))).combine_chunks().to_batches()[0]
        if held is not None and held.num_rows:
            yield from combine(held, flat("sums"), flat("counts"))

    shared = rows.sparkSession.sparkContext.broadcast(table)  # at most SENT_VECTORS vectors
    if table is None:
        sent = rows.filter(F.col(key).isNotNull() & (F.size("embedding") > 0)).select(key, F.size("embedding").alias("size"), "embedding").mapInArrow(first, partial)
    else:
        sent = rows.filter(F.col(key).isNotNull()).select(key, "lemma").mapInArrow(looked_up, partial)
    sent = sent.repartition(key).sortWithinPartitions(key)
    mean = F.transform(F.arrays_zip("sums", "counts"), lambda z: (z["sums"] / F.nullif(z["counts"], F.lit(0))).cast("float"))
    return sent.mapInArrow(again, partial).select(key, mean.alias("embedding"))


def curate_properties(properties: DataFrame, vectors: DataFrame) -> DataFrame:
    """``property_id, text, embedding, is_oov, source`` of the distinct single-word texts, ids in text order."""
    texts = properties.select(normalise_text(F.col("text")).alias("text")).filter(filter_mwe(F.col("text"))).distinct()
    own = vectors.select(F.col("lemma").alias("text"), F.col("embedding").alias("_own"))
    split = texts.filter(F.col("text").contains("/"))
    found = texts.join(own, "text", "left").join(compound_embedding(split, vectors).withColumnRenamed("embedding", "_parts"), "text", "left")
    full = found.select("text", F.coalesce("_own", "_parts").alias("embedding"))
    return dense_ids(full, "text", "property_id").select("property_id", "text", "embedding", F.col("embedding").isNull().alias("is_oov"), F.lit("pilot").alias("source"))


def rejected_properties(properties: DataFrame) -> DataFrame:
    return properties.agg(F.count_if(~filter_mwe(normalise_text(F.col("text")))).alias("n"))


def populate_properties(properties: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``synset_id, property_id, salience, property_type, relation``; the first occurrence per pair in file, row and list order wins."""
    rows = properties.withColumn("text", normalise_text(F.col("text"))).filter(filter_mwe(F.col("text"))).join(vocabulary.select("text", "property_id"), "text")
    return first_wins(rows, ["synset_id", "property_id"], "doc_no", "row_no", "pos_in_list").select("synset_id", "property_id", "salience", "property_type", "relation")


def populate_lemma_metadata(enriched: DataFrame) -> DataFrame:
    rows = enriched.select("doc_no", "row_no", "synset_id", F.posexplode("lemma_metadata").alias("k", "m")).select("doc_no", "row_no", "k", "synset_id", "m.lemma", "m.register", "m.connotation")
    return first_wins(rows, ["lemma", "synset_id"], "doc_no", "row_no", "k").select("lemma", "synset_id", "register", "connotation")


def enrichment_stats(properties: DataFrame, enriched: DataFrame) -> DataFrame:
    """``total, unique_properties, synsets, average`` over all ``enriched`` synsets (a row each), those without properties included."""
    out = properties.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("text").alias("unique_properties")).crossJoin(enriched.agg(F.count(F.lit(1)).alias("synsets")))  # one row each
    return out.withColumn("average", F.when(F.col("synsets") > 0, F.round(F.col("total") / F.col("synsets"), 2)).otherwise(0.0))


def top_properties(properties: DataFrame, top: int = 100) -> DataFrame:
    return properties.groupBy(F.col("text").alias("property")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "property").limit(top)


def property_distribution(properties: DataFrame, enriched: DataFrame, top: int = 20) -> DataFrame:
    """``metric, value`` of one run: totals, uniqueness, averages over all ``enriched`` synsets, share of every type and counts of the ``top`` properties. A missing type is unknown."""
    one = properties.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("u"), F.count_if(F.col("property_type") == "physical").alias("p")).crossJoin(enriched.agg(F.count(F.lit(1)).alias("s")))  # one row each
    share = lambda a, b, places: F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), places), F.lit(0.0))
    metrics = {"total": F.col("n"), "unique": F.col("u"), "uniqueness": share("u", "n", 3), "per synset": share("n", "s", 2), "physical per synset": share("p", "s", 2)}
    flat = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in metrics]), F.array(*[c.cast("double") for c in metrics.values()]))).alias("metric", "value"))
    types = properties.groupBy(F.coalesce("property_type", F.lit("unknown")).alias("t")).agg(F.count(F.lit(1)).alias("n")).crossJoin(one.select(F.col("n").alias("_all")))  # one row
    often = top_properties(properties, top).select(F.concat(F.lit("property "), "property").alias("metric"), F.col("n").cast("double").alias("value"))
    return flat.unionByName(types.select(F.concat(F.lit("type "), "t").alias("metric"), F.round(100 * F.col("n") / F.col("_all"), 1).alias("value"))).unionByName(often)


def compare_distributions(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``metric, a, b, delta`` of two runs, each (properties, enriched)."""
    named = lambda run, name: property_distribution(*run).withColumnRenamed("value", name)
    return named(a, "a").join(named(b, "b"), "metric", "full_outer").withColumn("delta", F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 6))


def audit_physical(synsets: DataFrame, properties: DataFrame, floors: dict[str, int] | None = None, default: int = 2, exclude: DataFrame | None = None) -> DataFrame:
    """``synset_id, pos, n_physical, flagged`` per enriched synset; a missing part of speech counts as noun."""
    floors = PHYSICAL_FLOORS if floors is None else floors
    rows = synsets.select("synset_id", F.coalesce("pos", F.lit("n")).alias("pos")) if exclude is None else synsets.join(exclude, "synset_id", "left_anti").select("synset_id", F.coalesce("pos", F.lit("n")).alias("pos"))
    counts = properties.filter("property_type = 'physical'").groupBy("synset_id").agg(F.count(F.lit(1)).alias("n_physical"))
    floor = F.coalesce(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])[F.col("pos")], F.lit(default))
    return rows.join(counts, "synset_id", "left").withColumn("n_physical", F.coalesce("n_physical", F.lit(0))).withColumn("flagged", F.col("n_physical") < floor)


def physical_summary(audit: DataFrame) -> DataFrame:
    by = audit.groupBy("pos").agg(F.count(F.lit(1)).alias("total"), F.count_if("flagged").alias("flagged"), F.round(F.avg("n_physical"), 2).alias("avg_physical"))
    return by.withColumn("flagged_pct", F.round(100 * F.col("flagged") / F.col("total"), 1))


def curated_quality(curated: DataFrame) -> DataFrame:
    per = curated.groupBy("vocab_id").agg(F.count(F.lit(1)).alias("k"))
    vocab = per.agg(F.count(F.lit(1)).alias("vocabulary"), F.count_if(F.col("k") == 1).alias("hapax"), F.coalesce(F.sum("k"), F.lit(0)).alias("links"))
    n = curated.agg(F.countDistinct("synset_id").alias("synsets"))
    safe = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return vocab.crossJoin(n).select("vocabulary", "hapax", safe("hapax", "vocabulary").alias("hapax_rate"), safe("links", "synsets").alias("average"))  # one row each


def format_batches(synsets: DataFrame, lemmas: DataFrame, size: int = 20) -> DataFrame:
    """``batch_no, synset_ids, payload`` of consecutive synsets by id; a batch has ``size`` synsets."""
    words = lemmas.groupBy("synset_id").agg(F.array_sort(F.collect_set("lemma")).alias("all"))
    rows = dense_ids(synsets.select("synset_id", "definition").join(words, "synset_id"), "synset_id", "_no")
    block = F.concat(F.lit("ID: "), "synset_id", F.lit("\nWord: "), F.col("all")[0], F.when(F.size("all") > 1, F.concat(F.lit("\nLemmas: "), F.array_join("all", ", "))).otherwise(""), F.lit("\nDefinition: "), F.coalesce("definition", F.lit("")))
    members = F.array_sort(F.collect_list(F.struct("_no", "synset_id", block.alias("block"))))
    return rows.groupBy(F.floor((F.col("_no") - 1) / size).alias("batch_no")).agg(members.alias("m")).select("batch_no", F.col("m.synset_id").alias("synset_ids"), F.array_join("m.block", "\n\n").alias("payload"))


def merge_batch_results(batch: DataFrame, results: DataFrame, force_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results of the batch with its lemma, definition and pos, ids that are not in it). ``properties`` is an array of structs; null becomes empty."""
    known = batch.select(F.col("synset_id").alias("id"), "lemma", "definition", "pos")
    merged = results.join(known, "id").withColumn("properties", F.coalesce("properties", F.array().cast(results.schema["properties"].dataType)))
    if force_type:
        merged = merged.withColumn("properties", F.transform("properties", lambda p: p.withField("type", F.lit(force_type))))
    return merged.withColumnRenamed("id", "synset_id"), results.join(known, "id", "left_anti").select("id")


def resume_filter(work: DataFrame, completed: DataFrame, key: str = "synset_id") -> DataFrame:
    return work.join(completed.select(key), key, "left_anti")


def synset_detail(ids: DataFrame, synsets: DataFrame, enrichment: DataFrame, links: DataFrame, vocabulary: DataFrame) -> DataFrame:
    texts = links.join(vocabulary.select("property_id", "text"), "property_id").groupBy("synset_id").agg(F.array_sort(F.collect_list("text")).alias("properties"))
    return ids.join(synsets, "synset_id").join(enrichment, "synset_id", "left").join(texts, "synset_id", "left").withColumn("properties", F.coalesce("properties", F.array().cast("array<string>")))


def definition_hash() -> Column:
    """What tells rows of one synset apart."""
    return F.xxhash64("pos", "definition")


def familiar_synsets(synsets: DataFrame, lemmas: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Per synset its most familiar lemma and the highest familiarity."""
    f = lemmas.join(frequencies.select("lemma", "familiarity"), "lemma", "left").withColumn("fam", F.coalesce("familiarity", F.lit(0.0)))
    best = f.groupBy("synset_id").agg(F.max("fam").alias("max_fam"), F.min(F.struct((-F.col("fam")).alias("f"), "lemma")).alias("b"))
    return synsets.select("synset_id", definition_hash().alias("_h")).join(best, "synset_id").select("synset_id", "_h", F.col("b.lemma").alias("lemma"), "max_fam")


def rank_synsets_for_enrichment(synsets: DataFrame, lemmas: DataFrame, frequencies: DataFrame, enriched: DataFrame, limit: int, offset: int = 0, required: DataFrame | None = None) -> DataFrame:
    """Required synsets first, whatever their state; then unenriched ones by familiarity, paged. ``rank`` counts from 1.

    Definitions and lists of lemmas are attached to the chosen synsets only.
    """
    every = materialize(familiar_synsets(synsets, lemmas, frequencies), "familiar")
    order = [F.desc("max_fam"), "synset_id"]
    pad, first, n = every.join(enriched.select("synset_id"), "synset_id", "left_anti"), None, 0
    if required is not None:
        first = every.join(required.select("synset_id").distinct(), "synset_id", "left_semi").withColumn("_first", F.lit(0))
        n = first.count()
        pad = pad.join(required.select("synset_id"), "synset_id", "left_anti")
    page = pad.orderBy(*order).offset(offset).limit(max(0, limit - n)).withColumn("_first", F.lit(1))
    chosen = page if first is None else first.unionByName(page)
    ranked = materialize(chosen.withColumn("rank", F.row_number().over(Window.orderBy("_first", *order))).drop("_first", "max_fam"), "chosen")  # at most limit rows and the required
    lists = lemmas.join(ranked.select("synset_id").distinct(), "synset_id", "left_semi").groupBy("synset_id").agg(F.array_sort(F.collect_set("lemma")).alias("all_lemmas"))
    texts = synsets.join(ranked.select("synset_id").distinct(), "synset_id", "left_semi").select("synset_id", "pos", "definition", definition_hash().alias("_h")).dropDuplicates(["synset_id", "_h"])
    return ranked.join(lists, "synset_id").join(texts, ["synset_id", "_h"]).select("synset_id", "lemma", "pos", "definition", "all_lemmas", "rank")


def stratified_pilot(synsets: DataFrame, limit: int, required: DataFrame, seed: int = 42, shares: dict[str, float] | None = None) -> DataFrame:
    """``synset_id, pos, is_required``: the required ones, then a hash-ordered quota per part of speech."""
    shares = {"n": 0.4, "v": 0.4, "a": 0.2} if shares is None else shares
    need = synsets.join(required.select("synset_id").distinct(), "synset_id", "left_semi").withColumn("is_required", F.lit(True))
    left = max(0, limit - need.count())
    quota = F.create_map(*[x for k, s in shares.items() for x in (F.lit(k), F.lit(int(left * s)))])
    draw = F.md5(F.concat_ws(":", "synset_id", F.lit(str(seed))))
    rest = synsets.join(required.select("synset_id"), "synset_id", "left_anti").withColumn("_q", quota[F.col("pos")]).filter("_q > 0").withColumn("_draw", draw)
    picked = rest.withColumn("_k", F.row_number().over(Window.partitionBy("pos").orderBy("_draw", "synset_id"))).filter("_k <= _q")
    return need.select("synset_id", "pos", "is_required").unionByName(picked.select("synset_id", "pos", F.lit(False).alias("is_required")))
