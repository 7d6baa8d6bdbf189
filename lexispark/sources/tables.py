"""Loaders: raw tables and files to the lexical tables. First-wins rules name their order column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexispark.functions.text import normalise_text

PROPERTY = "text string, salience double, type string, relation string"
SYNSETS = "array<struct<id:string,lemma:string,definition:string,pos:string,properties:array<string>,usage_example:string,lemma_metadata:array<struct<lemma:string,register:string,connotation:string>>>>"
ENRICHED = f"synsets {SYNSETS}, results {SYNSETS}, config struct<model:string>"


def first_wins(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1").drop("_nth")


def import_senses(words: DataFrame, senses: DataFrame, synsets: DataFrame, relations: DataFrame, order: Sequence[str] = ("posid", "definition")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(synsets, lemmas, relations); duplicate edges stay. Of a synset's rows the first in ``order`` stays."""
    s = first_wins(synsets, ["synsetid"], *order).select(F.col("synsetid").cast("string").alias("synset_id"), F.col("posid").alias("pos"), "definition")
    lemmas = words.join(senses, "wordid").select(F.col("word").alias("lemma"), F.col("synsetid").cast("string").alias("synset_id")).distinct()
    edges = relations.select(F.col("synset1id").cast("string").alias("source_synset"), F.col("synset2id").cast("string").alias("target_synset"), F.col("relationid").cast("string").alias("relation_type"))
    return s, lemmas, edges


def import_collocations(raw: DataFrame) -> DataFrame:
    """``syntagm_id, synset1id, synset2id, sensekey1, sensekey2, word1id, word2id`` of the rows with both synsets."""
    text, number = ("synset1id", "synset2id", "sensekey1", "sensekey2"), ("word1id", "word2id")
    return raw.filter("synset1id is not null and synset2id is not null").select(F.col("syntagm_id").cast("long"), *[F.col(c).cast("string") for c in text], *[F.col(c).cast("int") for c in number])


def import_verb_classes(classes: DataFrame, members: DataFrame, roles: DataFrame, role_types: DataFrame, examples: DataFrame, example_frames: DataFrame, class_frames: DataFrame) -> dict[str, DataFrame]:
    """``classes, members, roles, examples``.

    Classes: one row per id, the lowest name wins. Members: ``class_id, synset_id, wordid, vnwordid`` with a
    synset. Examples: one row per id, the lowest class wins.
    """
    # the classes of an example are reduced before its text is joined; a null class is the lowest
    least = F.when(F.count_if(F.col("class_id").isNull()) > 0, F.lit(None)).otherwise(F.min("class_id")).alias("class_id")
    of_example = example_frames.join(class_frames, "frame_id").groupBy("example_id").agg(least)
    return {
        "classes": first_wins(classes, ["class_id"], "class_name"),
        "members": members.filter("synset_id is not null").select("class_id", "synset_id", "wordid", "vnwordid").distinct(),
        "roles": roles.join(role_types, "role_type_id").select("class_id", "role_type"),
        "examples": first_wins(examples.select("example_id", "example"), ["example_id"], "example").join(of_example, "example_id").select("example_id", "class_id", "example"),
    }


def load_familiarity(raw: DataFrame, order: str = "row_no") -> DataFrame:
    """``word, familiarity, familiarity_dominant, zipf`` of word entries; the first row with a familiarity wins its key."""
    rows = raw.filter((F.col("EntryType") == "W") & F.col("Word").isNotNull()).select(
        normalise_text(F.col("Word")).alias("word"), F.expr("try_cast(Fam AS double)").alias("familiarity"), F.expr("try_cast(Dom AS int)").alias("familiarity_dominant"), F.expr("try_cast(Zipf AS double)").alias("zipf"), order
    )
    return first_wins(rows.filter("familiarity is not null"), ["word"], order).drop(order)


def load_word_frequency(raw: DataFrame, order: str = "row_no") -> DataFrame:
    """``word, zipf, frequency``: Zipf must parse, counts may have commas; the first row with a Zipf wins."""
    rows = raw.select(normalise_text(F.col("word")).alias("word"), F.expr("try_cast(zipf AS double)").alias("zipf"), F.expr("try_cast(replace(frequency, ',', '') AS bigint)").alias("frequency"), order)
    return first_wins(rows.filter("zipf is not null and word <> ''"), ["word"], order).drop(order)


def load_concreteness(raw: DataFrame, order: str = "row_no") -> DataFrame:
    """``word, score``: no bigrams, no blank words, numeric scores; the first row wins."""
    missing = {"Word", "Bigram", "Conc.M"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = raw.filter(F.coalesce(F.col("Bigram").cast("string"), F.lit("")) != "1").select(normalise_text(F.col("Word")).alias("word"), F.expr("try_cast(`Conc.M` AS double)").alias("score"), order)
    return first_wins(rows.filter("word <> '' and score is not null"), ["word"], order).drop(order)


def parse_vectors(lines: DataFrame, dim: int, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(``word, embedding``, ``reason, n`` of skipped rows) from ``value`` lines "word v1 … vd"; the first word wins."""
    parts = lines.withColumn("_p", F.split(F.trim("value"), " ")).withColumn("_v", F.expr("transform(slice(_p, 2, greatest(0, size(_p) - 1)), x -> try_cast(x AS float))"))
    header = (F.size("_p") == 2) & F.col("value").rlike(r"^\d+ \d+$")
    bad = (F.size("_v") != dim) | F.exists("_v", lambda x: x.isNull())
    state = F.when(header, "header").when(bad, "malformed").otherwise("ok")
    rows = parts.select(F.col("_p")[0].alias("word"), F.col("_v").alias("embedding"), state.alias("_state"), *order)
    ranked = rows.withColumn("_nth", F.when(F.col("_state") == "ok", F.row_number().over(Window.partitionBy("word", "_state").orderBy(*order))))
    skipped = ranked.withColumn("reason", F.when(F.col("_state") == "malformed", "malformed").when(F.col("_nth") > 1, "duplicate"))
    return ranked.filter("_nth = 1").select("word", "embedding"), skipped.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def load_vectors(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """:func:`parse_vectors` of text files, in file order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return parse_vectors(lines, dim, ["_file", "_block", "_line"])


def decode_vectors(blobs: DataFrame, dim: int, blob_col: str = "embedding") -> DataFrame:
    """Little-endian float32 blobs as arrays; null unless the length is exactly 4 * dim."""

    @F.pandas_udf("array<float>")
    def decode(column: pd.Series) -> pd.Series:
        rows = np.frombuffer(b"".join(column), dtype="<f4").reshape(len(column), dim)
        return pd.Series(list(rows), dtype=object)

    whole = F.octet_length(blob_col) == 4 * dim
    padded = F.when(whole, F.col(blob_col)).otherwise(F.lit(bytes(4 * dim)))
    return blobs.withColumn(blob_col, F.when(whole, decode(padded)))


def parse_enrichment(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per synset of enrichment documents in either form and under either key.

    A property is text (v1) or an object (v2). Documents without ``synsets`` or ``results`` raise
    when the rows are read. ``doc_no`` orders the documents; without such a column it is made up.
    """
    number = F.col("doc_no") if "doc_no" in documents.columns else F.monotonically_increasing_id()
    doc = documents.select(number.alias("doc_no"), F.from_json(json_col, ENRICHED).alias("d"))
    rows = F.coalesce("d.synsets", "d.results")
    checked = doc.select("doc_no", F.coalesce("d.config.model", F.lit("unknown")).alias("model_used"), F.when(rows.isNull(), F.raise_error(F.lit("an enrichment document has neither synsets nor results")).cast(SYNSETS)).otherwise(rows).alias("s"))
    one = checked.select("doc_no", "model_used", F.posexplode("s").alias("row_no", "s"))
    return one.select("doc_no", "row_no", F.col("s.id").alias("synset_id"), "s.lemma", "s.definition", "s.pos", "model_used", "s.usage_example", "s.properties", "s.lemma_metadata")


def load_enrichment(spark: SparkSession, *paths: str) -> DataFrame:
    """The documents of the files, in the order of the paths and, within a folder, of the file names.

    All files are checked before any row is returned; a file that is no such document raises.
    """
    each = [spark.read.text(p, wholetext=True).select(F.col("value").alias("json"), F.struct(F.lit(k).alias("k"), F.col("_metadata.file_path").alias("file")).alias("doc_no")) for k, p in enumerate(paths)]
    files = reduce(DataFrame.union, each)
    parsed = F.from_json("json", ENRICHED)
    bad = files.filter(F.coalesce(parsed["synsets"], parsed["results"]).isNull()).select("doc_no.file").limit(5).collect()
    if bad:
        raise ValueError(f"neither synsets nor results in {', '.join(r['file'] for r in bad)}")
    return parse_enrichment(files)


def explode_properties(enriched: DataFrame, cap: int = 15) -> DataFrame:
    """The first ``cap`` properties of each synset, cut before null texts are dropped; defaults filled in."""
    rows = enriched.select("doc_no", "row_no", "synset_id", "lemma", "definition", "pos", "model_used", "usage_example", F.posexplode(F.slice("properties", 1, cap)).alias("pos_in_list", "p"))
    v2 = F.col("p").startswith("{")
    parsed = F.from_json("p", PROPERTY)
    return rows.select(
        "doc_no", "row_no", "synset_id", "lemma", "definition", "pos", "model_used", "usage_example", (F.col("pos_in_list") + 1).alias("pos_in_list"),
        F.when(v2, parsed["text"]).otherwise(F.col("p")).alias("text"), F.when(v2, F.coalesce(parsed["salience"], F.lit(1.0))).otherwise(1.0).alias("salience"), F.when(v2, parsed["type"]).alias("property_type"), F.when(v2, parsed["relation"]).alias("relation"),
    ).filter("text is not null")


def parse_controls(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows labelled inapt, ``reason, n``) from JSON lines in ``value``; malformed and non-object lines are counted."""
    schema = "metaphor string, target string, paraphrase string, label string, genre string, s0_idx string, source_file string, _bad string"
    rows = lines.filter(F.trim("value") != "").select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.trim("value").startswith("{")
    good = rows.filter(~bad & (F.col("r.label") == "inapt")).select("r.*").drop("_bad")
    return good, rows.filter(bad).agg(F.count(F.lit(1)).alias("n")).select(F.lit("malformed").alias("reason"), "n")


def load_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with ``pair_id`` "source:target" and the pool's version; a null source or target raises when rows are read.

    The version is a hash of the content of all rows, whatever their order.
    """
    checked = pairs.withColumn("pair_id", F.when(F.col("source").isNull() | F.col("target").isNull(), F.raise_error(F.lit("a pair lacks its source or target")).cast("string")).otherwise(F.concat_ws(":", "source", "target")))
    digest = checked.agg(F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct("pair_id", *sorted(pairs.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"))
    return checked.crossJoin(F.broadcast(digest.select(F.substring(F.sha2(F.col("s").cast("string"), 256), 1, 16).alias("version"))))  # one row
