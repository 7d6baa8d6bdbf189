"""Text, part-of-speech and rarity rules as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

POS_NAMES = {"n": "noun", "v": "verb", "a": "adjective", "r": "adverb", "s": "adjective satellite"}


def normalise_text(text: Column) -> Column:
    return F.lower(F.trim(text))


def filter_mwe(text: Column) -> Column:
    """True for text of at most one word without hyphen."""
    return (F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")) <= 1) & ~text.contains("-")


def rarity(familiarity: Column, zipf: Column) -> Column:
    def level(value: Column, common: float, unusual: float) -> Column:
        return F.when(value >= common, "common").when(value >= unusual, "unusual").otherwise("rare")

    return F.when(familiarity.isNotNull(), level(familiarity, 5.5, 3.5)).when(zipf.isNotNull(), level(zipf, 4.5, 2.5)).otherwise("unusual")


def pos_name(code: Column, names: Mapping[str, str] = POS_NAMES) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[code], code)


def suffix_variants(word: Column) -> Column:
    """Variants by suffix rules, in order of preference, without the word itself."""
    n, empty = F.length(word), F.array().cast("array<string>")
    ing = F.when(word.endswith("ing") & (n > 5), F.array(word.substr(F.lit(1), n - 3), F.concat(word.substr(F.lit(1), n - 3), F.lit("e")))).otherwise(empty)
    ed = F.when(word.endswith("ed") & (n > 4), F.array(word.substr(F.lit(1), n - 2), word.substr(F.lit(1), n - 1), F.concat(word.substr(F.lit(1), n - 2), F.lit("e")))).otherwise(empty)
    return F.array_remove(F.array_distinct(F.concat(ing, ed)), word)


def morph_variants(words: DataFrame, forms: DataFrame | None = None, word_col: str = "word") -> DataFrame:
    """``word, variant_no, variant``: lemmas of irregular ``forms`` (form, lemma) first, then suffix rules."""
    w = words.select(F.col(word_col).alias("word")).distinct()
    variants = suffix_variants(F.col("word"))
    if forms is not None:
        known = forms.groupBy(F.col("form").alias("word")).agg(F.array_sort(F.collect_set("lemma")).alias("_lemmas"))
        w = w.join(known, "word", "left")
        variants = F.array_remove(F.array_distinct(F.concat(F.coalesce("_lemmas", F.array().cast("array<string>")), variants)), F.col("word"))
    return w.select("word", F.posexplode(variants).alias("variant_no", "variant"))


def extract_marked(sentence: Column) -> Column:
    """Text of the first <b>…</b> span; null without one."""
    return F.when(sentence.rlike(r"(?s)<b>.*?</b>"), F.regexp_extract(sentence, r"(?s)<b>(.*?)</b>", 1))
