"""Scoring of word pairs and evaluation of rankings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexispark.functions.lineage import materialize
from lexispark.functions.scores import classify_domain
from lexispark.functions.text import extract_marked
from lexispark.operators.quantiles import exact_quantiles


def _unit_hash(key: Column) -> Column:
    """A number in [0, 1) for a text: 52 bits of its md5; 0 for no text."""
    return F.when(key == "", 0.0).otherwise(F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


#: Aggregates over the joined bags of a pair (``x`` and ``y`` salience per cluster, 0 where absent; ``has_x`` and ``has_y`` whether it is there). Add an entry to add a scoring.
SCORINGS: dict[str, Callable[[Column, Column], Column]] = {
    "jaccard_salience": lambda x, y: _ratio(F.sum(F.least(x, y)), F.sum(F.greatest(x, y))),
    "jaccard_raw": lambda x, y: _ratio(F.count_if(F.col("has_x") & F.col("has_y")).cast("double"), F.count(F.lit(1)).cast("double")),
    "cosine_salience": lambda x, y: _ratio(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))),
    "null": lambda x, y: _unit_hash(F.array_join(F.transform(F.array_sort(F.collect_set("cluster_id")), lambda c: c.cast("string")), ",")),
}


def check_scorings(names: list[str]) -> None:
    unknown = [n for n in names if n not in SCORINGS]
    if unknown:
        raise ValueError(f"unknown scoring {', '.join(unknown)}; known: {', '.join(sorted(SCORINGS))}")


def joined_bags(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """``pair_id, cluster_id, x, y, has_x, has_y`` for pairs (pair_id, synset_a, synset_b): the full outer join of the two bags. A cluster of salience 0 is in its bag."""
    side = lambda s, x, y: pairs.select("pair_id", F.col(s).alias("synset_id")).join(bags, "synset_id").select("pair_id", "cluster_id", x.alias("x"), y.alias("y"), F.lit(s == "synset_a").alias("has_x"))
    both = side("synset_a", F.col("salience_sum"), F.lit(0.0)).union(side("synset_b", F.lit(0.0), F.col("salience_sum")))
    return both.groupBy("pair_id", "cluster_id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.bool_or("has_x").alias("has_x"), F.bool_or(~F.col("has_x")).alias("has_y"))


def score_pairs(pairs: DataFrame, words: DataFrame, bags: DataFrame, scorings: list[str] | None = None) -> DataFrame:
    """``pair_id, class, status`` and one column per scoring for pairs (pair_id, class, word_a, word_b).

    ``words`` maps word to synset_id. Status is scored, unresolved (no synset for a word) or
    no_properties (an empty bag); only scored pairs have scores, rounded to 6.
    """
    names = list(SCORINGS) if scorings is None else scorings
    check_scorings(names)
    bags = materialize(bags.select("synset_id", "cluster_id", "salience_sum"), "bags")  # read three times
    to = lambda w, s: words.select(F.col("word").alias(w), F.col("synset_id").alias(s))
    has = bags.select("synset_id").distinct()
    found = pairs.join(to("word_a", "synset_a"), "word_a", "left").join(to("word_b", "synset_b"), "word_b", "left")
    found = found.join(has.select(F.col("synset_id").alias("synset_a"), F.lit(True).alias("_a")), "synset_a", "left").join(has.select(F.col("synset_id").alias("synset_b"), F.lit(True).alias("_b")), "synset_b", "left")
    status = F.when(F.col("synset_a").isNull() | F.col("synset_b").isNull(), "unresolved").when(F.col("_a").isNull() | F.col("_b").isNull(), "no_properties").otherwise("scored")
    marked = found.withColumn("status", status)
    scores = joined_bags(marked.filter("status = 'scored'"), bags).groupBy("pair_id").agg(*[F.round(SCORINGS[n](F.col("x"), F.col("y")), 6).alias(n) for n in names])
    return marked.join(scores, "pair_id", "left").select("pair_id", "class", "word_a", "word_b", "status", *names)


def sweep(scored: DataFrame, variations: list[tuple[str, float]]) -> DataFrame:
    """Aptness of every (scoring, percentile) from one scored table, best separation first.

    The threshold is the interpolated percentile of the inapt scores, 0 without any; a pair passes
    above it. Variations with an unknown scoring or percentile come last with status failed.
    """
    good = [(s, p) for s, p in variations if s in SCORINGS and 0 <= p <= 100]
    bad = [(s, p) for s, p in variations if (s, p) not in good]
    names = sorted({s for s, _ in good})
    parts = []
    gaps = [F.count_if((F.col("class") == c) & (F.col("status") == s)).alias(f"{s}_{c}") for c in ("apt", "inapt") for s in ("unresolved", "no_properties")]
    if good:
        long = scored.select("class", "status", F.explode(F.array(*[F.struct(F.lit(n).alias("scoring"), F.col(n).alias("score")) for n in names])).alias("s")).select("class", "status", "s.*")
        long = materialize(long, "scores")
        inapt = long.filter("class = 'inapt' and status = 'scored'")
        limits = exact_quantiles(inapt, [(s, p / 100) for s, p in good])
        asked = scored.sparkSession.createDataFrame([(s, float(p), limits.get((s, p / 100), 0.0)) for s, p in good], "scoring string, percentile double, threshold double")
        with_limit = long.join(F.broadcast(asked), "scoring")  # a row per variation
        mean = lambda c: F.avg(F.when(F.col("class") == c, F.col("score")))
        rate = lambda c: F.count_if((F.col("class") == c) & (F.col("score") > F.col("threshold"))) / F.nullif(F.count_if((F.col("class") == c) & (F.col("status") == "scored")), F.lit(0))
        out = with_limit.groupBy("scoring", "percentile", "threshold").agg(
            F.coalesce(rate("apt"), F.lit(0.0)).alias("aptness_rate"), F.coalesce(rate("inapt"), F.lit(0.0)).alias("false_positive_rate"), F.coalesce(mean("apt"), F.lit(0.0)).alias("mean_apt"), F.coalesce(mean("inapt"), F.lit(0.0)).alias("mean_inapt"),
            F.count_if((F.col("class") == "apt") & (F.col("status") == "scored")).alias("n_apt"), F.count_if((F.col("class") == "inapt") & (F.col("status") == "scored")).alias("n_inapt"), *gaps,
        )
        parts.append(out.withColumns({"separation_score": F.col("mean_apt") - F.col("mean_inapt"), "status": F.lit("ok")}))
    if bad:
        parts.append(scored.sparkSession.createDataFrame([(s, float(p), "failed") for s, p in bad], "scoring string, percentile double, status string"))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return every.withColumn("rank", F.row_number().over(Window.orderBy(F.col("status") == "failed", F.round("separation_score", 9).desc_nulls_last(), "scoring", "percentile")))  # a row per variation


def aptness_eval(scored: DataFrame, scoring: str, percentile: float = 95) -> DataFrame:
    check_scorings([scoring])
    return sweep(scored, [(scoring, percentile)]).drop("rank", "status")


def resolve_pairs(pairs: DataFrame, lemmas: DataFrame, subset: DataFrame | None = None, sides: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """``pair_id, source, target, tier, source_synsets, target_synsets, reason``; the reason is null for testable pairs.

    ``subset`` (pair_id) keeps only its pairs; only the words of ``sides`` have to be known.
    """
    pairs = pairs if subset is None else pairs.join(subset.select("pair_id").distinct(), "pair_id", "left_semi")
    sets = lemmas.groupBy("lemma").agg(F.array_sort(F.collect_set("synset_id")).alias("s"))
    side = lambda w, o: sets.select(F.col("lemma").alias(w), F.col("s").alias(o))
    found = pairs.join(side("source", "source_synsets"), "source", "left").join(side("target", "target_synsets"), "target", "left")
    reason = F.coalesce(*[F.when(F.col(f"{s}_synsets").isNull(), f"{s} not found") for s in sides])
    return found.select("pair_id", "source", "target", "tier", "source_synsets", "target_synsets", reason.alias("reason"))


def needed_synsets(resolved: DataFrame) -> DataFrame:
    """``synset_id`` of all synsets of the testable pairs of :func:`resolve_pairs`."""
    ok = resolved.filter("reason is null")
    side = lambda c: ok.select(F.explode(c).alias("synset_id"))
    return side("source_synsets").union(side("target_synsets")).distinct()


def match_rank(pairs: DataFrame, suggestions: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``pair_id, rank, reciprocal_rank``: the first suggestion for the source that is the target or one of its synsets."""
    mine = pairs.select("pair_id", F.col("source").alias("word"), "target").join(suggestions.select("word", "rank", "synset_id", "lemma"), "word")
    ids = lemmas.select(F.col("lemma").alias("target"), "synset_id", F.lit(True).alias("_hit")).distinct()
    hits = mine.join(ids, ["target", "synset_id"], "left").filter(F.col("_hit") | (F.col("lemma") == F.col("target"))).groupBy("pair_id").agg(F.min("rank").alias("rank"))
    return pairs.select("pair_id").join(hits, "pair_id", "left").withColumn("reciprocal_rank", F.coalesce(1 / F.col("rank"), F.lit(0.0)))


def mrr(ranks: DataFrame, by: str | None = None) -> DataFrame:
    """``tier, mrr, hits, n`` over all and, given ``by``, per value of it."""
    stats = [F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("rank").alias("hits"), F.count(F.lit(1)).alias("n")]
    whole = ranks.agg(*stats).select(F.lit("all").alias("tier"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"), "hits", "n")
    return whole if by is None else whole.unionByName(ranks.groupBy(F.col(by).alias("tier")).agg(*stats))


def rank_auc(ranked: DataFrame) -> DataFrame:
    """``word, rank_auc``: the chance that a cross-domain result stands before a same-domain one, ties counting half; null if a side is empty."""
    by = ranked.groupBy("word", "rank").agg(F.count_if(F.col("domain") == "cross").alias("c"), F.count_if(F.col("domain") == "same").alias("s"))
    after = F.sum("s").over(Window.partitionBy("word").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1))
    wins = by.withColumn("_w", F.col("c") * (F.coalesce(after, F.lit(0)) + 0.5 * F.col("s")))
    return wins.groupBy("word").agg((F.sum("_w") / F.nullif(F.sum("c") * F.sum("s"), F.lit(0))).alias("rank_auc"))


def word_discrimination(suggestions: DataFrame, synonyms: DataFrame, words: DataFrame) -> DataFrame:
    """``word, cross_ratio_top10, synonym_top10, rank_auc, total`` of every word; a distance of 0 counts as missing."""
    distance = F.nullif("domain_distance", F.lit(0.0))
    marked = suggestions.withColumn("domain", classify_domain(distance)).join(synonyms.select("word", F.col("partner").alias("lemma"), F.lit(True).alias("_syn")).distinct(), ["word", "lemma"], "left")
    per = marked.groupBy("word").agg(F.count_if((F.col("rank") <= 10) & (F.col("domain") == "cross")).alias("c"), F.count_if((F.col("rank") <= 10) & F.col("_syn")).alias("s"), F.count(F.lit(1)).alias("total"))
    top = F.least(F.lit(10), F.col("total"))
    out = words.select("word").distinct().join(per, "word", "left").join(rank_auc(marked), "word", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return out.select("word", F.when(F.col("total") > 0, F.col("c") / top).otherwise(0.0).alias("cross_ratio_top10"), F.when(F.col("total") > 0, F.col("s") / top).otherwise(0.0).alias("synonym_top10"), "rank_auc", "total")


def discrimination_summary(per_word: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 4).alias(f"mean_{c}")
    return per_word.agg(mean("rank_auc"), mean("cross_ratio_top10"), mean("synonym_top10"), F.count(F.lit(1)).alias("words"), F.count("rank_auc").alias("with_auc"))


def select_eval_words(lemmas: DataFrame, synsets: DataFrame, curated: DataFrame, least: int = 3, quotas: dict[str, int] | None = None) -> DataFrame:
    """``lemma, pos, primary_synset_id, prop_count``: lemmas of most distinct properties per part of speech; satellites are adjectives."""
    quotas = {"n": 20, "v": 15, "a": 15} if quotas is None else quotas
    props = lemmas.join(curated.select("synset_id", "vocab_id"), "synset_id").groupBy("lemma").agg(F.countDistinct("vocab_id").alias("prop_count"), F.min(F.col("synset_id").cast("bigint")).alias("_first"))
    named = props.filter(F.col("prop_count") >= least).withColumn("synset_id", F.col("_first").cast("string")).join(synsets.select("synset_id", F.when(F.col("pos") == "s", "a").otherwise(F.col("pos")).alias("pos")), "synset_id")
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col("pos")]
    return named.withColumn("_k", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("prop_count"), "lemma"))).filter(F.col("_k") <= quota).select("lemma", "pos", F.col("synset_id").alias("primary_synset_id"), "prop_count")


# The names that records give their files.
GENERATION_FILE = "correct_answers/for_generation.csv"
JUDGEMENT_FILE = "correct_answers/for_judgement.csv"


def munch_apt(generated: DataFrame, source_file: str = GENERATION_FILE) -> tuple[DataFrame, DataFrame]:
    """(one record per word of ``human_ans``, number of rows without a word) of rows (idx, s0, human_ans, genre).

    A record is ``metaphor, target, paraphrase, label, genre, s0_idx, source_file``.
    """
    words = F.filter(F.split(F.trim("human_ans"), r"\s+"), lambda w: w != "")
    rows = generated.select(F.col("s0").alias("metaphor"), extract_marked(F.col("s0")).alias("target"), F.explode(words).alias("paraphrase"), F.lit("apt").alias("label"), F.coalesce("genre", F.lit("")).alias("genre"), F.col("idx").alias("s0_idx"), F.lit(source_file).alias("source_file"))
    return rows, generated.agg(F.count_if(F.coalesce(F.size(words), F.lit(0)) < 1).alias("blank"))


def munch_inapt(judged: DataFrame, generated: DataFrame, source_file: str = JUDGEMENT_FILE) -> DataFrame:
    """A record for each row (s0_idx, s0, s1, s1_label, s2, s2_label) with a side labelled inapt, the second first; rows with neither are skipped.

    The paraphrase is the marked span of that side, null without one. The genre is that of the index in
    ``generated`` (idx, genre, row_no), of which the last row decides; "" if unknown.
    """
    inapt = lambda c: F.coalesce(F.lower(F.trim(c)) == "inapt", F.lit(False))
    sentence = F.when(inapt("s2_label"), F.col("s2")).otherwise(F.col("s1"))
    genres = generated.groupBy("idx").agg(F.max_by("genre", "row_no").alias("genre"))
    rows = judged.filter(inapt("s1_label") | inapt("s2_label")).withColumn("paraphrase_sentence", sentence).join(genres, judged["s0_idx"] == genres["idx"], "left")
    return rows.select(
        F.col("s0").alias("metaphor"), extract_marked(F.col("s0")).alias("target"), extract_marked(F.col("paraphrase_sentence")).alias("paraphrase"), "paraphrase_sentence", F.lit("inapt").alias("label"), F.coalesce("genre", F.lit("")).alias("genre"), "s0_idx", F.lit(source_file).alias("source_file")
    )


def filter_pairs(generated: DataFrame, existing: DataFrame, vocab: DataFrame) -> DataFrame:
    """``index, source, target, flags, is_clean`` for generated pairs (index, source, target)."""
    low = generated.select("index", "source", "target", F.lower("source").alias("_s"), F.lower("target").alias("_t"))
    words = vocab.select(F.col("word").alias("_w")).distinct()
    known = lambda c, o: words.select(F.col("_w").alias(c), F.lit(True).alias(o))
    old = existing.select(F.lower("source").alias("_s"), F.lower("target").alias("_t"))
    j = low.join(known("_s", "_sv"), "_s", "left").join(known("_t", "_tv"), "_t", "left").join(old.select("_t").distinct().withColumn("_to", F.lit(True)), "_t", "left").join(old.distinct().withColumn("_po", F.lit(True)), ["_s", "_t"], "left")
    before = F.lag("index").over(Window.partitionBy("_t").orderBy("index"))
    flags = F.array(
        F.when(F.col("_tv").isNull(), "target not in vocab"), F.when(F.col("_sv").isNull(), "source not in vocab"), F.when(F.col("source").contains(" "), "multi-word source"), F.when(F.col("target").contains(" "), "multi-word target"),
        F.when(F.col("_to"), "target in existing"), F.when(F.col("_po"), "pair in existing"), F.when(before.isNotNull(), F.concat(F.lit("target repeats "), before.cast("string"))),
    )
    return j.select("index", "source", "target", F.array_compact(flags).alias("flags")).withColumn("is_clean", F.size("flags") == 0)


def pair_vocabulary(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("source").alias("word")).union(pairs.select("target")).distinct()
