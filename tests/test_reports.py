"""Scores, records and reports on rows that reach each of their branches."""

from lexispark.operators import enrichment, evaluation, trials


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_raw_overlap_counts_clusters_of_no_salience(spark):
    pairs = spark.createDataFrame([("p", "apt", "u", "v"), ("q", "apt", "u", "w")], "pair_id string, class string, word_a string, word_b string")
    words = spark.createDataFrame([(c, c) for c in "uvw"], "word string, synset_id string")
    bags = spark.createDataFrame([("u", 1, 0.0), ("u", 2, 3.0), ("v", 1, 2.0), ("v", 2, 1.0), ("w", 2, 0.0), ("w", 9, 0.0)], "synset_id string, cluster_id long, salience_sum double")
    out = {r.pair_id: r for r in evaluation.score_pairs(pairs, words, bags).collect()}
    assert out["p"].jaccard_raw == 1.0 and out["p"].jaccard_salience == round(1 / 5, 6)
    assert out["q"].jaccard_raw == round(1 / 3, 6) and out["q"].jaccard_salience == 0 and out["q"].cosine_salience == 0


def test_munch_records(spark):
    gen = spark.createDataFrame([(7, "they <b>swim</b> in it", " roll  wade ", "news", 1), (8, "plain", None, None, 2), (7, "x", "", "late", 3)], "idx int, s0 string, human_ans string, genre string, row_no int")
    apt, blank = evaluation.munch_apt(gen)
    assert rows_of(apt, "metaphor", "target", "paraphrase", "label", "genre", "s0_idx") == [("they <b>swim</b> in it", "swim", w, "apt", "news", 7) for w in ("roll", "wade")]
    assert {r.source_file for r in apt.collect()} == {evaluation.GENERATION_FILE} and blank.first()[0] == 2
    judged = spark.createDataFrame([(7, "m <b>a</b>", "one <b>b</b>", "apt", "two <b>c\nd</b> e", " INAPT"), (9, "m", "one", "inapt", "two", None), (7, "m", "one", "apt", "two", "apt"), (7, "m", None, "inapt", "two", "apt")], "s0_idx int, s0 string, s1 string, s1_label string, s2 string, s2_label string")
    got = evaluation.munch_inapt(judged, gen).collect()
    assert sorted((r.s0_idx, r.target, r.paraphrase, r.paraphrase_sentence, r.genre) for r in got if r.paraphrase) == [(7, "a", "c\nd", "two <b>c\nd</b> e", "late")]
    assert sorted((r.s0_idx, str(r.paraphrase_sentence), r.paraphrase, r.genre) for r in got if not r.paraphrase) == [(7, "None", None, "late"), (9, "one", None, "")]


def test_averages_are_over_all_enriched_synsets(spark):
    props = spark.createDataFrame([("s1", "warm", "physical"), ("s1", "slow", None), ("s2", "warm", "physical")], "synset_id string, text string, property_type string")
    done = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "synset_id string")
    assert tuple(enrichment.enrichment_stats(props, done).first()) == (3, 2, 4, 0.75)
    got = dict(rows_of(enrichment.property_distribution(props, done), "metric", "value"))
    assert got == {"total": 3, "unique": 2, "uniqueness": 0.667, "per synset": 0.75, "physical per synset": 0.5, "type physical": 66.7, "type unknown": 33.3, "property warm": 2, "property slow": 1}
    empty = dict(rows_of(enrichment.property_distribution(props.limit(0), done.limit(0)), "metric", "value"))
    assert empty == {"total": 0, "unique": 0, "uniqueness": 0, "per synset": 0, "physical per synset": 0}
    assert tuple(enrichment.enrichment_stats(props.limit(0), done.limit(0)).first()) == (0, 0, 0, 0.0)


def test_trial_reports(spark):
    logs = spark.createDataFrame([("t1", "a", 0, 0.2, True), ("t2", "a", 1, 0.6, True), ("t3", "b", 0, 0.0, True), ("t4", "b", 1, 0.9, False), ("t5", "c", 0, 0.4, True)], "trial_id string, prompt_name string, generation int, mrr double, valid boolean")
    found = spark.createDataFrame([("t1", "x", "strong", 1.0), ("t1", "y", None, 0.0), ("t2", "x", "strong", 0.5), ("t2", "y", None, 0.0), ("t3", "z", "weak", 0.0), ("t4", "y", "weak", 1.0), ("t5", "w", "weak", 0.25)], "trial_id string, pair string, tier string, reciprocal_rank double")
    hard = trials.pair_difficulty(found, logs, 2)
    assert rows_of(hard, "bucket", "pair", "avg_rr") == [("easiest", "w", 0.25), ("easiest", "x", 0.75), ("hardest", "w", 0.25), ("hardest", "y", 0.0), ("never found", "y", 0.0)]
    assert rows_of(trials.tier_mrr(found, logs), "tier", "mrr") == [("strong", 0.75), ("unknown", 0.0), ("weak", 0.25)]
    only_bad = logs.filter("trial_id in ('t3', 't4')")
    assert rows_of(trials.pair_difficulty(found.filter("trial_id in ('t3', 't4')"), only_bad, 1), "bucket", "pair") == [("easiest", "y"), ("hardest", "z"), ("never found", "z")]
    assert trials.tier_mrr(found, only_bad).count() == 0
    size = logs.withColumn("size", logs["mrr"] * 10).withColumn("gap", logs["generation"].cast("double"))
    corr = {r.metric: (r.r, r.label) for r in trials.metric_correlation(size, ["size", "gap"]).collect()}
    assert corr["size"] == (1.0, "strong positive") and corr["gap"][0] == 0.866  # the failed and the degenerate trial are out
    metrics = trials.trial_metrics(logs.selectExpr("*", "1 as hits", "2 as n", "cast(null as double) as parent_mrr", "cast(null as double) as shared_delta"), 0.3)
    one = trials.trial_summary(metrics, 0.3, found.selectExpr("trial_id", "pair as pair_id")).first()
    assert (one.best_trial, one.improvement, one.unique_pairs, one.mean_subset) == ("t4", 2.0, 4, 1.4)
    assert trials.trial_summary(metrics, 0.0, found.selectExpr("trial_id", "pair as pair_id").limit(0)).select("improvement", "unique_pairs", "mean_subset").distinct().collect() == [(0.0, 0, 0.0)]
