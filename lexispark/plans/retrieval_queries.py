"""Queries of candidate retrieval and scoring functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import scores
from lexispark.operators import retrieval as R
from lexispark.operators.vocabulary import embedding_lookup as embeddings_of
from lexispark.plans.catalog import query

SHARED = """SELECT s.synset_id AS source_id, t.synset_id AS target_id, round(sum(t.salience_sum), 6) AS sal, string_agg(v.lemma, '|' ORDER BY v.lemma) AS props
    FROM lx_curated s JOIN lx_curated t ON s.cluster_id = t.cluster_id AND s.synset_id <> t.synset_id JOIN lx_vocab v ON v.vocab_id = s.cluster_id GROUP BY 1, 2"""
CONTRAST = """SELECT s.synset_id AS source_id, t.synset_id AS target_id, count(*) AS con
    FROM lx_curated s JOIN lx_cluster_antonyms x ON x.a = s.cluster_id JOIN lx_curated t ON t.cluster_id = x.b AND s.synset_id <> t.synset_id GROUP BY 1, 2"""
SENSES = "SELECT DISTINCT w.lemma AS word, w.synset_id AS source_id FROM lx_words w WHERE w.synset_id IN (SELECT synset_id FROM lx_curated)"
PER_SENSE = """SELECT z.word, z.source_id, t.synset_id AS target_id, round(sum(t.salience_sum), 6) AS sal, string_agg(v.lemma, '|' ORDER BY v.lemma) AS props
    FROM senses z JOIN lx_curated s ON s.synset_id = z.source_id JOIN lx_vocab v ON v.vocab_id = s.cluster_id JOIN lx_curated t ON t.cluster_id = s.cluster_id
    WHERE NOT EXISTS (SELECT 1 FROM senses q WHERE q.word = z.word AND q.source_id = t.synset_id) GROUP BY 1, 2, 3"""
OPPOSED = """SELECT word, target_id, max(n) AS con FROM (SELECT z.word, z.source_id, t.synset_id AS target_id, count(*) AS n
    FROM senses z JOIN lx_curated s ON s.synset_id = z.source_id JOIN lx_cluster_antonyms x ON x.a = s.cluster_id JOIN lx_curated t ON t.cluster_id = x.b GROUP BY 1, 2, 3) GROUP BY 1, 2"""
BEST = "SELECT *, row_number() OVER (PARTITION BY word, target_id ORDER BY round(sal, 6) DESC, source_id) AS k FROM per"
FORGE = f"""WITH senses AS MATERIALIZED ({SENSES}), per AS MATERIALIZED ({PER_SENSE}), opp AS MATERIALIZED ({OPPOSED}), best AS ({BEST}),
    top AS (SELECT b.word, b.target_id, b.source_id, b.sal, b.props, coalesce(o.con, 0) AS con,
                   row_number() OVER (PARTITION BY b.word ORDER BY round(b.sal + coalesce(o.con, 0), 6) DESC, b.target_id) AS rank
            FROM best b LEFT JOIN opp o ON o.word = b.word AND o.target_id = b.target_id WHERE b.k = 1),
    named AS (SELECT t.word, t.rank, t.target_id AS synset_id, (SELECT min(l.lemma) FROM lx_words l WHERE l.synset_id = t.target_id) AS lemma, ts.pos, ts.definition,
                     round(t.sal, 6) AS salience_sum, t.con::BIGINT AS contrast_count, t.props AS shared_properties, t.source_id AS source_synset_id, ss.definition AS source_definition, ss.pos AS source_pos, t.sal
              FROM top t JOIN lx_part_synsets ts ON ts.synset_id = t.target_id JOIN lx_part_synsets ss ON ss.synset_id = t.source_id WHERE t.rank <= 50)"""
COS = "(list_sum(list_transform(range(1, 65), lambda i: va[i]::DOUBLE * vb[i]::DOUBLE)) / (sqrt(list_sum(list_transform(va, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(vb, lambda x: x::DOUBLE * x::DOUBLE)))))"


def sources(v):
    return v["lx_curated"].select(F.col("synset_id").alias("source_id"))


def shown(df):
    return df.withColumns({"salience_sum": F.round("salience_sum", 6), "shared_properties": F.array_join("shared_properties", "|")})


def forge(v):
    return R.forge_by_lemma(v["lx_word_list"], v["lx_words"], v["lx_curated"], v["lx_vocab"], v["lx_cluster_antonyms"], v["lx_part_synsets"])


@query(f"SELECT source_id, target_id, round(sal, 6) AS salience_sum, props AS shared_properties FROM ({SHARED})")
def shared_properties(v):
    return R.shared_properties(sources(v), v["lx_curated"], v["lx_vocab"], written="|")


@query(f"SELECT source_id, target_id, con AS contrast_count FROM ({CONTRAST})")
def contrast_properties(v):
    return R.contrast_properties(sources(v), v["lx_curated"], v["lx_cluster_antonyms"])


@query(f"""WITH sh AS ({SHARED}), co AS ({CONTRAST}),
    b AS (SELECT coalesce(sh.source_id, co.source_id) AS source_id, coalesce(sh.target_id, co.target_id) AS target_id, coalesce(sal, 0.0) AS sal, coalesce(con, 0) AS con, coalesce(props, '') AS props
          FROM sh FULL JOIN co ON sh.source_id = co.source_id AND sh.target_id = co.target_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(sal + con, 6) DESC, target_id) AS rank FROM b)
    SELECT source_id, rank, target_id AS synset_id, lemma, pos, definition, round(sal, 6) AS salience_sum, con AS contrast_count, props AS shared_properties
    FROM r JOIN lx_part_synsets p ON p.synset_id = r.target_id JOIN (SELECT synset_id, min(lemma) AS lemma FROM lx_words GROUP BY 1) l ON l.synset_id = r.target_id WHERE rank <= 50""")
def forge_by_synset(v):
    return shown(R.forge_by_synset(sources(v), v["lx_curated"], v["lx_vocab"], v["lx_cluster_antonyms"], v["lx_part_synsets"], v["lx_words"]))


@query(f"{FORGE} SELECT * EXCLUDE (sal) FROM named")
def forge_by_lemma(v):
    return shown(forge(v))


@query(f"""WITH senses AS MATERIALIZED ({SENSES}), per AS MATERIALIZED ({PER_SENSE}), best AS ({BEST})
    SELECT word, target_id, source_id, round(sal, 6) AS salience_sum FROM best WHERE k = 1""")
def best_sense(v):
    senses = v["lx_words"].select(F.col("lemma").alias("word"), F.col("synset_id").alias("source_id"))
    best = R.best_senses(senses, v["lx_curated"], v["lx_vocab"], senses_too=False)
    return best.withColumn("salience_sum", F.round("salience_sum", 6))


def suggestions(v):
    return R.suggest(v["lx_word_list"], v["lx_words"], v["lx_curated"], v["lx_vocab"], v["lx_cluster_antonyms"], v["lx_part_synsets"], v["lx_word_vectors"])


SUGGEST = f"""{FORGE},
    dist AS (SELECT n.*, va.embedding AS va, vb.embedding AS vb FROM named n LEFT JOIN lx_word_vectors va ON va.lemma = n.word LEFT JOIN lx_word_vectors vb ON vb.lemma = n.lemma),
    d AS (SELECT * EXCLUDE (va, vb), CASE WHEN va IS NULL OR vb IS NULL THEN 0.0 ELSE 1 - {COS} END AS dd FROM dist),
    scored AS (SELECT *, sqrt(sal) * (1 + greatest(0, least(1, dd))) AS comp, CASE WHEN sal >= 4 AND contrast_count >= 3 THEN 'complex' WHEN sal < 2 AND contrast_count >= 3 THEN 'ironic' WHEN sal >= 4 THEN 'legendary' WHEN sal >= 2 THEN 'strong' ELSE 'unlikely' END AS tier FROM d),
    ranked AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY word ORDER BY list_position(['legendary', 'complex', 'ironic', 'strong', 'unlikely'], tier), round(comp, 6) DESC, synset_id) AS rank FROM scored)"""


@query(f"""{SUGGEST} SELECT word, rank, synset_id, lemma, pos, definition, salience_sum, contrast_count, shared_properties, source_synset_id, source_definition, source_pos,
           trunc(sal)::INT AS overlap_count, round(dd, 5) AS domain_distance, round(comp, 5) AS composite_score, tier FROM ranked""")
def suggest(v):
    return shown(suggestions(v)).withColumns({"domain_distance": F.round("domain_distance", 5), "composite_score": F.round("composite_score", 5)})


@query("""SELECT tier, count(*) AS n FROM (SELECT CASE WHEN s >= 4 AND c >= 3 THEN 'complex' WHEN s < 2 AND c >= 3 THEN 'ironic' WHEN s >= 4 THEN 'legendary' WHEN s >= 2 THEN 'strong' ELSE 'unlikely' END AS tier
          FROM (SELECT salience_sum AS s, vocab_id % 5 AS c FROM lx_curated)) GROUP BY 1""")
def tiers(v):
    return v["lx_curated"].select(scores.classify_tier(F.col("salience_sum"), F.col("vocab_id") % 5).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS va, b.embedding AS vb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), d AS (SELECT a, b, 1 - {COS} AS d FROM p)
    SELECT a, b, round(d, 5) AS domain_distance, CASE WHEN d > 0.7 THEN 'cross' WHEN d < 0.3 THEN 'same' END AS domain FROM d""")
def cosine_distances(v):
    e = v["embeddings"]
    pairs = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb")), "a")
    d = pairs.withColumn("d", scores.cosine_distance(F.col("va"), F.col("vb")))
    return d.select("a", "b", F.round("d", 5).alias("domain_distance"), scores.classify_domain(F.col("d")).alias("domain"))


@query("SELECT synset_id, cluster_id, round(sqrt(salience_sum) * (1 + greatest(0.0, least(1.0, coalesce(snap_score, 0.0)))), 6) AS composite_score FROM lx_curated")
def composite_scores(v):
    return v["lx_curated"].select("synset_id", "cluster_id", F.round(scores.composite_score(F.col("salience_sum"), F.coalesce("snap_score", F.lit(0.0))), 6).alias("composite_score"))


@query("SELECT synset_id, min(lemma) AS lemma FROM lx_lexicon GROUP BY 1")
def primary_lemma(v):
    return R.primary_lemma(v["lx_lexicon"])


@query("""WITH c AS (SELECT lemma, arg_min(synset_id, polysemy * 1000000 + vocab_id) AS c FROM lx_vocab GROUP BY 1), p AS (SELECT lemma, min(synset_id) AS a FROM lx_lexicon GROUP BY 1)
    SELECT word, coalesce(c, a) AS synset_id FROM (SELECT word FROM lx_lexicon_words UNION SELECT lemma FROM lx_vocab) w LEFT JOIN c ON c.lemma = word LEFT JOIN p ON p.lemma = word""")
def resolve_primary_synset(v):
    words = v["lx_lexicon_words"].union(v["lx_vocab"].select("lemma")).distinct()
    return R.resolve_primary_synset(words, v["lx_vocab"], v["lx_lexicon"])


@query("""WITH n AS (SELECT synset_id, count(*) AS n FROM lx_curated GROUP BY 1),
    c AS (SELECT l.lemma AS word, l.synset_id, coalesce(n, 0) AS n, CASE WHEN n IS NOT NULL THEN 0 WHEN e.synset_id IS NOT NULL THEN 1 ELSE 2 END AS step FROM lx_lexicon l LEFT JOIN n ON n.synset_id = l.synset_id LEFT JOIN lx_vocab e ON e.synset_id = l.synset_id)
    SELECT word, synset_id FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY step, n DESC, synset_id) AS k FROM c) WHERE k = 1""")
def resolve_best_synset(v):
    return R.resolve_best_synset(v["lx_lexicon_words"], v["lx_lexicon"], v["lx_curated"], v["lx_vocab"])


@query(f"""{FORGE} SELECT word, synset_id, source_synset_id FROM named n LEFT JOIN lx_ratings s ON s.synset_id = n.source_synset_id LEFT JOIN lx_ratings o ON o.synset_id = n.synset_id
    WHERE NOT coalesce(n.pos = 'n' AND n.source_pos = 'n' AND o.score + 0.5 < s.score, false)""".replace("SELECT word, synset_id, source", "SELECT word, n.synset_id, source"))
def concreteness_gate(v):
    return R.concreteness_gate(forge(v), v["lx_ratings"]).select("word", "synset_id", "source_synset_id")


@query("SELECT w.word, embedding[1]::DOUBLE AS first_value, len(embedding) AS dim FROM lx_lexicon_words w JOIN lx_word_vectors x ON x.lemma = w.word")
def embedding_lookup(v):
    return embeddings_of(v["lx_lexicon_words"], v["lx_word_vectors"]).select("word", F.col("embedding")[0].cast("double").alias("first_value"), F.size("embedding").alias("dim"))
