"""Queries of loaders, checks and frequencies."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexispark.functions import text as TX
from lexispark.functions.lineage import tables_dir
from lexispark.operators import frequency as FQ
from lexispark.plans.catalog import query
from lexispark.sources import sinks as K, tables as S

RARITY = "CASE WHEN {f} >= 5.5 THEN 'common' WHEN {f} >= 3.5 THEN 'unusual' WHEN {f} IS NOT NULL THEN 'rare' WHEN {z} >= 4.5 THEN 'common' WHEN {z} >= 2.5 THEN 'unusual' WHEN {z} IS NOT NULL THEN 'rare' ELSE 'unusual' END"


def senses(v):
    words = v["lx_counts"].select(F.xxhash64("tok").alias("wordid"), F.col("tok").alias("word"))
    sense = v["lx_lemmas"].select(F.xxhash64("lemma").alias("wordid"), F.col("synset_id").alias("synsetid"))
    syn = v["lx_synsets"].select(F.col("synset_id").alias("synsetid"), F.col("pos").alias("posid"), "definition")
    rel = v["lx_relations"].select(F.col("source_synset").alias("synset1id"), F.col("target_synset").alias("synset2id"), F.col("relation_type").alias("relationid"))
    return S.import_senses(words, sense, syn, rel)


@query("SELECT synset_id, pos, md5(definition) AS definition_md5 FROM lx_synsets")
def import_synsets(v):
    return senses(v)[0].select("synset_id", "pos", F.md5("definition").alias("definition_md5"))


@query("SELECT DISTINCT lemma, synset_id FROM lx_lemmas")
def import_lemmas(v):
    return senses(v)[1]


@query("SELECT * FROM lx_relations")
def import_relations(v):
    return senses(v)[2]


@query("SELECT syntagm_id, synset1id, synset2id, sensekey1, sensekey2, word1id, word2id FROM (SELECT l_orderkey * 10 + l_linenumber AS syntagm_id, l_returnflag AS sensekey1, l_linestatus AS sensekey2, l_linenumber::INT AS word1id, l_quantity::INT AS word2id, CASE WHEN l_quantity > 2 THEN l_partkey::VARCHAR END AS synset1id, CASE WHEN l_quantity < 49 THEN l_suppkey::VARCHAR END AS synset2id FROM lineitem) WHERE synset1id IS NOT NULL AND synset2id IS NOT NULL")
def import_collocations(v):
    li = v["lineitem"]
    return S.import_collocations(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("syntagm_id"), F.when(F.col("l_quantity") > 2, F.col("l_partkey")).alias("synset1id"), F.when(F.col("l_quantity") < 49, F.col("l_suppkey")).alias("synset2id"), F.col("l_returnflag").alias("sensekey1"), F.col("l_linestatus").alias("sensekey2"), F.col("l_linenumber").alias("word1id"), F.col("l_quantity").alias("word2id")))


def verbs(v):
    li, o = v["lineitem"], v["orders"]
    return S.import_verb_classes(
        v["supplier"].select((F.col("s_suppkey") % 40).alias("class_id"), F.col("s_name").alias("class_name")),
        li.select(F.col("l_suppkey").alias("class_id"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("synset_id"), F.col("l_linenumber").alias("wordid"), F.col("l_orderkey").alias("vnwordid")),
        li.select(F.col("l_suppkey").alias("class_id"), F.col("l_linenumber").alias("role_type_id")),
        v["nation"].select(F.col("n_nationkey").alias("role_type_id"), F.col("n_name").alias("role_type")),
        o.select(F.col("o_orderkey").alias("example_id"), F.col("o_orderpriority").alias("example")),
        li.select(F.col("l_orderkey").alias("example_id"), F.col("l_partkey").alias("frame_id")),
        v["part"].select(F.col("p_partkey").alias("frame_id"), F.col("p_size").alias("class_id")),
    )


@query("SELECT DISTINCT l_suppkey AS class_id, l_partkey AS synset_id, l_linenumber AS wordid, l_orderkey AS vnwordid FROM lineitem WHERE l_returnflag <> 'N'")
def verb_class_members(v):
    return verbs(v)["members"]


@query("SELECT s_suppkey % 40 AS class_id, min(s_name) AS class_name FROM supplier GROUP BY 1")
def verb_classes(v):
    return verbs(v)["classes"]


@query("SELECT l_suppkey AS class_id, n_name AS role_type FROM lineitem JOIN nation ON n_nationkey = l_linenumber")
def verb_class_roles(v):
    return verbs(v)["roles"]


@query("SELECT o_orderkey AS example_id, min(p_size) AS class_id, min(o_orderpriority) AS example FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def verb_class_examples(v):
    return verbs(v)["examples"]


RAW_FAM = "SELECT event_id AS row_no, ' Word' || (user_id * 7 + event_id % 40)::VARCHAR || ' ' AS w, CASE WHEN event_type = 'error' THEN 'NA' ELSE value::VARCHAR END AS fam, CASE WHEN event_type = 'view' THEN 'M' ELSE 'W' END AS et, CASE WHEN event_type = 'click' THEN '1,' || (event_id % 900 + 100)::VARCHAR ELSE (event_id % 90)::VARCHAR END AS n FROM events"


def raw_events(v):
    e = v["events"]
    word = F.concat(F.lit(" Word"), (F.col("user_id") * 7 + F.col("event_id") % 40).cast("string"), F.lit(" "))
    value = F.when(F.col("event_type") == "error", "NA").otherwise(F.col("value").cast("string"))
    count = F.when(F.col("event_type") == "click", F.concat(F.lit("1,"), (F.col("event_id") % 900 + 100).cast("string"))).otherwise((F.col("event_id") % 90).cast("string"))
    return e.select(F.col("event_id").alias("row_no"), word.alias("w"), value.alias("fam"), F.when(F.col("event_type") == "view", "M").otherwise("W").alias("et"), count.alias("n"))


@query(f"SELECT lower(trim(w)) AS word, arg_min(try_cast(fam AS DOUBLE), row_no) AS familiarity FROM ({RAW_FAM}) WHERE et = 'W' AND try_cast(fam AS DOUBLE) IS NOT NULL GROUP BY 1")
def load_familiarity(v):
    raw = raw_events(v).select("row_no", F.col("w").alias("Word"), F.col("fam").alias("Fam"), F.lit("1").alias("Dom"), F.lit("NA").alias("Zipf"), F.col("et").alias("EntryType"))
    return S.load_familiarity(raw).select("word", "familiarity")


@query(f"SELECT lower(trim(w)) AS word, arg_min(try_cast(fam AS DOUBLE), row_no) AS zipf, arg_min(try_cast(replace(n, ',', '') AS BIGINT), row_no) AS frequency FROM ({RAW_FAM}) WHERE try_cast(fam AS DOUBLE) IS NOT NULL GROUP BY 1")
def load_word_frequency(v):
    return S.load_word_frequency(raw_events(v).select("row_no", F.col("w").alias("word"), F.col("fam").alias("zipf"), F.col("n").alias("frequency")))


@query(f"SELECT lower(trim(w)) AS word, arg_min(try_cast(fam AS DOUBLE), row_no) AS score FROM ({RAW_FAM}) WHERE et <> 'M' AND try_cast(fam AS DOUBLE) IS NOT NULL GROUP BY 1")
def load_concreteness(v):
    return S.load_concreteness(raw_events(v).select("row_no", F.col("w").alias("Word"), F.when(F.col("et") == "M", "1").otherwise("0").alias("Bigram"), F.col("fam").alias("Conc.M")))


VEC_LINES = "SELECT CASE WHEN label = 3 THEN 'dup' ELSE 'w' || vec_id::VARCHAR END AS word, array_to_string(list_transform(embedding, lambda x: x::VARCHAR), ' ') || CASE WHEN label = 5 THEN ' oops' ELSE '' END AS vals, label, embedding, vec_id FROM embeddings"


@query(f"SELECT word, len(e) AS dim, round(list_sum(list_transform(e, lambda x: x::DOUBLE)), 4) + 0.0 AS total, round(e[7]::DOUBLE, 5) + 0.0 AS seventh FROM (SELECT word, arg_min(embedding, vec_id) AS e FROM ({VEC_LINES}) WHERE label <> 5 GROUP BY 1)")
def load_vectors(v):
    word = F.when(F.col("label") == 3, "dup").otherwise(F.concat(F.lit("w"), F.col("vec_id").cast("string")))
    values = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    lines = v["embeddings"].select("vec_id", F.concat(word, F.lit(" "), values, F.when(F.col("label") == 5, " oops").otherwise("")).alias("value"))
    return S.parse_vectors(lines, 64, ["vec_id"])[0].select(
        "word", F.size("embedding").cast("long").alias("dim"), (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4) + 0.0).alias("total"), (F.round(F.col("embedding")[6].cast("double"), 5) + 0.0).alias("seventh")
    )


@query("SELECT vec_id, label, CASE WHEN label <> 5 THEN round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0.0 END AS total, CASE WHEN label <> 5 THEN round(embedding[7]::DOUBLE, 5) + 0.0 END AS seventh FROM embeddings")
def decode_vectors(v):
    """Every vector as a blob of its bytes, those of one label cut short, and back."""
    blob = lambda batches: (pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([np.asarray(x, dtype="<f4").tobytes() for x in b.column("embedding").to_pylist()], type=pa.binary())], names=["vec_id", "label", "embedding"]) for b in batches)
    e = v["embeddings"].select("vec_id", "label", "embedding")
    blobs = e.mapInArrow(blob, f"vec_id {e.schema['vec_id'].dataType.simpleString()}, label {e.schema['label'].dataType.simpleString()}, embedding binary")
    blobs = blobs.withColumn("embedding", F.when(F.col("label") == 5, F.expr("substring(embedding, 1, 9)")).otherwise(F.col("embedding")))
    out = S.decode_vectors(blobs, 64)
    return out.select("vec_id", "label", (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4) + 0.0).alias("total"), (F.round(F.col("embedding")[6].cast("double"), 5) + 0.0).alias("seventh"))


@query("SELECT 'documents' AS table_name, count(*) AS n_rows FROM documents UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part")
def table_counts(v):
    return K.table_counts({t: v[t] for t in ("documents", "lineitem", "part")})


@query("SELECT x.a AS cluster_id, x.b AS opposed_id, count(*) AS n, round(sum(c.salience_sum), 6) AS salience_sum FROM lx_cluster_antonyms x JOIN lx_curated c ON c.cluster_id = x.a GROUP BY 1, 2")
def bucketed_curated(v):
    """The curated table, written in buckets of clusters, read by a join on the cluster."""
    table = K.write_bucketed(v["lx_curated"], f"lx_curated_{uuid.uuid4().hex}", "cluster_id", f"{tables_dir(v.spark)}/curated-{uuid.uuid4().hex}")
    sides = v["lx_cluster_antonyms"].select(F.col("a").alias("cluster_id"), F.col("b").alias("opposed_id"))
    return table.join(sides, "cluster_id").groupBy("cluster_id", "opposed_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("salience_sum"), 6).alias("salience_sum"))


@query("SELECT count(*) FILTER (a.synset_id IS NULL OR b.synset_id IS NULL) AS orphans, count(*) AS total, round(count(*) FILTER (a.synset_id IS NULL OR b.synset_id IS NULL) / count(*), 6) AS rate FROM lx_syntagms s LEFT JOIN lx_vocab a ON a.synset_id = s.synset1id LEFT JOIN lx_vocab b ON b.synset_id = s.synset2id")
def orphan_collocations(v):
    return K.orphan_collocations(v["lx_syntagms"], v["lx_vocab"]).withColumn("rate", F.round("rate", 6))


@query("SELECT (SELECT count(DISTINCT synset_id) FROM lx_ratings) AS scored, (SELECT count(DISTINCT synset_id) FROM lx_part_synsets) AS total, round(100 * (SELECT count(DISTINCT synset_id) FROM lx_ratings) / (SELECT count(DISTINCT synset_id) FROM lx_part_synsets), 1) AS pct")
def concreteness_coverage(v):
    return K.concreteness_coverage(v["lx_part_synsets"], v["lx_ratings"])


@query("""WITH per AS (SELECT count(*) AS k FROM lx_curated GROUP BY synset_id)
    SELECT 'method' AS metric, snap_method AS bucket, count(*)::DOUBLE AS n FROM lx_curated GROUP BY 2
    UNION ALL SELECT 'coverage', 'synsets', count(*) FROM per UNION ALL SELECT 'coverage', 'at least 3', count(*) FILTER (k >= 3) FROM per UNION ALL SELECT 'coverage', 'at least 5', count(*) FILTER (k >= 5) FROM per
    UNION ALL SELECT 'coverage', 'at least 8', count(*) FILTER (k >= 8) FROM per UNION ALL SELECT 'coverage', 'average', round(avg(k), 6) FROM per
    UNION ALL SELECT 'score', CASE WHEN snap_score < 0.75 THEN 'below 0.75' WHEN snap_score < 0.8 THEN '0.75-0.80' WHEN snap_score < 0.85 THEN '0.80-0.85' WHEN snap_score < 0.9 THEN '0.85-0.90' WHEN snap_score < 0.95 THEN '0.90-0.95' ELSE '0.95 and above' END, count(*) FROM lx_curated WHERE snap_method = 'embedding' GROUP BY 2""")
def snap_audit(v):
    return K.snap_audit(v["lx_curated"])


@query("""WITH pol AS (SELECT lemma, count(DISTINCT synset_id) AS p FROM lx_lemmas GROUP BY 1),
    f AS (SELECT synset_id, coalesce(max(familiarity), 0) AS f, coalesce(max(zipf), 0) AS z, min(p) AS p FROM lx_lemmas l JOIN pol USING (lemma) LEFT JOIN lx_frequencies_raw r ON r.word = l.lemma GROUP BY 1),
    r AS (SELECT pos, p, row_number() OVER (ORDER BY f DESC, z DESC, s.synset_id) AS k FROM lx_synsets s JOIN f USING (synset_id)),
    w AS (SELECT top_n, pos, p FROM r, (SELECT unnest([100, 500, 5000]) AS top_n) WHERE k <= top_n UNION ALL SELECT top_n, 'all', p FROM r, (SELECT unnest([100, 500, 5000]) AS top_n) WHERE k <= top_n),
    c AS (SELECT top_n, pos, (CASE WHEN p <= 3 THEN p WHEN p <= 5 THEN 5 WHEN p <= 10 THEN 10 ELSE 999 END)::INT AS min_polysemy, count(*) AS n FROM w GROUP BY ALL)
    SELECT *, round(100 * n / sum(n) OVER (PARTITION BY top_n, pos), 4) AS pct, round(100 * sum(n) OVER (PARTITION BY top_n, pos ORDER BY min_polysemy) / sum(n) OVER (PARTITION BY top_n, pos), 4) AS cumulative_pct FROM c""")
def polysemy_coverage(v):
    return K.polysemy_coverage(v["lx_synsets"], v["lx_lemmas"], v["lx_frequencies_raw"].withColumnRenamed("word", "lemma"), (100, 500, 5000), distinct=True)


@query("SELECT synset_id, cluster_id, concat_ws('|', CASE WHEN snap_score > 0.85 THEN 'score' END, CASE WHEN salience_sum < 1.4 THEN 'salience' END) AS broken FROM lx_curated")
def validate_rows(v):
    good, bad = K.validate_rows(v["lx_curated"], {"score": F.col("snap_score") <= 0.85, "salience": F.col("salience_sum") >= 1.4})
    return good.select("synset_id", "cluster_id", F.lit("").alias("broken")).union(bad.select("synset_id", "cluster_id", F.array_join("broken", "|")))


@query(f"SELECT word, {RARITY.format(f='familiarity', z='zipf')} AS rarity FROM lx_frequencies_raw")
def rarity(v):
    return v["lx_frequencies_raw"].select("word", TX.rarity(F.col("familiarity"), F.col("zipf")).alias("rarity"))


@query("SELECT synset_id, CASE pos WHEN 'n' THEN 'noun' WHEN 'v' THEN 'verb' WHEN 'a' THEN 'adjective' WHEN 'r' THEN 'adverb' WHEN 's' THEN 'adjective satellite' ELSE pos END AS pos_name FROM lx_synsets")
def pos_names(v):
    return v["lx_synsets"].select("synset_id", TX.pos_name(F.col("pos")).alias("pos_name"))


@query("SELECT turn, conv_id, md5(lower(trim(text))) AS norm_md5, len(regexp_extract_all(text, '\\S+')) <= 1 AND text NOT LIKE '%-%' AS single FROM conversations")
def normalised_turns(v):
    return v["conversations"].select("turn", "conv_id", F.md5(TX.normalise_text(F.col("text"))).alias("norm_md5"), TX.filter_mwe(F.col("text")).alias("single"))


@query("""WITH c AS (SELECT tok AS word, CASE WHEN tok LIKE '%ing' AND length(tok) > 5 THEN [tok[:-4], tok[:-4] || 'e'] WHEN tok LIKE '%ed' AND length(tok) > 4 THEN [tok[:-3], tok[:-2]] ELSE [] END AS vs FROM lx_counts)
    SELECT word, (i - 1)::INT AS variant_no, vs[i] AS variant FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM c)""")
def morph_variants(v):
    return TX.morph_variants(v["lx_counts"].withColumnRenamed("tok", "word"))


@query("SELECT idx, human_ans AS marked FROM lx_marked")
def extract_marked(v):
    return v["lx_marked"].select("idx", TX.extract_marked(F.col("s0")).alias("marked"))


def frequencies(v):
    lemmas = v["lx_counts"].select(F.col("tok").alias("lemma")).union(v["lx_lexicon_words"])
    fam = v["lx_frequencies_raw"].filter("familiarity is not null").select("word", "familiarity", F.lit(1).alias("familiarity_dominant"), F.when(F.col("n") % 2 == 0, F.col("zipf")).alias("zipf"))
    return FQ.build_frequencies(lemmas, fam)


FREQ = f"""f AS (SELECT lemma, familiarity, CASE WHEN familiarity IS NOT NULL THEN 1 END AS familiarity_dominant, CASE WHEN familiarity IS NOT NULL AND n % 2 = 0 THEN zipf END AS zipf, NULL::BIGINT AS frequency, CASE WHEN familiarity IS NOT NULL THEN 'brysbaert' END AS source
    FROM (SELECT tok AS lemma FROM lx_counts UNION SELECT word FROM lx_lexicon_words) l LEFT JOIN lx_frequencies_raw r ON r.word = l.lemma),
    fr AS (SELECT *, {RARITY.format(f='familiarity', z='zipf')} AS rarity FROM f)"""


@query(f"WITH {FREQ} SELECT * FROM fr")
def build_frequencies(v):
    return frequencies(v)


@query(f"""WITH {FREQ} SELECT lemma, fr.familiarity, familiarity_dominant, coalesce(r.zipf, fr.zipf) AS zipf, r.n::BIGINT AS frequency,
    CASE WHEN r.word IS NOT NULL AND source = 'brysbaert' THEN 'brysbaert+subtlex' WHEN r.word IS NOT NULL THEN 'subtlex' ELSE source END AS source,
    CASE WHEN r.word IS NOT NULL AND fr.familiarity IS NULL THEN {RARITY.format(f='NULL::DOUBLE', z='r.zipf')} ELSE rarity END AS rarity FROM fr LEFT JOIN lx_frequencies_raw r ON r.word = lemma""")
def backfill_frequency(v):
    return FQ.backfill_frequency(frequencies(v), v["lx_frequencies_raw"].select("word", "zipf", F.col("n").alias("frequency")))
