"""Queries of enrichment, vocabulary, snapping, clustering and concreteness."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import concreteness as C, enrichment as E, similarity as M, vocabulary as V
from lexispark.plans.catalog import query
from lexispark.plans.retrieval_queries import COS
from lexispark.sources import tables as S

CAPPED = "(SELECT * FROM lx_properties WHERE pos_in_list <= 15)"


def raw(v):
    """Enrichment documents as JSON: text properties in one half, objects in the other; some under the old key."""
    p = v["lx_properties"].select("synset_id", "pos_in_list", "text", "salience", "property_type")
    v2 = F.length("synset_id") % 2 == 1
    item = F.when(v2, F.to_json(F.struct("text", "salience", F.col("property_type").alias("type")))).otherwise(F.to_json(F.array("text")))
    lists = p.groupBy("synset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos_in_list", F.when(v2, item).otherwise(F.concat(F.lit('"'), "text", F.lit('"'))).alias("j")))), lambda x: x["j"]), ",").alias("props"))
    key = F.when(F.length("synset_id") == 3, "results").otherwise("synsets")
    return lists.select(F.concat(F.lit('{"'), key, F.lit('":[{"id":"'), "synset_id", F.lit('","lemma":"w","pos":"n","properties":['), "props", F.lit('],"lemma_metadata":[{"lemma":"l'), F.length("synset_id").cast("string"), F.lit('","register":"neutral","connotation":"positive"}]}],"config":{"model":"m"}}')).alias("json"))


def enriched(v):
    return S.parse_enrichment(raw(v))


def properties(v):
    return v["lx_properties"].withColumns({"doc_no": F.lit(0), "row_no": F.lit(0)})


@query(f"SELECT synset_id, pos_in_list::INT AS pos_in_list, text, CASE WHEN length(synset_id) % 2 = 1 THEN salience ELSE 1.0 END AS salience, CASE WHEN length(synset_id) % 2 = 1 THEN property_type END AS property_type FROM {CAPPED}")
def explode_properties(v):
    return S.explode_properties(enriched(v)).select("synset_id", "pos_in_list", "text", "salience", "property_type")


@query("SELECT 'l' || length(synset_id)::VARCHAR AS lemma, synset_id, 'neutral' AS register, 'positive' AS connotation FROM (SELECT DISTINCT synset_id FROM lx_properties)")
def populate_lemma_metadata(v):
    return E.populate_lemma_metadata(enriched(v))


def vocabulary(v):
    return E.curate_properties(properties(v), v["lx_vectors"])


@query("SELECT row_number() OVER (ORDER BY text) AS property_id, text, lemma IS NULL AS is_oov, 'pilot' AS source FROM (SELECT DISTINCT text FROM lx_properties) LEFT JOIN lx_vectors ON lemma = text")
def curate_properties(v):
    return vocabulary(v).drop("embedding")


@query("WITH p AS (SELECT *, dense_rank() OVER (ORDER BY text) AS property_id FROM lx_properties) SELECT synset_id, property_id, salience, property_type, relation FROM p")
def populate_properties(v):
    return E.populate_properties(properties(v), vocabulary(v))


@query("SELECT count(*) AS total, count(DISTINCT text) AS unique_properties, (SELECT count(*) FROM lx_synsets) AS synsets, round(count(*) / (SELECT count(*) FROM lx_synsets), 2) AS average FROM lx_properties")
def enrichment_stats(v):
    return E.enrichment_stats(v["lx_properties"], v["lx_synsets"])


@query("SELECT text AS property, count(*) AS n FROM lx_properties GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def top_properties(v):
    return E.top_properties(v["lx_properties"])


DIST = """SELECT 'total' AS metric, count(*)::DOUBLE AS value FROM lx_properties UNION ALL SELECT 'unique', count(DISTINCT text) FROM lx_properties UNION ALL SELECT 'uniqueness', round(count(DISTINCT text) / count(*), 3) FROM lx_properties
    UNION ALL SELECT 'per synset', round(count(*) / (SELECT count(*) FROM lx_synsets), 2) FROM lx_properties UNION ALL SELECT 'physical per synset', round(count(*) FILTER (property_type = 'physical') / (SELECT count(*) FROM lx_synsets), 2) FROM lx_properties
    UNION ALL SELECT 'type ' || coalesce(property_type, 'unknown'), round(100 * count(*) / (SELECT count(*) FROM lx_properties), 1) FROM lx_properties GROUP BY property_type
    UNION ALL SELECT 'property ' || text, n FROM (SELECT text, count(*) AS n FROM lx_properties GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)"""


@query(DIST)
def property_distribution(v):
    return E.property_distribution(v["lx_properties"], v["lx_synsets"])


SPOKEN = "(SELECT CAST(turn AS STRING) AS synset_id, role AS text, CASE WHEN turn % 2 = 0 THEN 'physical' END AS property_type FROM conversations)"


@query(f"SELECT metric, a.value AS a, b.value AS b, round(coalesce(b.value, 0) - coalesce(a.value, 0), 6) AS delta FROM ({DIST}) a FULL JOIN ({DIST.replace('lx_properties', SPOKEN).replace('lx_synsets', 'conversations')}) b USING (metric)")
def compare_distributions(v):
    spoken = v["conversations"].select(F.col("turn").cast("string").alias("synset_id"), F.col("role").alias("text"), F.when(F.col("turn") % 2 == 0, "physical").alias("property_type"))
    return E.compare_distributions((v["lx_properties"], v["lx_synsets"]), (spoken, v["conversations"]))


AUDIT = "SELECT s.synset_id, pos, coalesce(k, 0) AS n_physical, coalesce(k, 0) < CASE pos WHEN 'n' THEN 4 ELSE 2 END AS flagged FROM lx_synsets s LEFT JOIN (SELECT synset_id, count(*) AS k FROM lx_properties WHERE property_type = 'physical' GROUP BY 1) p ON p.synset_id = s.synset_id"


@query(AUDIT)
def audit_physical(v):
    return E.audit_physical(v["lx_synsets"], v["lx_properties"])


@query(f"SELECT pos, count(*) AS total, count(*) FILTER (flagged) AS flagged, round(avg(n_physical), 2) AS avg_physical, round(100 * count(*) FILTER (flagged) / count(*), 1) AS flagged_pct FROM ({AUDIT}) GROUP BY 1")
def physical_summary(v):
    return E.physical_summary(E.audit_physical(v["lx_synsets"], v["lx_properties"]))


@query("WITH p AS (SELECT count(*) AS k FROM lx_curated GROUP BY vocab_id) SELECT (SELECT count(*) FROM p) AS vocabulary, (SELECT count(*) FROM p WHERE k = 1) AS hapax, round((SELECT count(*) FROM p WHERE k = 1) / (SELECT count(*) FROM p), 4) AS hapax_rate, round((SELECT count(*) FROM lx_curated) / (SELECT count(DISTINCT synset_id) FROM lx_curated), 4) AS average")
def curated_quality(v):
    return E.curated_quality(v["lx_curated"])


@query("""WITH l AS (SELECT synset_id, list_sort(list(DISTINCT lemma)) AS a FROM lx_lexicon GROUP BY 1),
    r AS (SELECT s.synset_id, (row_number() OVER (ORDER BY s.synset_id) - 1) // 20 AS batch_no, 'ID: ' || s.synset_id || chr(10) || 'Word: ' || a[1] || CASE WHEN len(a) > 1 THEN chr(10) || 'Lemmas: ' || array_to_string(a, ', ') ELSE '' END || chr(10) || 'Definition: ' || definition AS block FROM lx_part_synsets s JOIN l ON l.synset_id = s.synset_id)
    SELECT batch_no, string_agg(synset_id, '|' ORDER BY synset_id) AS synset_ids, string_agg(block, chr(10) || chr(10) ORDER BY synset_id) AS payload FROM r GROUP BY 1""")
def format_batches(v):
    return E.format_batches(v["lx_part_synsets"], v["lx_lexicon"]).withColumn("synset_ids", F.array_join("synset_ids", "|"))


BATCH = "(SELECT synset_id, min(lemma) AS lemma FROM lx_words WHERE lemma NOT LIKE 'brand#1 %' GROUP BY 1)"


@query(f"""WITH r AS (SELECT synset_id, count(DISTINCT cluster_id) AS n FROM lx_curated GROUP BY 1)
    SELECT r.synset_id, lemma, definition, pos, n, false AS rejected FROM r JOIN lx_part_synsets p ON p.synset_id = r.synset_id JOIN {BATCH} l ON l.synset_id = r.synset_id
    UNION ALL SELECT synset_id, NULL, NULL, NULL, NULL, true FROM r WHERE synset_id NOT IN (SELECT synset_id FROM {BATCH} l)""")
def merge_batch_results(v):
    known = v["lx_words"].filter("lemma NOT LIKE 'brand#1 %'")  # results of one brand are not of this batch
    batch = v["lx_part_synsets"].join(known.groupBy("synset_id").agg(F.min("lemma").alias("lemma")), "synset_id")
    results = v["lx_curated"].groupBy(F.col("synset_id").alias("id")).agg(F.collect_list(F.struct(F.col("cluster_id").cast("string").alias("text"), F.lit("x").alias("type"))).alias("properties"))
    merged, unknown = E.merge_batch_results(batch, results, "physical")
    merged = merged.select("synset_id", "lemma", "definition", "pos", F.size(F.filter("properties", lambda p: p["type"] == "physical")).cast("long").alias("n"), F.lit(False).alias("rejected"))
    return merged.unionByName(unknown.select(F.col("id").alias("synset_id"), F.lit(True).alias("rejected")), allowMissingColumns=True)


@query("SELECT synset_id, pos FROM lx_part_synsets WHERE synset_id NOT IN (SELECT synset_id FROM lx_vocab)")
def resume_filter(v):
    return E.resume_filter(v["lx_part_synsets"].select("synset_id", "pos"), v["lx_vocab"])


@query("SELECT p.synset_id, p.pos, p.definition, o.lemma AS connotation, coalesce(string_agg(x.lemma, '|' ORDER BY x.lemma), '') AS properties FROM lx_part_synsets p LEFT JOIN lx_vocab o ON o.synset_id = p.synset_id LEFT JOIN lx_curated c ON c.synset_id = p.synset_id LEFT JOIN lx_vocab x ON x.vocab_id = c.vocab_id GROUP BY 1, 2, 3, 4")
def synset_detail(v):
    vocab = v["lx_vocab"].select(F.col("vocab_id").alias("property_id"), F.col("lemma").alias("text"))
    links = v["lx_curated"].select("synset_id", F.col("vocab_id").alias("property_id"))
    out = E.synset_detail(v["lx_part_synsets"].select("synset_id"), v["lx_part_synsets"], v["lx_vocab"].select("synset_id", F.col("lemma").alias("connotation")), links, vocab)
    return out.withColumn("properties", F.array_join("properties", "|"))


def freqs(v):
    return v["lx_frequencies_raw"].select(F.col("word").alias("lemma"), "familiarity")


@query("""WITH f AS (SELECT synset_id, lemma, coalesce(familiarity, 0) AS fam FROM lx_lemmas l LEFT JOIN lx_frequencies_raw r ON r.word = l.lemma),
    b AS (SELECT synset_id, max(fam) AS m, count(*) AS n, min(struct_pack(f := -fam, l := lemma)).l AS lemma FROM f GROUP BY 1),
    r AS (SELECT s.synset_id, b.lemma, s.pos, n, CASE WHEN q.synset_id IS NOT NULL THEN 0 ELSE 1 END AS first, m, q.synset_id IS NULL AS pad FROM lx_synsets s JOIN b USING (synset_id) LEFT JOIN lx_vocab q ON q.synset_id = s.synset_id),
    pad AS (SELECT * FROM r WHERE pad AND synset_id NOT IN (SELECT synset_id FROM lx_ratings) ORDER BY m DESC, synset_id LIMIT greatest(0, 500 - (SELECT count(*) FROM r WHERE NOT pad)) OFFSET 5)
    SELECT synset_id, lemma, pos, n, row_number() OVER (ORDER BY first, m DESC, synset_id) AS rank FROM (SELECT * FROM r WHERE NOT pad UNION ALL SELECT * FROM pad)""")
def rank_synsets_for_enrichment(v):
    out = E.rank_synsets_for_enrichment(v["lx_synsets"], v["lx_lemmas"], freqs(v), v["lx_ratings"], 500, 5, v["lx_vocab"])  # the operator's page
    return out.select("synset_id", "lemma", "pos", F.size("all_lemmas").cast("long").alias("n"), "rank")


@query("""WITH need AS (SELECT synset_id, pos, true AS is_required FROM lx_part_synsets WHERE synset_id IN (SELECT synset_id FROM lx_vocab)), k AS (SELECT 1000 - count(*) AS n FROM need),
    r AS (SELECT synset_id, pos, row_number() OVER (PARTITION BY pos ORDER BY md5(synset_id || ':42'), synset_id) AS i FROM lx_part_synsets WHERE synset_id NOT IN (SELECT synset_id FROM lx_vocab))
    SELECT * FROM need UNION ALL SELECT synset_id, pos, false FROM r, k WHERE i <= trunc(k.n * CASE pos WHEN 'n' THEN 0.4 WHEN 'v' THEN 0.4 WHEN 'a' THEN 0.2 ELSE 0 END)""")
def stratified_pilot(v):
    return E.stratified_pilot(v["lx_part_synsets"], 1000, v["lx_vocab"])


@query("SELECT lemma, count(DISTINCT synset_id) AS polysemy FROM lx_lemmas GROUP BY 1")
def lemma_polysemy(v):
    return V.lemma_polysemy(v["lx_lemmas"], distinct=True)


@query("SELECT synset_id, max(coalesce(familiarity, 0)) AS max_familiarity FROM lx_lemmas LEFT JOIN lx_frequencies_raw ON word = lemma GROUP BY 1")
def synset_familiarity(v):
    return V.synset_familiarity(v["lx_lemmas"], freqs(v))


@query("""WITH RECURSIVE pol AS (SELECT lemma, count(DISTINCT synset_id) AS p FROM lx_lemmas GROUP BY 1),
    fam AS (SELECT synset_id, max(coalesce(familiarity, 0)) AS m FROM lx_lemmas LEFT JOIN lx_frequencies_raw ON word = lemma GROUP BY 1),
    ranked AS (SELECT synset_id, pos, row_number() OVER (ORDER BY m DESC, synset_id) AS vocab_id FROM lx_synsets JOIN fam USING (synset_id)),
    lists AS (SELECT vocab_id, list(l.lemma ORDER BY p, length(l.lemma), l.lemma) AS ls FROM ranked r JOIN lx_lemmas l ON l.synset_id = r.synset_id JOIN pol ON pol.lemma = l.lemma GROUP BY 1),
    w(vocab_id, pick, shared, taken) AS (SELECT 0::BIGINT, ''::VARCHAR, false, []::VARCHAR[]
      UNION ALL SELECT vocab_id, coalesce(pick, ls[1]), pick IS NULL, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END FROM (SELECT l.vocab_id, ls, taken, list_filter(ls, lambda x: NOT list_contains(taken, x))[1] AS pick FROM w JOIN lists l ON l.vocab_id = w.vocab_id + 1))
    SELECT w.vocab_id, synset_id, pick AS lemma, pos, p AS polysemy, shared AS is_shared FROM w JOIN ranked r ON r.vocab_id = w.vocab_id JOIN pol ON pol.lemma = pick""")
def build_vocabulary(v):
    return V.build_vocabulary(v["lx_synsets"], v["lx_lemmas"], freqs(v), distinct=True)


@query("SELECT l.lemma, len(embedding) AS dim FROM (SELECT DISTINCT lemma FROM lx_lemmas) l JOIN lx_vectors x ON x.lemma = l.lemma")
def attach_lemma_embeddings(v):
    return V.attach_lemma_embeddings(v["lx_lemmas"], v["lx_vectors"]).select("lemma", F.size("embedding").alias("dim"))


ANT = "WITH m AS (SELECT DISTINCT target_synset AS t, vocab_id FROM lx_relations JOIN lx_vocab ON synset_id = source_synset WHERE relation_type = '60') SELECT DISTINCT x.vocab_id AS a, y.vocab_id AS b FROM m x JOIN m y ON x.t = y.t AND x.vocab_id <> y.vocab_id"


@query(ANT)
def antonym_pairs(v):
    return V.antonym_pairs(v["lx_relations"], v["lx_vocab"])


@query("SELECT DISTINCT coalesce(p.cluster_id, c.a) AS a, coalesce(q.cluster_id, c.b) AS b FROM lx_cluster_antonyms c LEFT JOIN lx_snap_clusters p ON p.vocab_id = c.a LEFT JOIN lx_snap_clusters q ON q.vocab_id = c.b WHERE coalesce(p.cluster_id, c.a) <> coalesce(q.cluster_id, c.b) UNION SELECT DISTINCT coalesce(q.cluster_id, c.b), coalesce(p.cluster_id, c.a) FROM lx_cluster_antonyms c LEFT JOIN lx_snap_clusters p ON p.vocab_id = c.a LEFT JOIN lx_snap_clusters q ON q.vocab_id = c.b WHERE coalesce(p.cluster_id, c.a) <> coalesce(q.cluster_id, c.b)")
def cluster_antonyms(v):
    return V.cluster_antonyms(v["lx_cluster_antonyms"], v["lx_snap_clusters"])


SIM = f"SELECT a, b, s FROM (SELECT a, b, {COS} AS s FROM (SELECT x.vec_id AS a, y.vec_id AS b, x.embedding AS va, y.embedding AS vb FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)) WHERE s >= 0.3"


@query(f"SELECT a, b, round(s, 5) AS similarity FROM ({SIM})")
def similar_pairs(v):
    return M.similar_pairs(v["embeddings"], 0.3, "vec_id").withColumn("similarity", F.round("similarity", 5))


CLUSTERS = f"""sim AS MATERIALIZED ({SIM}), sym AS (SELECT a, b FROM sim UNION ALL SELECT b, a FROM sim),
    walk(node, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT sym.b, walk.low FROM walk JOIN sym ON sym.a = walk.node WHERE walk.low < sym.b),
    c AS (SELECT node AS vocab_id, min(low) AS cluster_id FROM walk GROUP BY 1)"""


def clusters(v):
    e = v["embeddings"]
    return M.cluster_vocab(e.select(F.col("vec_id").alias("vocab_id"), F.col("vec_id").cast("string").alias("lemma")), e.select(F.col("vec_id").cast("string").alias("lemma"), "embedding"), 0.3)


@query(f"WITH RECURSIVE {CLUSTERS} SELECT vocab_id, cluster_id, vocab_id = cluster_id AS is_representative, count(*) OVER (PARTITION BY cluster_id) = 1 AS is_singleton FROM c")
def cluster_vocab(v):
    return clusters(v)


@query(f"WITH RECURSIVE {CLUSTERS}, k AS (SELECT count(*) AS k FROM c GROUP BY cluster_id) SELECT count(*) AS clusters, count(*) FILTER (k = 1) AS singletons, max(k) AS largest FROM k")
def cluster_stats(v):
    return M.cluster_stats(clusters(v))


SNAP = f"""vlow AS (SELECT lemma, min(vocab_id) AS vocab_id FROM lx_snap_vocab GROUP BY 1), props AS (SELECT property_id, text, embedding FROM lx_snap_properties),
    ex AS (SELECT property_id, vocab_id FROM props JOIN vlow ON lemma = text),
    va AS (SELECT property_id, text, unnest(vs) AS variant, unnest(range(len(vs))) AS i FROM (SELECT property_id, text, CASE WHEN text LIKE '%ing' AND length(text) > 5 THEN [text[:-4], text[:-4] || 'e'] WHEN text LIKE '%ed' AND length(text) > 4 THEN [text[:-3], text[:-2]] ELSE [] END AS vs FROM props WHERE property_id NOT IN (SELECT property_id FROM ex))),
    mo AS (SELECT property_id, arg_min(vocab_id, i) AS vocab_id FROM va JOIN vlow ON lemma = variant GROUP BY 1),
    base AS (SELECT v.vocab_id, embedding FROM lx_snap_vocab v JOIN props ON text = lemma WHERE embedding IS NOT NULL),
    near AS MATERIALIZED (SELECT property_id, vocab_id, round({COS}, 9) AS s FROM (SELECT p.property_id, b.vocab_id, p.embedding AS va, b.embedding AS vb FROM props p, base b WHERE p.embedding IS NOT NULL AND p.property_id NOT IN (SELECT property_id FROM ex) AND p.property_id NOT IN (SELECT property_id FROM mo))),
    em AS (SELECT property_id, vocab_id, s FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY s DESC, vocab_id) AS k FROM near) WHERE k = 1),
    hit AS (SELECT property_id, vocab_id, 'exact' AS m, NULL::DOUBLE AS s, 1 AS o FROM ex UNION ALL SELECT property_id, vocab_id, 'morphological', NULL, 2 FROM mo UNION ALL SELECT property_id, vocab_id, 'embedding', s, 3 FROM em WHERE s >= 0.3)"""


def snapped(v):
    return M.snap_links(v["lx_snap_links"], v["lx_snap_properties"], v["lx_snap_vocab"], 0.3)


@query(f"WITH {SNAP} SELECT synset_id, l.property_id, vocab_id, m AS snap_method, round(s, 5) AS snap_score FROM lx_snap_links l JOIN hit ON hit.property_id = l.property_id")
def snap_links(v):
    return snapped(v).select("synset_id", "property_id", "vocab_id", "snap_method", F.round("snap_score", 5).alias("snap_score"))


@query(f"""WITH {SNAP}, j AS (SELECT l.synset_id, c.cluster_id, l.property_id, hit.vocab_id, m, s, o, salience FROM lx_snap_links l JOIN hit ON hit.property_id = l.property_id JOIN lx_snap_clusters c ON c.vocab_id = hit.vocab_id)
    SELECT synset_id, cluster_id, arg_min(vocab_id, o * 10000000 + property_id) AS vocab_id, arg_min(m, o * 10000000 + property_id) AS snap_method, round(arg_min(coalesce(s, -9), o * 10000000 + property_id), 5) AS snap_score, round(sum(salience), 6) AS salience_sum FROM j GROUP BY 1, 2""")
def snap_properties(v):
    out = M.snap_properties(v["lx_snap_links"], v["lx_snap_properties"], v["lx_snap_vocab"], v["lx_snap_clusters"], 0.3)
    return out.select("synset_id", "cluster_id", "vocab_id", "snap_method", F.round(F.coalesce("snap_score", F.lit(-9.0)), 5).alias("snap_score"), F.round("salience_sum", 6).alias("salience_sum"))


@query(f"WITH {SNAP} SELECT reason, count(*) AS n, round(max(s), 5) AS best FROM (SELECT CASE WHEN p.embedding IS NULL THEN 'no_embedding' ELSE 'below_threshold' END AS reason, em.s FROM lx_snap_links l JOIN props p ON p.property_id = l.property_id LEFT JOIN em ON em.property_id = l.property_id WHERE l.property_id NOT IN (SELECT property_id FROM hit)) GROUP BY 1")
def snap_rejects(v):
    out = M.snap_rejects(v["lx_snap_links"], snapped(v), v["lx_snap_properties"], v["lx_snap_vocab"])
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("best_score"), 5).alias("best"))


@query(f"WITH {SNAP} SELECT coalesce(m, 'dropped') AS stage, count(*) AS n FROM lx_snap_links l LEFT JOIN hit ON hit.property_id = l.property_id GROUP BY 1")
def snap_counts(v):
    return M.snap_counts(v["lx_snap_links"], snapped(v))


def vectors(v):
    return v["embeddings"].select(F.col("vec_id").cast("string").alias("synset_id"), "embedding")


@query("SELECT synset_id, max(zipf) AS score, 'brysbaert' AS source FROM lx_lemmas JOIN lx_frequencies_raw ON word = lemma GROUP BY 1")
def concreteness_by_synset(v):
    return C.concreteness_by_synset(v["lx_lemmas"], v["lx_frequencies_raw"].select("word", F.col("zipf").alias("score")))


@query("SELECT synset_id, i::INT AS i, round(avg(x)::FLOAT::DOUBLE, 4) + 0.0 AS m FROM (SELECT synset_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM lx_lemmas l JOIN lx_vectors x ON x.lemma = l.lemma) GROUP BY 1, 2")
def synset_embeddings(v):
    out = C.synset_embeddings(v["lx_lemmas"], v["lx_vectors"]).select("synset_id", F.posexplode("embedding").alias("i", "m"))
    return out.withColumn("m", F.round(F.col("m").cast("double"), 4) + 0.0)


@query("SELECT r.synset_id, score, len(embedding) AS dim FROM lx_ratings r JOIN embeddings e ON e.vec_id::VARCHAR = r.synset_id")
def concreteness_training(v):
    return C.concreteness_training(vectors(v), v["lx_ratings"]).select("synset_id", "score", F.size("embedding").alias("dim"))


KNN = f"""d AS (SELECT q, t, sqrt(list_sum(list_transform(range(1, 65), lambda i: (va[i]::DOUBLE - vb[i]::DOUBLE) * (va[i]::DOUBLE - vb[i]::DOUBLE)))) AS d, score FROM (SELECT x.vec_id::VARCHAR AS q, r.synset_id AS t, x.embedding AS va, y.embedding AS vb, r.score FROM embeddings x, lx_ratings r JOIN embeddings y ON y.vec_id::VARCHAR = r.synset_id WHERE x.vec_id::VARCHAR NOT IN (SELECT synset_id FROM lx_ratings))),
    k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), t) AS k FROM d), p AS (SELECT q AS synset_id, sum(score / d) / sum(1 / d) AS p FROM k WHERE k <= 10 GROUP BY 1)"""


@query(f"WITH {KNN} SELECT synset_id AS id, round(p, 5) AS prediction FROM p")
def knn_regress(v):
    train = C.concreteness_training(vectors(v), v["lx_ratings"]).withColumnRenamed("synset_id", "id")
    rest = vectors(v).join(v["lx_ratings"], "synset_id", "left_anti").withColumnRenamed("synset_id", "id")
    return M.knn_regress(train, rest).withColumn("prediction", F.round("prediction", 5))


@query(f"WITH {KNN} SELECT synset_id, round(score, 4) AS score, source FROM lx_ratings UNION ALL SELECT synset_id, round(greatest(1, least(5, p)), 4), 'fasttext_regression' FROM p")
def fill_concreteness(v):
    return C.fill_concreteness(vectors(v), v["lx_ratings"]).withColumn("score", F.round("score", 4))


@query(f"WITH {KNN} SELECT (SELECT count(*) FROM p) AS deleted, (SELECT count(*) FROM lx_ratings) AS retained")
def revert_predictions(v):
    return C.revert_predictions(C.fill_concreteness(vectors(v), v["lx_ratings"]))[1]


@query()
def model_shootout(v):
    return C.model_shootout(C.concreteness_training(vectors(v), v["lx_ratings"]))


@query("""WITH t AS (SELECT DISTINCT source || '/' || target AS text, source, target FROM lx_gold), p AS (SELECT text, source AS lemma FROM t UNION ALL SELECT text, target FROM t)
    SELECT text, i::INT AS i, round(avg(x)::FLOAT::DOUBLE, 4) + 0.0 AS m FROM (SELECT text, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM p JOIN lx_vectors v ON v.lemma = p.lemma) GROUP BY 1, 2""")
def compound_embedding(v):
    texts = v["lx_gold"].select(F.concat("source", F.lit("/"), "target").alias("text"))
    out = E.compound_embedding(texts, v["lx_vectors"]).select("text", F.posexplode("embedding").alias("i", "m"))
    return out.withColumn("m", F.round(F.col("m").cast("double"), 4) + 0.0)


@query("SELECT word_a AS target, word_b AS paraphrase, class AS label FROM lx_aptness_pairs WHERE class = 'inapt'")
def load_controls(v):
    lines = v["lx_aptness_pairs"].select(F.to_json(F.struct(F.col("class").alias("label"), F.col("word_a").alias("target"), F.col("word_b").alias("paraphrase"))).alias("value"))
    return S.parse_controls(lines)[0].select("target", "paraphrase", "label")


@query("SELECT c.source, l.synset_id, d.first_value FROM (SELECT DISTINCT source FROM lx_gold) c JOIN lx_lemmas l ON l.lemma = c.source JOIN (SELECT lemma, embedding[1]::DOUBLE AS first_value FROM lx_vectors) d ON d.lemma = c.source")
def gold_senses(v):
    words = v["lx_gold"].select("source").distinct().withColumnRenamed("source", "lemma")
    found = words.join(v["lx_lemmas"], "lemma").join(v["lx_vectors"], "lemma")
    return found.select(F.col("lemma").alias("source"), "synset_id", F.col("embedding")[0].cast("double").alias("first_value"))
