"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexispark.functions.lineage import tables_dir
from lexispark.llm import centroids, decontaminate, divergence, exact_dedup, language, mixing, ngram_join, quality, sharding, suffix_dedup, token_counts, toxicity, warc
from lexispark.llm.text import fold

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(fold(labels["doc_id"], 3) != 1))
    held_out = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(fold(docs["doc_id"], 5) != 0))
    held_out = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), labels.filter(fold(labels["doc_id"], 3) != 1))
    held_out = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination_report(decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark")))



def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.centroid_digest().alias("centroid_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins with a cache of its own, so every distinct text is encoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{tables_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_join, op2_toxicity, op3_kd_sharding, op4_language, op5_mixing, op6_warc, op7_quality, op8_exact_dedup, op9_decontaminate, op10_suffix_dedup, op11_centroids, op12_divergence, op13_token_counts)
}

SQL: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
                     max(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
        FROM d""",
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {AZ}) AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op9_decontaminate": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        pat AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') AS g
                FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM b WHERE len(ws) > 0)),
        ms AS (SELECT DISTINCT m FROM pat),
        win AS (SELECT doc_id, m, k, array_to_string(ws[k : k + m - 1], ' ') AS g
                FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM w, ms WHERE len(ws) >= m)),
        hit AS (SELECT doc_id, item_id, k, win.m FROM win JOIN pat ON win.m = pat.m AND win.g = pat.g),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
                FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
}


def mixing_sql(sweeps: int = 8, temperature: float = 0.7, budget: float = 0.5) -> str:
    """Raking unrolled: one CTE for each margin of each sweep; then the scale by falling weight per token."""
    parts = [
        r"""docs AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
              CASE WHEN contains(text, ' | ') OR contains(text, chr(9)) THEN 'tabular'
                   WHEN regexp_matches(text, '[0-9][0-9][0-9]') THEN 'data'
                   WHEN contains(text, '?') OR contains(text, '"') THEN 'dialogue' ELSE 'prose' END AS topic,
              coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL)",
    ]
    for m in mixing.MARGINS:
        share = f"CASE WHEN t > 0 THEN pow(t, {temperature}) ELSE 0 END"
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, {share} / sum({share}) OVER () AS to_{m} FROM (SELECT {m}, sum(tokens)::DOUBLE AS t FROM cells GROUP BY {m}))")
    parts.append("w0 AS MATERIALIZED (SELECT *, tokens / (sum(tokens) OVER ())::DOUBLE AS w FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    steps = [m for _ in range(sweeps) for m in mixing.MARGINS]
    for n, m in enumerate(steps):
        parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * to_{m} / sum(w) OVER (PARTITION BY {m}) ELSE 0 END AS w) FROM w{n})")
    # s with sum(min(tokens, s * w)) = budget * all: with the k densest cells at rate 1, s solves the rest; the right k is the first that leaves the next cell below 1
    parts += [
        f"r AS MATERIALIZED (SELECT *, sum(tokens) OVER o - tokens AS t_full, sum(w) OVER () - (sum(w) OVER o - w) AS w_rest, {budget} * sum(tokens) OVER () AS want FROM w{len(steps)} WHERE tokens > 0 AND w > 0 WINDOW o AS (ORDER BY w / tokens DESC, source, lang, topic ROWS UNBOUNDED PRECEDING))",
        "s AS (SELECT arg_max((want - t_full) / w_rest, w / tokens) AS s FROM r WHERE (want - t_full) / w_rest * w < tokens)",
        f"rated AS (SELECT source, lang, topic, CASE WHEN tokens = 0 THEN 1.0 ELSE least(1.0, w * coalesce(s, 0) / tokens) END AS rate FROM w{len(steps)}, s)",
    ]
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT / 4503599627370496.0 < rate AS sampled
        FROM docs JOIN rated USING (source, lang, topic)"""


SQL["op5_mixing"] = mixing_sql()

# links at class level by an inverted index over whole sets, then components by a recursive walk
SQL["op1_ngram_join"] = rf"""
    WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sh AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k : k + 4], ' ')) END)) AS s FROM w),
    cls AS MATERIALIZED (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sh WHERE len(s) > 0 GROUP BY s),
    tok AS MATERIALIZED (SELECT rep, n, unnest(s) AS t FROM cls),
    link AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM tok a JOIN tok b ON a.t = b.t AND a.rep < b.rep AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
             GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    walk(node, low) AS (SELECT rep, rep FROM cls UNION SELECT sym.b, walk.low FROM walk JOIN sym ON sym.a = walk.node WHERE walk.low < sym.b),
    comp AS (SELECT node, min(low) AS low FROM walk GROUP BY node)
    SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, coalesce(comp.low, sh.doc_id) AS component_id
    FROM sh LEFT JOIN cls ON sh.s = cls.s AND len(sh.s) > 0 LEFT JOIN comp ON comp.node = cls.rep"""


def centroids_sql(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> str:
    """Rounds unrolled over one row for each component."""
    parts = [
        f"""good AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
              WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"vec AS MATERIALIZED (SELECT r, unnest(range(1, {dim + 1})) AS i, unnest(v) AS x FROM good)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range(1, {dim + 1})) AS i, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM good) WHERE c < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, sum((vec.x - c{n}.x) * (vec.x - c{n}.x))::BIGINT AS d FROM vec JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(m, x) AS x FROM c{n} LEFT JOIN (SELECT a.c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m
                FROM a{n} a JOIN vec USING (r) GROUP BY a.c, i) USING (c, i))""")
    return f"""WITH {", ".join(parts)}, digests AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
        SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
        FROM a{rounds} a JOIN good USING (r) JOIN digests ON digests.c = a.c"""


SQL["op11_centroids"] = centroids_sql()

# all kept terms against all groups of the language, counts of 0 included
SQL["op12_divergence"] = rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    t AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
    kept AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n_lang FROM t GROUP BY lang, term HAVING sum(docs) >= 3),
    grp AS MATERIALIZED (SELECT lang, source FROM d GROUP BY ALL),
    cells AS MATERIALIZED (SELECT lang, source, term, n_lang, coalesce(n, 0)::BIGINT AS n FROM grp JOIN kept USING (lang) LEFT JOIN t USING (lang, source, term)),
    tot AS MATERIALIZED (SELECT lang, source, sum(n)::HUGEINT AS n_all, sum(n_lang)::HUGEINT AS l_all, count(*)::HUGEINT AS v FROM cells GROUP BY lang, source),
    p AS MATERIALIZED (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (n_all + v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (n_lang + 1) // (l_all + v))::BIGINT AS q
              FROM cells JOIN tot USING (lang, source)),
    pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
              FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
    SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
    UNION ALL SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200"""
