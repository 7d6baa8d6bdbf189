"""Lexical views over the tables of a data folder, in SQL that Spark and DuckDB both read.

``{explode}`` is the one word in which the two differ. Each view may use those before it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexispark.functions.lineage import materialize
from lexispark.operators.enrichment import dense_ids

TABLES = ("supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "customer", "nation")
TOKENS = "regexp_extract_all(lower(text), '[a-z]+', 0)"
POS = "CASE {0} % 5 WHEN 0 THEN 'n' WHEN 1 THEN 'v' WHEN 2 THEN 'a' WHEN 3 THEN 'r' ELSE 's' END"

VIEWS: dict[str, str] = {
    "lx_synsets": f"SELECT CAST(doc_id AS STRING) AS synset_id, {POS.format('doc_id')} AS pos, text AS definition FROM documents",
    "lx_tokens": f"SELECT doc_id, {{explode}}({TOKENS}) AS tok FROM documents",
    "lx_doc_tokens": "SELECT doc_id, tok, count(*) AS n FROM lx_tokens GROUP BY doc_id, tok",
    "lx_lemmas": "SELECT tok AS lemma, CAST(doc_id AS STRING) AS synset_id FROM lx_doc_tokens",
    "lx_counts": "SELECT tok, sum(n) AS n FROM lx_doc_tokens GROUP BY tok",
    "lx_frequencies_raw": "SELECT tok AS word, n, round(log10(1e9 * n / (SELECT sum(n) FROM lx_counts)), 6) AS zipf, CASE WHEN n > 1 THEN round(least(7.0, 1 + ln(n)), 6) END AS familiarity FROM lx_counts",
    "lx_ranked_tokens": "SELECT tok, n, row_number() OVER (ORDER BY n DESC, tok) AS k FROM lx_counts",
    "lx_vectors": "SELECT tok AS lemma, embedding FROM lx_ranked_tokens JOIN embeddings ON k = vec_id + 1",
    "lx_relations": "SELECT DISTINCT CAST(l_partkey AS STRING) AS source_synset, CAST(l_suppkey AS STRING) AS target_synset, CASE l_linenumber % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '11' WHEN 3 THEN '40' ELSE '60' END AS relation_type FROM lineitem",
    "lx_syntagms": "SELECT DISTINCT CAST(l_partkey AS BIGINT) * 100000000 + l_suppkey AS syntagm_id, CAST(l_partkey AS STRING) AS synset1id, CAST(l_suppkey AS STRING) AS synset2id FROM lineitem",
    "lx_curated": "SELECT CAST(l_partkey AS STRING) AS synset_id, l_suppkey AS vocab_id, l_suppkey AS cluster_id, CASE min(l_returnflag) WHEN 'A' THEN 'exact' WHEN 'N' THEN 'morphological' ELSE 'embedding' END AS snap_method, CASE WHEN min(l_returnflag) = 'R' THEN round(0.7 + 3 * avg(l_discount), 6) END AS snap_score, round(1.5 * sum(1 - l_discount), 6) AS salience_sum FROM lineitem GROUP BY l_partkey, l_suppkey",
    "lx_vocab": f"SELECT s_suppkey AS vocab_id, CAST(s_suppkey AS STRING) AS synset_id, lower(s_name) AS lemma, {POS.format('s_suppkey')} AS pos, s_nationkey + 1 AS polysemy FROM supplier",
    "lx_words": "SELECT DISTINCT lower(p_brand || ' ' || p_type) AS lemma, CAST(p_partkey AS STRING) AS synset_id FROM part",
    "lx_word_list": "SELECT DISTINCT lemma AS word FROM lx_words",
    "lx_lexicon": "SELECT lemma, synset_id FROM lx_words UNION SELECT {explode}(split(p_name, ' ')) AS lemma, CAST(p_partkey AS STRING) AS synset_id FROM part UNION SELECT lower(p_brand) AS lemma, CAST(p_partkey AS STRING) AS synset_id FROM part",
    "lx_lexicon_words": "SELECT DISTINCT lemma AS word FROM lx_lexicon",
    "lx_part_synsets": f"SELECT CAST(p_partkey AS STRING) AS synset_id, {POS.format('p_partkey')} AS pos, p_name AS definition FROM part",
    "lx_part_relations": "SELECT * FROM lx_relations",
    "lx_numbered_suppliers": "SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier",
    "lx_cluster_antonyms": "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM lx_numbered_suppliers x JOIN lx_numbered_suppliers y ON x.s_nationkey = y.s_nationkey AND (x.k = y.k + 1 AND y.k % 2 = 1 OR y.k = x.k + 1 AND x.k % 2 = 1)",
    "lx_numbered_words": "SELECT word, row_number() OVER (ORDER BY word) AS k FROM lx_word_list",
    "lx_word_vectors": "SELECT word AS lemma, embedding FROM lx_numbered_words JOIN embeddings ON k = vec_id + 1",
    "lx_properties": "SELECT CAST(doc_id AS STRING) AS synset_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tok) AS pos_in_list, tok AS text, round(n / max(n) OVER (PARTITION BY doc_id), 6) AS salience, CASE length(tok) % 4 WHEN 0 THEN 'physical' WHEN 1 THEN 'social' WHEN 2 THEN 'emotional' ELSE NULL END AS property_type, CAST(NULL AS STRING) AS relation FROM lx_doc_tokens",
    "lx_ratings": "SELECT CAST(vec_id AS STRING) AS synset_id, 1 + 4.0 * label / (SELECT max(label) FROM embeddings) AS score, 'brysbaert' AS source FROM embeddings WHERE vec_id % 2 = 0",
    "lx_pairs": "SELECT CAST(doc_id AS STRING) AS word_b, lag(CAST(doc_id AS STRING)) OVER (PARTITION BY quality ORDER BY doc_id) AS word_a, CASE WHEN quality = 1 THEN 'apt' ELSE 'inapt' END AS class, doc_id FROM labels",
    "lx_aptness_pairs": "SELECT word_a || ':' || word_b AS pair_id, class, word_a, word_b FROM lx_pairs WHERE word_a IS NOT NULL",
    "lx_bags": "SELECT CAST(doc_id AS STRING) AS synset_id, CAST(length(tok) * 100 + ascii(tok) AS BIGINT) AS cluster_id, CAST(sum(n) - 1 AS DOUBLE) AS salience_sum FROM lx_doc_tokens GROUP BY doc_id, CAST(length(tok) * 100 + ascii(tok) AS BIGINT)",
    "lx_gold": f"SELECT CAST(item_id AS STRING) AS pair_id, item_id, {TOKENS}[{{first}}] AS source, {TOKENS}[{{last}}] AS target, CASE item_id % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'medium' ELSE 'weak' END AS tier, CASE WHEN item_id % 7 = 0 THEN 'archetypal' END AS register FROM benchmark",
    "lx_trials": "SELECT CAST(user_id AS STRING) || '-' || CAST(day AS STRING) AS trial_id, CAST(user_id AS STRING) AS prompt_name, generation, mrr, hits, n, parent_mrr, valid FROM (SELECT user_id, day, dense_rank() OVER (PARTITION BY user_id ORDER BY day) - 1 AS generation, mrr, hits, n, lag(mrr) OVER (PARTITION BY user_id ORDER BY day) AS parent_mrr, n % 11 <> 0 AS valid FROM (SELECT user_id, CAST(ts AS DATE) AS day, round(avg(CASE WHEN event_type = 'error' THEN 0 ELSE value END) / 100, 6) AS mrr, sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)) t) u",
    "lx_trial_pairs": "SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS trial_id, CAST(user_id AS STRING) AS prompt_name, event_id, event_type AS pair, CASE event_type WHEN 'click' THEN 'strong' WHEN 'view' THEN 'medium' ELSE 'weak' END AS tier, round(1 / (1 + floor(value)), 6) AS reciprocal_rank FROM events",
    "lx_snap_vocab": "SELECT k AS vocab_id, tok AS lemma FROM lx_ranked_tokens JOIN embeddings ON k = vec_id + 1 WHERE label < 5",
    "lx_snap_properties": "SELECT k AS property_id, tok AS text, embedding FROM lx_ranked_tokens LEFT JOIN embeddings ON k = vec_id + 1",
    "lx_snap_links": "SELECT synset_id, k AS property_id, text, salience FROM lx_properties JOIN lx_ranked_tokens ON tok = text",
    "lx_snap_clusters": "SELECT vocab_id, CAST(floor((vocab_id + 1) / 2) AS BIGINT) AS cluster_id FROM lx_snap_vocab",
    "lx_spoken": f"SELECT DISTINCT {{explode}}({TOKENS}) AS tok FROM conversations",
    "lx_titles": "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, html FROM pages",
    "lx_marked": "SELECT page_id AS idx, 'see <b>' || title || '</b> here' AS s0, title AS human_ans, CASE page_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'fiction' ELSE NULL END AS genre FROM lx_titles",
}

#: What Spark reads for a view instead: the written tokens of a document come with their place in its list and its highest count.
SPARK = {"lx_properties": VIEWS["lx_properties"].replace("row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tok) AS pos_in_list", "pos_in_list").replace("max(n) OVER (PARTITION BY doc_id)", "n_max")}

#: Views that Spark writes out when a query first asks for them, and those whose ``k`` it numbers by ranges of an order instead of one window.
WRITTEN = {"lx_doc_tokens", "lx_counts"}
NUMBERED: dict[str, tuple[str, list[str]]] = {"lx_ranked_tokens": ("lx_counts", ["n desc", "tok"]), "lx_numbered_words": ("lx_word_list", ["word"])}

#: Documents of which one task may count the tokens though others have nothing to do.
FEW = 2000

DUCKDB = {"explode": "unnest", "first": "1", "last": "-1"}


def needed(names: list[str], stop: Collection[str] = ()) -> list[str]:
    """The views that these use, themselves included, in order of definition; what only those in ``stop`` use is left out."""
    found: set[str] = set()
    todo = [n for n in names if n in VIEWS]
    while todo:
        n = todo.pop()
        if n not in found:
            found.add(n)
            todo += [m for m in re.findall(r"\blx_\w+", VIEWS[n]) if m in VIEWS and n not in stop]
    return [n for n in VIEWS if n in found]


def duckdb_sql(query: str) -> str:
    """``query`` with the views it names in front, as one statement."""
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].format(**DUCKDB)})" for n in needed(re.findall(r"\blx_\w+", query)))
    body = query.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


def document_tokens(documents: DataFrame) -> DataFrame:
    """``doc_id, tok, n, pos_in_list, n_max``: the view ``lx_doc_tokens`` with the place of a token in its document, by falling n, then tok, and the document's highest n.

    Where every row has a doc_id of its own, which a count of the ids tells, a row's tokens are counted and
    ranked where the row is read, and nothing is shuffled; only if fewer tasks than cores have rows, as
    with a file of few row groups, rows are dealt to more tasks first. Else rows are grouped.
    """
    texts, cores = documents.select("doc_id", F.lower("text").alias("text")), documents.sparkSession.sparkContext.defaultParallelism
    if documents.groupBy("doc_id").count().filter("count > 1").isEmpty():
        word, kind = re.compile("[a-z]+"), documents.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):  # long texts make many rows
                    b = whole.slice(at, 512)
                    toks, ns, sizes = [], [], []
                    for text in b.column("text"):
                        found = sorted(Counter(word.findall(text.as_py() or "")).items(), key=lambda x: (-x[1], x[0]))
                        sizes.append(len(found))
                        toks += [t for t, _ in found]
                        ns += [n for _, n in found]
                    sizes, ns = np.array(sizes, dtype=np.int64), np.array(ns, dtype=np.int64)
                    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
                    ids = b.column("doc_id").take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))
                    columns = [ids, pa.array(toks, type=pa.string()), pa.array(ns), pa.array((np.arange(len(ns)) - first + 1).astype(np.int32)), pa.array(ns[first])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tok", "n", "pos_in_list", "n_max"])

        filled = documents.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("n")).first()
        if filled["tasks"] < cores and (filled["n"] or 0) >= FEW:
            texts = texts.repartition(4 * cores, "doc_id")
        return texts.mapInArrow(run, f"doc_id {kind}, tok string, n long, pos_in_list int, n_max long")
    counts = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("tok")).groupBy("doc_id", "tok").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("doc_id")
    return counts.withColumns({"pos_in_list": F.row_number().over(of.orderBy(F.desc("n"), "tok")), "n_max": F.max("n").over(of)})


class Views:
    """``views["lx_lemmas"]`` or ``views["part"]`` as a DataFrame over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in WRITTEN and name not in NUMBERED:
            return self.select(name)
        if name not in self.made:
            if name in WRITTEN:
                self.made[name] = materialize(document_tokens(self["documents"]) if name == "lx_doc_tokens" else self.select(name), name)
            else:
                source, order = NUMBERED[name]
                rows = self[source]
                self.made[name] = materialize(dense_ids(rows, [F.expr(c.removesuffix(" desc")).desc() if c.endswith(" desc") else F.col(c) for c in order], "k").select(*rows.columns, F.col("k").cast("int").alias("k")), name)
        return self.made[name]

    def select(self, name: str) -> DataFrame:
        made = {*WRITTEN, *NUMBERED} - {name}
        ctes = needed([name], made)
        for n in made.intersection(ctes):
            self[n].createOrReplaceTempView(n)
        ctes = [n for n in ctes if n not in made]
        used = {t for t in TABLES if re.search(rf"\b{t}\b", " ".join(VIEWS[n] for n in ctes))}
        for t in used:
            self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        body = ", ".join(f"{n} AS ({SPARK.get(n, VIEWS[n]).format(explode='explode', first='0', last='-1')})" for n in ctes)
        body = re.sub(r"(regexp_extract_all\(lower\(text\), '\[a-z\]\+', 0\))\[(-?\d)\]", lambda m: f"try_element_at({m[1]}, {1 if m[2] == '0' else -1})", body)
        return self.spark.sql(f"WITH {body} SELECT * FROM {name}")
