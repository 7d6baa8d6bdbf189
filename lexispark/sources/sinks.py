"""Outputs, table checks and quality gates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexispark.functions.lineage import materialize
from lexispark.operators.vocabulary import lemma_polysemy


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, path: str, buckets: int = 64) -> DataFrame:
    """``df`` as the table ``name`` in the folder ``path``, in ``buckets`` by the hash of ``key`` and sorted by it; the table is returned.

    Joins and groupings on ``key``, also with tables of as many buckets, read it without a shuffle. A table of
    that name is replaced.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()])


def require_tables(spark: SparkSession, names: list[str]) -> None:
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")


def validate_rows(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``broken``, the names of the rules). A rule that is null holds, as a CHECK does."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def orphan_collocations(syntagms: DataFrame, synsets: DataFrame) -> DataFrame:
    known = synsets.select("synset_id").distinct().withColumn("_known", F.lit(True))
    one = known.select(F.col("synset_id").alias("synset1id"), F.col("_known").alias("_1"))
    two = known.select(F.col("synset_id").alias("synset2id"), F.col("_known").alias("_2"))
    found = syntagms.join(one, "synset1id", "left").join(two, "synset2id", "left")
    counts = found.agg(F.count_if(F.col("_1").isNull() | F.col("_2").isNull()).alias("orphans"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("rate", F.when(F.col("total") > 0, F.col("orphans") / F.col("total")).otherwise(0.0))


def concreteness_coverage(synsets: DataFrame, concreteness: DataFrame) -> DataFrame:
    total = synsets.agg(F.countDistinct("synset_id").alias("total"))
    scored = concreteness.agg(F.countDistinct("synset_id").alias("scored"))
    return scored.crossJoin(total).select("scored", "total", F.when(F.col("total") > 0, F.round(100 * F.col("scored") / F.col("total"), 1)).otherwise(0.0).alias("pct"))  # one row each


def snap_audit(curated: DataFrame) -> DataFrame:
    """``metric, bucket, n``: rows by method, synsets by number of properties, embedding scores by range."""
    method = curated.groupBy(F.col("snap_method").alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("metric", F.lit("method"))
    per = curated.groupBy("synset_id").agg(F.count(F.lit(1)).alias("k"))
    stats = per.agg(F.count(F.lit(1)).alias("synsets"), *[F.count_if(F.col("k") >= m).alias(f"at least {m}") for m in (3, 5, 8)], F.round(F.avg("k"), 6).alias("average"))
    names = stats.columns
    cover = stats.select(F.expr(f"stack({len(names)}, {', '.join(f"'{c}', CAST(`{c}` AS double)" for c in names)}) AS (bucket, n)")).withColumn("metric", F.lit("coverage"))
    edges = [0.75, 0.8, 0.85, 0.9, 0.95]
    bucket = reduce(lambda w, e: w.when(F.col("snap_score") < e[1], f"{e[0]:.2f}-{e[1]:.2f}"), list(zip(edges, edges[1:], strict=False)), F.when(F.col("snap_score") < edges[0], "below 0.75")).otherwise("0.95 and above")
    hist = curated.filter("snap_method = 'embedding'").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("metric", F.lit("score"))
    return method.unionByName(cover).unionByName(hist).select("metric", "bucket", "n")


def polysemy_coverage(synsets: DataFrame, lemmas: DataFrame, frequencies: DataFrame, tops: tuple[int, ...] = (5_000, 10_000, 20_000, 35_000), distinct: bool = False) -> DataFrame:
    """``top_n, pos, min_polysemy, n, pct, cumulative_pct`` over the most familiar synsets: how few senses their least polysemous lemma has (1, 2, 3, 5, 10, more).

    With ``distinct`` no row of ``lemmas`` is there twice.
    """
    polysemy = materialize(lemma_polysemy(lemmas, distinct).withColumnRenamed("polysemy", "p"), "polysemy")
    fam = lemmas.join(frequencies.select("lemma", "familiarity", "zipf"), "lemma", "left").join(polysemy, "lemma").groupBy("synset_id").agg(F.coalesce(F.max("familiarity"), F.lit(0.0)).alias("f"), F.coalesce(F.max("zipf"), F.lit(0.0)).alias("z"), F.min("p").alias("p"))
    # only the first max(tops) rows are ranked, after a distributed top-k
    best = synsets.select("synset_id", "pos").join(fam, "synset_id").orderBy(F.desc("f"), F.desc("z"), "synset_id").limit(max(tops))
    ranked = best.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("f"), F.desc("z"), "synset_id")))
    level = F.when(F.col("p") <= 3, F.col("p")).when(F.col("p") <= 5, 5).when(F.col("p") <= 10, 10).otherwise(999).cast("int")
    wide = ranked.withColumn("top_n", F.explode(F.array(*[F.lit(t) for t in tops]))).filter("_rank <= top_n").withColumn("pos", F.explode(F.array("pos", F.lit("all"))))
    counts = wide.groupBy("top_n", "pos", level.alias("min_polysemy")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("top_n", "pos")
    upto = whole.orderBy("min_polysemy")
    return counts.withColumns({"pct": F.round(100 * F.col("n") / F.sum("n").over(whole), 4), "cumulative_pct": F.round(100 * F.sum("n").over(upto) / F.sum("n").over(whole), 4)})
