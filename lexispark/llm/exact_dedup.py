"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Copies are combined three times: within a task (the map side of the first aggregate), within a
salted digest group, and across salts. Every aggregate has the whole text among its keys, so two
texts that share a digest are never merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lexispark.functions.lineage import materialize
from lexispark.llm.text import ascii_lower

SALTS = 8


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
    id is kept. Null text counts as empty text; a null id is smaller than any other and is kept
    only in a group without ids (``keep_id`` is null then). Of rows that repeat both id and text one
    is kept. An empty table gives an empty result; other columns of ``docs`` are not read.

    A hot group is spread over ``salts`` keys, both when it is combined and when its rows look up
    the winner. ``digest`` only routes rows: with a colliding one the result stays the same.
    """
    norm = ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    rows = docs.select(docs[id_col].alias("_id"), norm.alias("_norm")).select("_id", "_norm", digest(F.col("_norm")).alias("_digest"), F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"))

    by_salt = rows.groupBy("_digest", "_salt", "_norm").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"))
    classes = by_salt.repartition("_digest").groupBy("_digest", "_norm").agg(F.sum("_n").alias("_n"), F.max("_keep").alias("_keep"))
    groups = materialize(
        classes.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.sum("_n").alias("_n"), F.max("_keep").alias("_keep")).filter("_n > 1"),
        "digest-groups",
    )
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("_salt")

    def labelled(rows: DataFrame, winners: DataFrame, on: list[str]) -> DataFrame:
        """Join the winners, then give repeated (id, text) rows one kept row."""
        alike = rows.groupBy("_id", "_salt", "_digest", *([c for c in on if c == "_norm"])).agg(F.count(F.lit(1)).alias("_rows"))
        found = alike.join(winners.select(*[c for c in on if c != "_salt"], copies, "_n", "_keep"), on, "left")
        keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
        return found.select("_id", "_digest", *([c for c in on if c == "_norm"]), keep.alias("_keep"), F.coalesce("_n", F.lit(1)).alias("_n"), F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_nth"))

    collided = groups.filter("_texts > 1").select("_digest")
    if collided.isEmpty():
        out = labelled(rows, groups, ["_digest", "_salt"])
        text_sha = F.col("_digest") if digest is sha256 else None
        if text_sha is None:
            out, text_sha = labelled(rows, classes.filter("_n > 1"), ["_digest", "_norm", "_salt"]), sha256(F.col("_norm"))
    else:  # digests that stand for several texts: the text itself joins the key
        out, text_sha = labelled(rows, classes.filter("_n > 1"), ["_digest", "_norm", "_salt"]), sha256(F.col("_norm"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1)).alias("kept"),
        text_sha.alias("text_sha256"),
    )
