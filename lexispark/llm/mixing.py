"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are summed into (source, language, topic) cells. Raking multiplies the cells' weights
until their sums meet the wanted share of every margin. The ratio of a cell's raked tokens to its
own tokens is the calibrated rate at which its documents are sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexispark.functions.lineage import materialize

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
WORDS = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A form class read off the text: tabular, data, dialogue or prose; null text is prose."""
    return (
        F.when(text.contains(" | ") | text.contains("\t"), "tabular")
        .when(text.rlike("[0-9][0-9][0-9]"), "data")
        .when(text.contains("?") | text.contains('"'), "dialogue")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def draw(id_: Column, seed: str) -> Column:
    """A reproducible number in [0, 1) for an id: 52 bits of its md5."""
    text = F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def default_targets(cells: DataFrame, margins: Sequence[str], temperature: float) -> DataFrame:
    """Wanted shares ``margin, value, share``: each value's tokens to the power ``temperature``, normed."""
    out = None
    for m in margins:
        by = cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").cast("double").alias("t")).withColumn("t", F.when(F.col("t") > 0, F.pow("t", F.lit(temperature))).otherwise(0.0))
        norm = by.agg(F.sum("t").alias("_all"))
        part = by.crossJoin(F.broadcast(norm)).select(F.lit(m).alias("margin"), "value", F.when(F.col("_all") > 0, F.col("t") / F.col("_all")).otherwise(0.0).alias("share"))  # one row
        out = part if out is None else out.unionByName(part)
    return out


def rake(cells: DataFrame, targets: DataFrame, margins: Sequence[str] = MARGINS, sweeps: int = 8) -> DataFrame:
    """``cells`` (margins, tokens) with ``weight``: raked shares that sum to 1.

    Each sweep scales the weights to every margin in turn. Values without a target get weight 0,
    and so do cells without tokens.
    """
    total = cells.agg(F.sum("tokens").cast("double").alias("_all"))
    now = cells.crossJoin(F.broadcast(total)).withColumn("weight", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0)).drop("_all")  # one row
    for m in margins:
        wanted = targets.filter(F.col("margin") == m).select(F.col("value").alias(m), F.col("share").alias(f"_to_{m}"))
        now = now.join(wanted, m, "left")
    now = materialize(now, "cells")
    for _ in range(sweeps):
        for m in margins:
            have = F.sum("weight").over(Window.partitionBy(m))  # a join with the sums would read the cells twice for every margin
            now = now.withColumn("_have", have).withColumn("weight", F.when(F.col("_have") > 0, F.col("weight") * F.coalesce(f"_to_{m}", F.lit(0.0)) / F.col("_have")).otherwise(0.0)).drop("_have")
        now = materialize(now, "cells")
    return now.drop(*[f"_to_{m}" for m in margins])


def sampling_rates(raked: DataFrame, budget: float, rounds: int = 64) -> DataFrame:
    """``raked`` with ``rate``: min(1, s * weight / tokens), s such that the expected tokens are ``budget`` of all.

    s is found by setting aside the cells that reach rate 1, again and again; every round reads
    two sums. Cells without tokens have rate 1: they cost nothing.
    """
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    scale, full = 0.0, F.lit(False)
    for _ in range(rounds):
        got = raked.agg(F.sum(F.when(full, F.col("tokens"))).alias("t"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not got["w"]:
            break
        new = (budget * total - (got["t"] or 0)) / got["w"]
        if new <= scale * (1 + 1e-12):
            break
        scale, full = new, F.col("weight") * F.lit(new) >= F.col("tokens")
    return raked.withColumn("rate", F.when(F.col("tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("weight") * F.lit(scale) / F.col("tokens"))))


def cell_columns(docs: DataFrame, text_col: str = "text", topic: Column | None = None) -> dict[str, Column]:
    """The margins of a row of ``docs``; nulls and missing columns are "(none)"."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    col = lambda c: named(docs[c]) if c in docs.columns else F.lit(NONE)
    return {"source": col("source"), "lang": col("lang"), "topic": named(topic_of(docs[text_col].cast("string")) if topic is None else topic)}


def cell_rates(rows: DataFrame, targets: DataFrame | None, temperature: float, budget: float, sweeps: int) -> DataFrame:
    """``source, lang, topic, rate`` from rows with those margins and ``tokens``."""
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, default_targets(cells, MARGINS, temperature) if targets is None else targets, MARGINS, sweeps)
    return sampling_rates(raked, budget).select(*MARGINS, "rate")


def mix(docs: DataFrame, targets: DataFrame | None = None, temperature: float = 0.7, budget: float = 0.5, sweeps: int = 8, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """``id_col, source, lang, topic, n_tokens, rate, sampled``, one row per input row.

    ``targets`` has the wanted ``margin, value, share``; without it, shares follow the corpus'
    own with ``temperature`` (1 keeps them, 0 makes them equal). ``budget`` is the share of all tokens
    to expect in the sample. Null source, lang or topic is the value "(none)"; missing columns are
    too. Null or empty text has 0 tokens. Rows that repeat an id share one draw. An empty table
    gives an empty result. Other columns are ignored.
    """
    cells = cell_columns(docs, text_col, topic)
    rows = materialize(docs.select(docs[id_col].alias("_id"), *[c.alias(k) for k, c in cells.items()], token_count(docs[text_col].cast("string")).alias("tokens")), "document-cells")
    return rows.join(cell_rates(rows, targets, temperature, budget, sweeps), list(MARGINS)).select(
        F.col("_id").alias(id_col), *MARGINS, F.col("tokens").alias("n_tokens"), F.round("rate", 6).alias("rate"), (draw(F.col("_id"), seed) < F.col("rate")).alias("sampled")
    )


def sample(docs: DataFrame, targets: DataFrame | None = None, temperature: float = 0.7, budget: float = 0.5, sweeps: int = 8, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """The rows of ``docs``, with their own columns, that :func:`mix` samples."""
    cells = {f"_cell_{k}": c for k, c in cell_columns(docs, text_col, topic).items()}
    rows = docs.select(*[c.alias(k.removeprefix("_cell_")) for k, c in cells.items()], token_count(docs[text_col].cast("string")).alias("tokens"))
    rates = cell_rates(rows, targets, temperature, budget, sweeps).select(*[F.col(m).alias(f"_cell_{m}") for m in MARGINS], F.col("rate").alias("_rate"))
    return docs.withColumns(cells).join(rates, list(cells)).filter(draw(F.col(id_col), seed) < F.col("_rate")).select(*docs.columns)
