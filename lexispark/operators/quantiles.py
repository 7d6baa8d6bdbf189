"""Exact quantiles of many columns of values at once, by digits.

A double's bits can be put so that they order like the doubles. From the highest digit on, the values
that agree with a wanted rank's digits so far are counted by their next digit, which says the rank's next
digit. A round gives at most 2^DIGIT counts for each wanted rank, however many distinct values there are.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexispark.functions.lineage import materialize

#: Bits of a digit.
DIGIT = 13


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """The doubles as long numbers in the same order; -0.0 counts as 0.0."""
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def doubles(bits: list[int]) -> np.ndarray:
    b = np.array(bits, dtype=np.int64)
    return np.where(b < 0, b ^ np.int64((1 << 63) - 1), b).view(np.float64)


def _ordered(values: pd.Series) -> pd.Series:
    return pd.Series(ordered_bits(values.to_numpy()))


def exact_quantiles(rows: DataFrame, wanted: list[tuple[str, float]], group: str = "scoring", value: str = "score") -> dict[tuple[str, float], float]:
    """``(group, p) -> value`` for p in [0, 1]: linear between the two nearest ranks. Null values are left out; groups without values are absent."""
    spark = rows.sparkSession
    asked = sorted({g for g, _ in wanted})
    bits = F.pandas_udf(_ordered, "long")
    table = materialize(rows.filter(F.col(value).isNotNull() & F.col(group).isin(asked)).select(F.col(group).alias("g"), bits(F.col(value).cast("double")).alias("b")), "bits")
    n = {r["g"]: r["n"] for r in table.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a group
    place = {(g, p): p * (n[g] - 1) for g, p in wanted if g in n}
    # each wanted rank with its digits so far, as the high part of the bits, and its rank among the values that share them
    left: dict[tuple[str, int], tuple[int | None, int]] = {(g, r): (None, r) for (g, _), x in place.items() for r in (floor(x), ceil(x))}
    shift = 64
    while shift > 0 and left:
        width = min(DIGIT, shift)
        shift -= width
        high = F.shiftright("b", shift)
        sofar = sorted({(g, prefix) for (g, _), (prefix, _) in left.items()}, key=str)
        seen = spark.createDataFrame(sofar, "g string, prefix long")  # a row a rank at most
        cut = table.select("g", high.alias("high"), (F.shiftright("b", shift + width) if shift + width < 64 else F.lit(None).cast("long")).alias("prefix"))
        some = cut.join(F.broadcast(seen), (cut["g"] == seen["g"]) & cut["prefix"].eqNullSafe(seen["prefix"])).select(cut["g"], cut["prefix"], "high")
        counts: dict[tuple[str, int | None], list[tuple[int, int]]] = {}
        for r in some.groupBy("g", "prefix", "high").agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault((r["g"], r["prefix"]), []).append((r["high"], r["n"]))
        for of in counts.values():
            of.sort()
        for key, (prefix, rank) in left.items():
            for digit, k in counts[key[0], prefix]:
                if rank < k:
                    left[key] = (digit, rank)
                    break
                rank -= k
    values = dict(zip(left, doubles([b for b, _ in left.values()]).tolist(), strict=True))
    return {(g, p): values[g, floor(x)] + (values[g, ceil(x)] - values[g, floor(x)]) * (x - floor(x)) for (g, p), x in place.items()}
