"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

The table of points (id, weight, one position per dimension) is small beside the text and is
written once. The driver sees only the tree: per node its bounds, its weight and one cut, never
more than ``MAX_LEAVES`` nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from lexispark.functions.lineage import materialize

MAX_LEAVES = 65_536
#: A cut key has 20 bits of position in a dimension and 31 bits of hash, which splits ties.
POSITION_BITS, TIE_BITS, STEP_BITS = 20, 31, 13
SLOT_ROWS = 50_000


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def categorical(value: Column) -> Column:
    """Position of a category in [0, 1): its hash; null is at 0."""
    return F.coalesce(F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << POSITION_BITS)) / float(1 << POSITION_BITS), F.lit(0.0))


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``, one row per input row.

    Either ``n_shards`` leaves are made, or as many as bring a leaf to ``target_bytes``. A node with
    k leaves is cut where its weight is split floor(k/2) to ceil(k/2), along the dimension in which
    its points lie furthest apart (first listed on ties). ``dims`` maps names to positions in [0, 1];
    by default log size, source and language, as far as ``docs`` has those columns.

    ``slot`` counts from 0 without gaps in each shard, in an order by hash. Null ids, texts and
    metadata have defined places (hash of null, no bytes, position 0); points that agree in every
    dimension, such as a hot source's rows or exact copies, are split by a hash of the id, so no value
    is too frequent to balance. Repeated rows go to one shard. Fewer rows than shards leave shards
    empty; an empty table gives an empty result. Other columns are ignored.
    """
    if dims is None:
        dims = {"bytes": F.log2(text_bytes(docs[text_col])) / 40.0} | {c: categorical(docs[c]) for c in ("source", "lang") if c in docs.columns}
    size, top = text_bytes(docs[text_col]), float((1 << POSITION_BITS) - 1)
    points = materialize(
        docs.select(
            docs[id_col].alias("_id"),
            size.alias("_size"),
            F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("_crc"),
            F.shiftrightunsigned(F.xxhash64(docs[id_col], F.lit("tie")), 64 - TIE_BITS).alias("_tie"),
            *[F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(p, F.lit(0.0)))) * top).cast("long").alias(f"_d{k}") for k, p in enumerate(dims.values())],
        ),
        "kd-points",
    )
    if n_shards is None:
        total = points.agg(F.sum("_size")).first()[0] or 0
        n_shards = max(1, round(total / target_bytes))
    if not 1 <= n_shards <= MAX_LEAVES:
        raise ValueError(f"{n_shards} shards; 1 to {MAX_LEAVES} are possible")

    placed = points.withColumn("_first", F.lit(0)).withColumn("_leaves", F.lit(n_shards))
    while True:
        open_nodes = placed.filter("_leaves > 1").groupBy("_first", "_leaves").agg(F.sum("_size").alias("w"), *[f(f"_d{k}").alias(f"{f.__name__}{k}") for k in range(len(dims)) for f in (F.min, F.max)]).collect() if n_shards > 1 else []
        if not open_nodes:
            break
        nodes = [(r["_first"], r["_leaves"], max(range(len(dims)), key=lambda k, r=r: (r[f"max{k}"] - r[f"min{k}"], -k)), r["w"] * (r["_leaves"] // 2) / r["_leaves"]) for r in open_nodes]
        placed = materialize(_split(placed, nodes, len(dims)), "kd-level")
    return _slots(placed, id_col)


def _split(placed: DataFrame, nodes: Sequence[tuple[int, int, int, float]], n_dims: int) -> DataFrame:
    """Cut each node at the key where its weight reaches the wanted share, found digit by digit."""
    spark, width = placed.sparkSession, POSITION_BITS + TIE_BITS
    schema = T.StructType([T.StructField("_first", T.IntegerType()), T.StructField("_dim", T.IntegerType()), T.StructField("_prefix", T.LongType()), T.StructField("_below", T.DoubleType()), T.StructField("_want", T.DoubleType())])
    keyed = F.shiftleft(F.array(*[F.col(f"_d{k}") for k in range(n_dims)])[F.col("_dim")], TIE_BITS).bitwiseOR(F.col("_tie"))
    state = {first: (dim, 0, 0.0, want) for first, _, dim, want in nodes}
    shift = width
    while shift:
        step = min(STEP_BITS, shift)
        table = F.broadcast(spark.createDataFrame([(k, *v) for k, v in state.items()], schema))  # at most MAX_LEAVES rows
        digits = (
            placed.filter("_leaves > 1").join(table, "_first").withColumn("_key", keyed)
            .filter(F.shiftright("_key", shift) == F.col("_prefix"))
            .groupBy("_first", "_below", "_want", F.shiftright("_key", shift - step).alias("_next")).agg(F.sum("_size").alias("_w"))
        )
        # at most 2^13 digits a node, of which the first that reaches the wanted weight, or else the last, is the hit
        nothing = F.struct(F.lit(None).cast("long").alias("_next"), F.col("_below").alias("_upto"), F.lit(0).cast("long").alias("_w"))
        step_on = lambda hit, d: F.when(hit["_next"].isNotNull() & (hit["_upto"] >= F.col("_want")), hit).otherwise(F.struct(d["_next"].alias("_next"), (hit["_upto"] + d["_w"]).alias("_upto"), d["_w"].alias("_w")))
        found = (
            digits.groupBy("_first", "_below", "_want").agg(F.array_sort(F.collect_list(F.struct("_next", "_w"))).alias("_digits"))
            .select("_first", F.aggregate("_digits", nothing, step_on).alias("_hit")).collect()
        )
        for r in found:
            dim, _, _, want = state[r["_first"]]
            state[r["_first"]] = (dim, r["_hit"]["_next"], r["_hit"]["_upto"] - r["_hit"]["_w"], want)
        last_w = {r["_first"]: r["_hit"]["_w"] for r in found}
        shift -= step
    # the key at the cut goes to the side that brings the left part nearer to the wanted weight
    cuts = [(first, dim, key if below + last_w[first] - want <= want - below else key - 1, below, want) for first, (dim, key, below, want) in state.items()]
    table = F.broadcast(spark.createDataFrame(cuts, schema))
    left = (F.col("_leaves") / 2).cast("int")
    right = F.col("_prefix").isNotNull() & (keyed > F.col("_prefix"))
    joined = placed.join(table, "_first", "left")
    return joined.select(
        *[c for c in placed.columns if c not in ("_first", "_leaves")],
        F.when(right, F.col("_first") + left).otherwise(F.col("_first")).alias("_first"),
        F.when(F.col("_prefix").isNull(), F.col("_leaves")).when(right, F.col("_leaves") - left).otherwise(left).alias("_leaves"),
    )


def _slots(placed: DataFrame, id_col: str) -> DataFrame:
    """Number the rows of each shard: count per (shard, hash range), offset, then number within the range."""
    ranges = max(1, ceil(placed.count() / SLOT_ROWS))
    ranged = placed.withColumn("_range", F.floor(F.col("_tie") * F.lit(ranges / float(1 << TIE_BITS))).cast("int"))
    counts = ranged.groupBy("_first", "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_first").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_first", "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_first", "_range").orderBy("_tie", "_id", "_crc")
    return ranged.join(offsets, ["_first", "_range"]).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_first").alias("shard"),
        (F.col("_offset") + F.row_number().over(within) - 1).alias("slot"),
    )
