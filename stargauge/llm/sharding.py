"""Contiguous shards of near equal bytes, copies of a text kept together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stargauge.sources.staging import stage

BINS_LOG2 = 16
BINS = 1 << BINS_LOG2
OVERHEAD = 8
# Halvings of a range of bytes: enough for any total below 2 ** 62.
HALVINGS = 62


def shard_documents(
    docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Shard and slot of every row, by a minimax partition of ordered group sizes.

    A group is a bin of text hashes: equal texts always share one, and there are at most
    ``BINS``, so what is partitioned in one place is bounded whatever the input. Groups above an
    even share come first, by size, the rest by hash. The smallest capacity at which a greedy
    pass needs no more than ``shards`` shards is found by halving; the cuts then keep every shard
    within it and as even as it allows. A null text is its own group of no bytes, an empty text
    another. Null keys are rows like others, repeated rows all get a slot of their own, other
    columns are not read. No rows give no rows. ``slot`` runs from 0 within each shard.
    """
    digest = F.xxhash64(text)
    rows = stage(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
            F.shiftrightunsigned(digest, 64 - BINS_LOG2).cast("int").alias("bin"),
        ),
        "shard-rows",
    )
    bins = stage(_bins(rows, shards), "shard-bins")
    # At most BINS rows.
    placed = rows.join(F.broadcast(bins), "bin").withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "bin"), F.col("cells")).cast("int")
    )
    # Rows are numbered per cell; a large bin has as many cells as rows of its share ask for,
    # at most 2 * BINS in all.
    in_cell = placed.groupBy("shard", "place", "bin", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("place", "cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = in_cell.select(
        "bin", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    order = Window.partitionBy("bin", "cell").orderBy("text_crc32", "size", "doc_id")
    return (
        placed.withColumn("row", F.row_number().over(order) - 1)
        .join(F.broadcast(first), ["bin", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("row")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _bins(rows: DataFrame, shards: int) -> DataFrame:
    """Bin, place in the order, shard and number of cells; at most ``BINS`` rows."""
    sums = rows.groupBy("bin").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row of at most BINS entries.
    one = sums.agg(
        F.collect_list(F.struct("bin", "bytes", "rows")).alias("all"),
        F.sum("bytes").alias("total"),
        F.max("bytes").alias("largest"),
        F.sum("rows").alias("n"),
    ).where("n IS NOT NULL")
    share = F.col("total") / shards
    ordered = F.sort_array(
        F.transform(
            "all",
            lambda g: F.struct(
                F.when(g["bytes"] > share, -g["bytes"]).otherwise(F.lit(0)).alias("turn"),
                g["bin"].alias("bin"),
                g["bytes"].alias("bytes"),
                g["rows"].alias("rows"),
            ),
        )
    )
    one = one.select("total", "largest", "n", ordered.alias("groups"))
    one = one.withColumn("sizes", F.transform("groups", lambda g: g["bytes"]))
    one = one.withColumn("capacity", _smallest_capacity(shards))
    one = one.withColumn("earliest", _earliest_cuts())
    one = one.withColumn("cuts", _cuts(shards))
    cells = F.greatest(F.lit(1), F.ceil(F.col("group.rows") * BINS / F.col("n")))
    return one.select("n", "cuts", F.posexplode("groups").alias("place", "group")).select(
        F.col("group.bin").alias("bin"),
        "place",
        F.size(F.filter("cuts", lambda cut: cut <= F.col("place"))).alias("shard"),
        cells.cast("int").alias("cells"),
    )


def _shards_needed(sizes: Column, capacity: Column) -> Column:
    """Shards that a greedy pass fills when none may exceed the capacity."""

    def add(state: Column, size: Column) -> Column:
        fits = state["load"] + size <= capacity
        return F.struct(
            F.when(fits, state["used"]).otherwise(state["used"] + 1).alias("used"),
            F.when(fits, state["load"] + size).otherwise(size).alias("load"),
        )

    empty = F.struct(F.lit(1).alias("used"), F.lit(0).cast("bigint").alias("load"))
    return F.aggregate(sizes, empty, add)["used"]


def _smallest_capacity(shards: int) -> Column:
    """Halves the range between a lower bound and one that always fits."""
    low = F.greatest(F.col("largest"), F.ceil(F.col("total") / shards))

    def halve(state: Column, _: Column) -> Column:
        middle = F.expr("0").cast("bigint") + F.floor((state["low"] + state["high"]) / 2)
        found = state["low"] >= state["high"]
        fits = F.when(found, F.lit(True)).otherwise(
            _shards_needed(F.col("sizes"), middle) <= shards
        )
        return F.struct(
            F.when(found | fits, state["low"]).otherwise(middle + 1).alias("low"),
            F.when(found | ~fits, state["high"]).otherwise(middle).alias("high"),
        )

    begin = F.struct(low.alias("low"), (low + F.col("largest")).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), begin, halve)["low"]


def _earliest_cuts() -> Column:
    """Bytes before the shards that a greedy pass from the end fills, last shard first: cuts
    before them would leave more than the remaining shards can hold."""

    def add(state: Column, size: Column) -> Column:
        fits = state["load"] + size <= F.col("capacity")
        closed = F.concat(state["cuts"], F.array(state["before"]))
        return F.struct(
            F.when(fits, state["load"] + size).otherwise(size).alias("load"),
            (state["before"] - size).alias("before"),
            F.when(fits, state["cuts"]).otherwise(closed).alias("cuts"),
        )

    empty = F.struct(
        F.lit(0).cast("bigint").alias("load"),
        F.col("total").alias("before"),
        F.array().cast("array<bigint>").alias("cuts"),
    )
    return F.aggregate(F.reverse("sizes"), empty, add)["cuts"]


def _cuts(shards: int) -> Column:
    """Places at which a new shard begins."""

    def add(state: Column, size: Column) -> Column:
        used = F.size(state["cuts"]) + 1
        # Of the shard under way: an even share of what it and the later ones must hold.
        goal = (F.col("total") - state["before"] + state["load"]) / (shards - used + 1)
        past = 2 * state["load"] + size > 2 * goal
        # The shard that begins here is number used; the later ones can hold the rest.
        safe = state["before"] >= F.coalesce(
            F.get("earliest", F.lit(shards - 1) - used), F.lit(0)
        )
        full = state["load"] + size > F.col("capacity")
        cut = (state["place"] > 0) & (used < shards) & (full | (past & safe))
        return F.struct(
            (state["place"] + 1).alias("place"),
            F.when(cut, size).otherwise(state["load"] + size).alias("load"),
            (state["before"] + size).alias("before"),
            F.when(cut, F.concat(state["cuts"], F.array(state["place"])))
            .otherwise(state["cuts"])
            .alias("cuts"),
        )

    empty = F.struct(
        F.lit(0).alias("place"),
        F.lit(0).cast("bigint").alias("load"),
        F.lit(0).cast("bigint").alias("before"),
        F.array().cast("array<int>").alias("cuts"),
    )
    return F.aggregate("sizes", empty, add)["cuts"]
