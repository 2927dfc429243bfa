"""Benchmark passages in documents, found by spaced seeds and verified around each hit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.llm.common import may_hold, wanted_bits, without
from stargauge.sources.staging import stage

# Positions of a window that a seed compares (1) and ignores (0). Any two replaced
# words within a window leave most shifts of at least one mask unharmed.
MASKS = ("110101011", "111010011", "110011101")
SPAN = len(MASKS[0])
# A hit counts if this many of the words around it are equal, place by place.
AROUND = 16
LEAST_EQUAL = 0.75
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """64-bit hashes of the lower-case runs of letters and digits; a null text has none."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), lambda w: w != "")
    return F.transform(found, lambda word: F.xxhash64(word))


def _seeds(df: DataFrame, lengths: list[int], wanted: Column | None = None) -> DataFrame:
    """A row per window and mask of ``tokens``, with its ``place`` and ``seed``, and one per run of
    each of the short ``lengths``; only such as ``wanted`` may hold.

    Positions are exploded, not tokens. What follows must stay in generated code up to an
    aggregate or a projection without ``tokens``: rows that leave it are copies, and a copy of the
    array for every window of a long text would fill the memory.
    """
    least = min([SPAN, *lengths])
    places = F.sequence(F.lit(0), F.size("tokens") - least)
    rows = df.select("*", F.explode(F.when(F.size("tokens") >= least, places)).alias("place"))

    def key(i: int, kept: list[int], size: int) -> Column:
        inside = F.col("place") + size <= F.size("tokens")
        return F.when(
            inside, F.xxhash64(F.lit(i), *[F.get("tokens", F.col("place") + at) for at in kept])
        )

    masks = [[at for at in range(SPAN) if mask[at] == "1"] for mask in MASKS]
    keys = [key(i, kept, SPAN) for i, kept in enumerate(masks)]
    # The seed of a short item is all its words.
    keys += [key(SPAN + size, list(range(size)), size) for size in lengths]
    # Exploded, a seed is computed once, however often what follows looks at it.
    rows = rows.select("*", F.explode(F.array(*keys)).alias("seed")).where("seed IS NOT NULL")
    return rows if wanted is None else rows.where(may_hold(wanted, F.col("seed")))


def _item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """Seeds of the items, and which of their words a hit compares: ``compared`` from ``start``.
    A short item has one, of all its words."""
    size = F.least(F.size("tokens"), F.lit(AROUND))
    last = F.size("tokens") - size
    start = F.greatest(F.lit(0), F.least(F.col("place") - (AROUND - SPAN) // 2, last))
    long = _seeds(items.where(F.size("tokens") >= SPAN), [])
    parts = [long] + [_seeds(items.where(F.size("tokens") == n), [n]) for n in lengths]
    return reduce(DataFrame.unionByName, parts).select(
        "item_id",
        F.col("tokens").alias("item"),
        F.col("place").alias("item_place"),
        start.alias("start"),
        size.alias("compared"),
        "seed",
    )


def _equal_around() -> Column:
    """Words around a hit that are equal place by place. ``near`` are the words of the text from
    ``first`` on."""
    shift = F.col("place") - F.col("item_place") - F.col("first")
    total = F.lit(0)
    for i in range(AROUND):
        at = F.col("start") + i
        equal = (F.lit(i) < F.col("compared")) & (F.get("near", shift + at) == F.get("item", at))
        total = total + F.when(equal, 1).otherwise(0)
    return total


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, equal, compared`` for every document with a passage of an item.

    A window of ``SPAN`` words hits if the words under one mask are equal. Around each hit
    ``AROUND`` words (a shorter item: all its words) are compared place by place, and at least
    ``LEAST_EQUAL`` of them must be equal, so replaced words do not hide a passage. ``equal`` is
    the best count. An item shorter than ``SPAN`` words has no window; it is found where all its
    words stand in a row. Items without words, and null texts, match nothing. Null keys are keys
    like others, repeated rows add nothing. Other columns are not read.

    One form at every size: a filter of the items' seeds, of fixed size, is probed where the texts
    are read. Windows that pass carry the words around them, so a hit is verified on the very text
    it was found in; they meet the seeds in a shuffled join between written tables, which splits a
    seed that very many texts share. Texts are read once and never shuffled.
    """
    items = benchmark.select(F.col(item_key).alias("item_id"), words(F.col(item_text)).alias("tokens"))
    items = stage(items.where(F.size("tokens") > 0).distinct(), "benchmark-items")
    short = items.where(F.size("tokens") < SPAN).select(F.size("tokens").alias("n")).distinct()
    # As many lengths as are shorter than a window.
    lengths = sorted(row["n"] for row in short.collect())
    seeds = stage(_item_seeds(items, lengths), "benchmark-seeds")
    read = docs.select(F.col(key).alias("doc_id"), words(F.col(text)).alias("tokens"))
    first = F.greatest(F.col("place") - AROUND, F.lit(0))
    passed = _seeds(read, lengths, wanted_bits(seeds.select("seed"))).select(
        "doc_id", "place", "seed", first.alias("first"),
        F.slice("tokens", first + 1, F.lit(2 * AROUND)).alias("near"),
    )
    hits = stage(passed, "benchmark-windows").join(seeds, "seed")
    checked = hits.select("doc_id", "item_id", "compared", _equal_around().alias("equal"))
    enough = F.when(F.col("compared") < SPAN, F.col("compared")).otherwise(
        F.ceil(F.col("compared") * LEAST_EQUAL)
    )
    return (
        checked.where(F.col("equal") >= enough)
        .groupBy("doc_id", "item_id")
        .agg(F.max("equal").alias("equal"), F.max("compared").alias("compared"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no passage of the benchmark. Rows go by a hash
    of their text alone, so keys may be null or repeated; a null text holds no passage."""

    def mark(column: Column) -> Column:
        return F.unhex(F.sha1(column))

    marked = docs.select(mark(F.col(text)).alias("_leak"), F.col(text).alias("text"))
    leaks = contaminated(marked, benchmark, key="_leak").select(F.col("doc_id").alias("_leak"))
    found = stage(leaks.distinct(), "benchmark-leaks")
    return without(docs, found, {"_leak": mark(F.col(text))})
