"""Helpers of the operators: bounded samples, Arrow slices, distinct words of a batch."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1024 * 1024
# Settings under which tables are handed to Python: bytes of one batch.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 * 1024 * 1024


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame, in a session that hands its rows to Python in batches of few bytes: two
    tasks of an executor hold a batch each, on both sides."""
    df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def _give_back() -> None:
    """Return what a finished task no longer uses; its worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def bounded_sample(df: DataFrame, key: Column, rows: int, max_rows: int, seed: int = 0) -> DataFrame:
    """About ``max_rows`` of the ``rows`` rows, chosen by a hash of ``key``: the same ones on
    every run and for any partitioning. For fitting only."""
    if rows <= max_rows:
        return df
    share = int(max_rows / rows * (1 << 31))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 31)) < share)


def held_out(key: Column, parts: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == remainder, F.lit(False))


# Bits of a filter of wanted hashes: two megabytes, whatever there is to be found.
FILTER_BITS = 1 << 24
_WORD = 64


def wanted_bits(hashes: DataFrame, bits: int = FILTER_BITS) -> Column:
    """A Bloom filter of the one column of ``hashes`` as one array value, for ``may_hold``.

    It has the same size for any number of hashes; the more there are, the more others pass.
    """
    spark = hashes.sparkSession
    (name,) = hashes.columns
    places = hashes.select(F.explode(F.array(*_places(F.col(name), bits))).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _inside(F.col("place")))
    words = places.groupBy(_word(F.col("place")).alias("id")).agg(F.bit_or(bit).alias("word"))
    every = spark.range(bits // _WORD).join(words, "id", "left")
    filled = F.struct("id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
    dense = every.agg(F.array_sort(F.collect_list(filled)).alias("words"))
    return dense.select(F.col("words.word")).scalar()


def may_hold(wanted: Column, value: Column, bits: int = FILTER_BITS) -> Column:
    """False only where the hash is none of the wanted ones."""

    def has(place: Column) -> Column:
        word = F.get(wanted, _word(place).cast("int"))
        return F.call_function("shiftright", word, _inside(place)).bitwiseAND(1) == 1

    one, two = _places(value, bits)
    return has(one) & has(two)


def _places(value: Column, bits: int) -> tuple[Column, Column]:
    size = F.lit(bits).cast("bigint")
    return F.pmod(value, size), F.pmod(F.call_function("shiftrightunsigned", value, F.lit(32)), size)


def _word(place: Column) -> Column:
    return F.call_function("shiftright", place, F.lit(6))


def _inside(place: Column) -> Column:
    return place.bitwiseAND(_WORD - 1).cast("int")


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are no row of ``gone``, a table with the columns that
    ``keys`` names. A null key is none.

    One form at every size: rows that a filter of the keys rules out are passed on from the scan, and
    only the others, texts included, are shuffled to be looked up.
    """
    wanted = wanted_bits(gone.select(F.xxhash64(*keys).alias("h")))
    possible = may_hold(wanted, F.xxhash64(*keys.values()))
    named = gone.select(*(F.col(name).alias(f"_gone_{name}") for name in keys))
    same = [column == F.col(f"_gone_{name}") for name, column in keys.items()]
    kept = docs.where(possible).join(named, reduce(Column.__and__, same), "left_anti")
    return docs.where(~possible).unionByName(kept)


def slices(
    batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text of one slice stays near ``limit`` bytes. A longer text
    is a slice of its own, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    _give_back()


@dataclass(frozen=True)
class Words:
    """The words of a slice: ``codes[offsets[i]:offsets[i + 1]]`` are those of text i, as places
    in ``entries``."""

    offsets: np.ndarray
    codes: np.ndarray
    entries: pa.Array


def distinct_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words between white space; a null text has none."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(offsets - offsets[0], codes, coded.dictionary)


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings after each other, and where each string starts."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    joined = "".join(strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i + 1]]``; 0 for empty ranges."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def segment_max(values: np.ndarray, offsets: np.ndarray, empty: float) -> np.ndarray:
    """Maxima of ``values[offsets[i]:offsets[i + 1]]``; ``empty`` for empty ranges."""
    out = np.full(len(offsets) - 1, empty, np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(values, offsets[:-1][full])
    return out


def key_runs(
    batches: Iterator[pa.RecordBatch], keys: int = 1
) -> Iterator[pa.Table]:
    """Rows of a partition sorted by its first ``keys`` columns, cut into one table per key."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changed = np.zeros(batch.num_rows, bool)
        for column in columns:
            changed[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            key = tuple(column[start] for column in columns)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _known(labels: DataFrame, label: str, eligible: Column, key: str) -> DataFrame:
    return (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & eligible)
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(label).cast("int").alias("label"))
    )


def known_labels(labels: DataFrame, label: str, eligible: Column, key: str = "doc_id") -> list:
    """Eligible keys per label."""
    return _known(labels, label, eligible, key).groupBy("label").count().collect()


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    eligible: Column,
    max_per_class: int,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``text``, ``label`` and ``half`` of labelled rows: at most about ``max_per_class`` keys of
    each label, chosen by a hash of the key. ``half`` splits the keys in two by another hash.

    ``eligible`` is a condition on ``key``. Only the chosen keys are sent to the scan of the
    documents, and their number is bounded. A key with several labels has the greatest; null keys,
    labels and texts teach nothing.
    """
    known = _known(labels, label, eligible, key)
    rows = {r["label"]: r["count"] for r in known_labels(labels, label, eligible, key)}
    chosen = None
    for value, n in sorted(rows.items()):
        part = bounded_sample(known.where(F.col("label") == value), F.col("key"), n, max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = known
    texts = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text")
    )
    half = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(2)).cast("int").alias("half")
    # About max_per_class keys of each label at most.
    return texts.join(F.broadcast(chosen), "key").select("text", "label", half)


def fit_logistic(
    features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-4
) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method with halved steps;
    ``ridge`` is a share of the summed weights, so separable classes have a solution too."""
    x = np.column_stack([features, np.ones(len(features))])
    penalty = ridge * weights.sum()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return weights @ (np.logaddexp(0, z) - labels * z) + penalty / 2 * (w @ w)

    w = np.zeros(x.shape[1])
    value = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weights * (p - labels)) + penalty * w
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > value:
            size /= 2
        new = loss(w - size * step)
        if size <= 1e-6 or value - new < 1e-9 * max(1.0, value):
            break
        w, value = w - size * step, new
    return w


def logistic(features: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ w[:-1] + w[-1], -30, 30)))
