"""Similarity join on word n-grams: MinHash bands find candidates, full sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.llm.common import (
    code_points,
    distinct_words,
    may_hold,
    slices,
    small_batches,
    wanted_bits,
    without,
)
from stargauge.llm.components import components
from stargauge.sources.staging import stage

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
MAX_HASHES = 80
# Members and bytes of sets of one block of a group.
BLOCK_MEMBERS = 256
BLOCK_BYTES = 16 * 1024 * 1024
COLUMNS = 2048
NO_KEY = -(1 << 63)

FEATURES = "id bigint, mark binary, high bigint, low bigint, n bigint, bands array<bigint>"
SETS = "high bigint, low bigint, n bigint, grams binary"
FOUND = "code bigint, root bigint, text_links bigint, doc_links bigint"

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


def bands_and_rows(similarity: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """The most rows per band, within ``max_hashes`` in all, at which a pair of the given
    similarity shares a band with probability ``recall``; fails if there are none."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > max_hashes:
            break
        best = (max(1, bands), rows)
    if not best:
        raise ValueError(
            f"{max_hashes} hashes do not find pairs of similarity {similarity} with recall {recall}"
        )
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _powers(count: int, base: int) -> np.ndarray:
    return np.array([pow(base, i, 1 << 64) for i in range(count)], np.uint64)


def _word_hashes(words: list[str]) -> np.ndarray:
    points, starts = code_points(words)
    place = np.arange(len(points)) - np.repeat(starts[:-1], np.diff(starts))
    powers = _powers(int(place.max(initial=0)) + 1, 0x100000001B3)
    terms = (points.astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return _mix(sums[starts[1:]] - sums[starts[:-1]])


def gram_sets(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of every text, sorted, and where those of each text start.

    Words are lower-case runs between white space without anything but letters, marks and digits.
    A text of fewer words than ``size`` has one n-gram of all its words, one without words none.
    """
    words = distinct_words(texts)
    cleaned = pc.replace_substring_regex(
        words.entries, pattern=r"[^\p{L}\p{M}\p{N}]+", replacement=""
    ).to_pylist()
    hashed = _word_hashes(cleaned)
    filled = np.fromiter(map(bool, cleaned), bool, len(cleaned))[words.codes]
    documents = len(words.offsets) - 1
    owner = np.repeat(np.arange(documents), np.diff(words.offsets))[filled]
    sequence = hashed[words.codes[filled]]
    counts = np.bincount(owner, minlength=documents)
    ends = np.repeat(np.cumsum(counts), counts)
    weights = _powers(size, 0xC2B2AE3D27D4EB4F)
    n = len(sequence)
    grams = np.zeros(n, np.uint64)
    for i in range(size):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - i] = sequence[i:] * weights[i] if i < n else 0
        grams += np.where(np.arange(n) + i < ends, shifted, np.uint64(0))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    whole = np.arange(n) + size <= ends
    short = (np.arange(n) == first[owner]) & (counts[owner] < size)
    kept = whole | short
    grams, owner = _mix(grams[kept]), owner[kept]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=documents))])


def _signatures(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of every text; those of texts without n-grams mean nothing."""
    random = np.random.default_rng(20240501)
    factors = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(starts) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(starts))
    if not len(full):
        return out
    for band in range(bands):
        key = np.full(len(full), band + 1, np.uint64) * _A
        for at in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat(grams * factors[at] + shifts[at], starts[:-1][full])
            key = _mix(key * _A + least)
        out[full, band] = key
    return out


def _fingerprints(grams: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """``high``, ``low`` and ``n`` of every set; equal sets have equal ones."""
    sums = np.zeros((2, len(grams) + 1), np.uint64)
    np.cumsum(_mix(grams * _A), dtype=np.uint64, out=sums[0, 1:])
    np.cumsum(_mix(grams ^ _B), dtype=np.uint64, out=sums[1, 1:])
    high, low = sums[:, starts[1:]] - sums[:, starts[:-1]]
    return [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(np.diff(starts))]


def _featurize(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            grams, starts = gram_sets(part.column(1))
            keys = _signatures(grams, starts, bands, rows)
            flat = pa.array(keys.view(np.int64).ravel())
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), *_fingerprints(grams, starts),
                 pa.ListArray.from_arrays(offsets, flat)],
                names=["id", "mark", "high", "low", "n", "bands"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        grams, starts = gram_sets(part.column(1))
        offsets = pa.py_buffer((starts * 8).astype(np.int32))
        packed = pa.Array.from_buffers(
            pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(grams.tobytes())]
        )
        yield pa.RecordBatch.from_arrays(
            [*_fingerprints(grams, starts), packed], names=["high", "low", "n", "grams"]
        )


def similar(
    sets: list[np.ndarray], allowed: np.ndarray, similarity: float = SIMILARITY
) -> np.ndarray:
    """Which allowed pairs of sets reach the similarity, exactly."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # An n-gram of one set alone is in no intersection.
    used = shared > 1
    number = np.cumsum(used) - 1
    kept = used[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = int(used.sum())
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        tile = np.zeros((len(sets), min(COLUMNS, width - start)), np.float32)
        tile[owner[a:b], column[a:b] - start] = 1
        common += tile @ tile.T
    union = sizes[:, None] + sizes[None, :] - common
    return allowed & (common >= similarity * union - 1e-6)


def _verify(similarity: float):
    def run(rows: pa.Table) -> pa.Table:
        pivot, i, j = (rows.column(name)[0].as_py() for name in ("pivot", "i", "j"))
        ids = rows.column("code").to_numpy()
        order = np.argsort(ids, kind="stable")
        rows, ids = rows.take(order), ids[order]
        block = rows.column("block").to_numpy()
        docs = rows.column("docs").to_numpy()
        pivots = rows.column("pivots").combine_chunks()
        member = np.repeat(np.arange(len(ids)), pivots.value_lengths().to_numpy())
        names = pivots.flatten().to_numpy()
        allowed = np.triu(np.ones((len(ids), len(ids)), bool), 1)
        if i != j:
            allowed &= block[:, None] != block[None, :]
        # A pair belongs to the group of the smallest pivot that its two members share.
        smaller = names < pivot
        _, column, shared = np.unique(names[smaller], return_inverse=True, return_counts=True)
        several = shared > 1
        kept = several[column]
        if kept.any():
            holds = np.zeros((len(ids), int(several.sum())), np.float32)
            holds[member[smaller][kept], (np.cumsum(several) - 1)[column[kept]]] = 1
            allowed &= (holds @ holds.T) == 0
        if not allowed.any():
            return _FOUND_TYPES.empty_table()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
        linked = similar(sets, allowed, similarity)
        linked |= linked.T
        text_links = linked.sum(axis=1)
        doc_links = linked @ docs
        root = np.arange(len(ids))
        while True:
            least = np.where(linked, root[None, :], len(ids)).min(axis=1)
            new = np.minimum(root, least)
            if (new == root).all():
                break
            root = new
        hit = text_links > 0
        return pa.table(
            [ids[hit], ids[root[hit]], text_links[hit], doc_links[hit]], schema=_FOUND_TYPES
        )

    return run


_FOUND_TYPES = pa.schema(
    [("code", pa.int64()), ("root", pa.int64()), ("text_links", pa.int64()), ("doc_links", pa.int64())]
)


def _mark(text: Column) -> Column:
    """Tells rows apart that share a key but not the text."""
    return F.unhex(F.sha1(text))


def _linked(
    docs: DataFrame, key: str, text: str, similarity: float, recall: float
) -> tuple[DataFrame, DataFrame]:
    """``id, mark, high, low, n`` of every row, and of every class of rows with an equal set its
    smallest key ``rep``, its rows ``docs``, its links, and ``least``: key and mark of the first
    row of all classes that links lead to.

    A class is known by its set, as ``code``; keys may repeat and only name rows in the result."""
    bands, rows = bands_and_rows(similarity, recall, MAX_HASHES)
    keyed = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("id"),
        F.col(text).alias("text"),
        _mark(F.col(text)).alias("mark"),
    )
    features = stage(small_batches(keyed).mapInArrow(_featurize(bands, rows), FEATURES), "jaccard-features")
    classes = (
        features.where("n > 0")
        .groupBy("high", "low", "n")
        .agg(
            # The row that names the class, and whose text is read again.
            F.min(F.struct("id", "mark")).alias("first"),
            F.count("*").alias("docs"),
            F.first("bands").alias("bands"),
        )
    )
    # Codes are fixed by being written.
    classes = stage(
        classes.withColumn("code", F.monotonically_increasing_id()), "jaccard-classes"
    )
    hashed = classes.select("code", "n", "docs", F.explode("bands").alias("band"))
    buckets = stage(
        hashed.groupBy("band")
        .agg(F.min("code").alias("pivot"), F.count("*").alias("size"))
        .where("size > 1")
        .drop("size"),
        "jaccard-buckets",
    )
    # At most one pivot per band.
    members = stage(
        hashed.join(buckets, "band")
        .groupBy("code", "n", "docs")
        .agg(F.sort_array(F.collect_set("pivot")).alias("pivots"))
        .select("code", "n", "docs", "pivots", F.explode("pivots").alias("pivot")),
        "jaccard-members",
    )
    first = F.col("pivots")[0]
    groups = (
        members.groupBy("pivot")
        .agg(
            F.count("*").alias("size"),
            F.sum("n").alias("grams"),
            F.min(first).alias("least"),
            F.max(first).alias("most"),
        )
        # Where all members share one smaller pivot, its group holds every pair.
        .where("size > 1 AND NOT (least = most AND least < pivot)")
    )
    parts = F.greatest(
        F.ceil(F.col("size") / BLOCK_MEMBERS), F.ceil(F.col("grams") * 8 / BLOCK_BYTES)
    )
    groups = stage(groups.select("pivot", parts.cast("int").alias("parts")), "jaccard-groups")
    tasks = (
        members.join(groups, "pivot")
        .withColumn("block", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )
    tasks = stage(
        tasks.select("pivot", "i", "j", "code", "block", "docs", "pivots"), "jaccard-tasks"
    )
    wanted = stage(
        classes.join(tasks.select("code").distinct(), "code", "left_semi").select(
            "code", "high", "low", "n", F.xxhash64("first.id", "first.mark").alias("h")
        ),
        "jaccard-wanted",
    )
    # One form at every size: a filter of the wanted rows is probed in the scan, and texts are
    # turned into sets where they are read. Sets that no task names fall away in the join below.
    possible = may_hold(wanted_bits(wanted.select("h")), F.xxhash64("id", "mark"))
    sets = (
        small_batches(keyed.where(possible).select("id", "text"))
        .mapInArrow(_sets, SETS)
        .groupBy("high", "low", "n")
        .agg(F.min("grams").alias("grams"))
    )
    found = stage(
        tasks.join(wanted.drop("h"), "code")
        .join(sets, ["high", "low", "n"])
        .select("pivot", "i", "j", "code", "block", "docs", "pivots", "grams")
        .groupBy("pivot", "i", "j")
        .applyInArrow(_verify(similarity), FOUND),
        "jaccard-found",
    )
    joined = stage(
        components(found.select(F.col("code").alias("a"), F.col("root").alias("b"))),
        "jaccard-components",
    )
    # Staged, so that the join of a large component starts from two plain shuffles.
    least = stage(
        joined.join(classes.select("code", "first"), F.col("node") == F.col("code"))
        .groupBy("component")
        .agg(F.min("first").alias("least")),
        "jaccard-least",
    )
    links = (
        found.groupBy("code")
        .agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
        .join(joined, F.col("code") == F.col("node"))
        .select("code", "text_links", "doc_links", "component")
        .join(least, "component")
        .drop("component")
    )
    nothing = F.lit(0).cast("bigint")
    per_class = stage(
        classes.join(links, "code", "left").select(
            "high",
            "low",
            "n",
            "docs",
            F.col("first")["id"].alias("rep"),
            F.coalesce("least", "first").alias("least"),
            F.coalesce("text_links", nothing).alias("text_links"),
            F.coalesce("doc_links", nothing).alias("doc_links"),
        ),
        "jaccard-per-class",
    )
    return features.drop("bands"), per_class


def link_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """``doc_id, class_id, copy_id, n_links, n_text_links`` of every row.

    Two documents are linked if the Jaccard similarity of their sets of word 5-grams is at least
    ``similarity``. ``n_links`` counts the other documents a row is linked to, ``n_text_links``
    the different sets among them, ``copy_id`` is the smallest key with an equal set and
    ``class_id`` the smallest key that links lead to. Copies are one row from the start and are
    never paired with each other.

    Bands and rows are chosen so that a pair at the threshold is found with probability
    ``recall``. The members of a band's bucket form the group of its smallest code, groups are cut
    into blocks of bounded size, and each pair of blocks is compared by full sets in one task that
    returns one row per member, so no list of pairs is ever made and no candidate is dropped. A
    pair that several groups hold counts in the first.

    Null and wordless texts have no n-grams and no links. Null keys are one key, the smallest;
    rows that repeat a key count as documents of their own, each with the links of its own text.
    Other columns are not read.
    """
    features, per_class = _linked(docs, key, text, similarity, recall)
    nothing = F.lit(0).cast("bigint")
    return features.join(per_class, ["high", "low", "n"], "left").select(
        F.when(F.col("id") != NO_KEY, F.col("id")).alias("doc_id"),
        F.coalesce(F.col("least")["id"], "id").alias("class_id"),
        F.coalesce("rep", "id").alias("copy_id"),
        F.coalesce(F.col("doc_links") + F.col("docs") - 1, nothing).alias("n_links"),
        F.coalesce("text_links", nothing).alias("n_text_links"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked documents, with all its columns: that of the smallest key,
    a null key being the smallest. Rows without n-grams all stay. Where several rows have that key and
    text, that with the least other columns stays. A row goes or stays by its key and text, never with others of its key."""
    features, per_class = _linked(docs, key, text, SIMILARITY, RECALL)
    grouped = per_class.where("docs > 1 OR text_links > 0").select("high", "low", "n", "least")
    found = stage(
        features.join(grouped, ["high", "low", "n"]).select(
            F.col("id").alias("_id"),
            F.col("mark").alias("_mark"),
            (F.struct("id", "mark") == F.col("least")).alias("first"),
        ),
        "jaccard-grouped",
    )
    keys = {
        "_id": F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)),
        "_mark": _mark(F.col(text)),
    }
    dropped = found.where("NOT first").select("_id", "_mark").distinct()
    repeated = (
        found.where("first").groupBy("_id", "_mark").agg(F.count("*").alias("n")).where("n > 1")
    )
    # Of rows that repeat the first key and text, the one with the least other columns stays.
    decided = dropped.withColumn("several", F.lit(False)).unionByName(
        repeated.select("_id", "_mark", F.lit(True).alias("several"))
    )
    decided = stage(decided, "jaccard-decided")
    kept = without(docs, decided, keys)
    others = [F.col(name) for name in docs.columns if name not in (key, text)]
    marked = docs.where(may_hold(wanted_bits(
        decided.where("several").select(F.xxhash64("_id", "_mark").alias("h"))
    ), F.xxhash64(*keys.values()))).withColumns(keys)
    several = (
        marked.join(decided.where("several").drop("several"), ["_id", "_mark"], "left_semi")
        .groupBy(key, text)
        .agg(F.min(F.struct(F.lit(0).alias("_none"), *others)).alias("_row"))
        .select(key, text, "_row.*")
        .select(*docs.columns)
    )
    return kept.unionByName(several)
