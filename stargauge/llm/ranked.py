"""Ranked lexical search: the Best Position Algorithm over impact lists, block by block.

Documents are dealt to blocks of a fixed size by a hash of their row. A block holds, for every term
that an item asks for, the list of its documents by descending impact. Each item is answered in each
block by itself, and only its best documents leave the block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stargauge.llm.common import slices, small_batches
from stargauge.sources.staging import stage

# What stands between terms: all of ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Fixed values of the score.
WEIGHT_SCALE = 1_000
IMPACT_SCALE = 1_000_000_000
TERM_SCALE = 1_000
LENGTH_SCALE = 12
WHOLE, LENGTH_SHARE = 100, 25

BLOCK_DOCUMENTS = 8_192
# Items that one task answers; the index is read again for every further part of the items.
ITEMS_PER_PART = 4_096
# Bits of the filter of wanted terms; it is of this size for any number of items.
FILTER_BITS = 1 << 22
# Positions of every list that the first round reads; each round reads twice as many.
STEP = 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The text of each term, and the terms of all texts in order."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    flat, parents = lists.flatten(), pc.list_parent_indices(lists)
    given = pc.not_equal(flat, "")
    return parents.filter(given).to_numpy().astype(np.int64), flat.filter(given)


def _slot(term: str) -> int:
    return zlib.crc32(term.encode()) % FILTER_BITS


def _counted(texts: pa.Array, wanted: np.ndarray | None) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Terms of each text, its different wanted terms, and how often it holds each."""
    parents, flat = terms_of(texts)
    n = np.bincount(parents, minlength=len(texts))
    coded = flat.dictionary_encode()
    entries = coded.dictionary
    codes = coded.indices.to_numpy().astype(np.int64)
    if wanted is not None:
        asked = np.fromiter((wanted[_slot(term)] for term in entries.to_pylist()), bool, len(entries))
        kept = asked[codes] if len(codes) else np.zeros(0, bool)
        parents, codes = parents[kept], codes[kept]
    width = max(len(entries), 1)
    pairs, times = np.unique(parents * width + codes, return_counts=True)
    offsets = pa.array(np.searchsorted(pairs, np.arange(len(texts) + 1) * width).astype(np.int32))
    terms = pa.ListArray.from_arrays(offsets, entries.take(pa.array(pairs % width)))
    return n, terms, pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))


def _count_terms(rows: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """``id, n, terms, times`` of rows ``id, text``, in order."""
    packed = None if wanted is None else np.packbits(wanted).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        if packed is not None:
            bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for part in slices(batches, 1):
            n, terms, times = _counted(part.column(1), bits)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), terms, times], names=["id", "n", "terms", "times"]
            )

    key_type = rows.schema["id"].dataType.simpleString()
    return small_batches(rows).mapInArrow(
        run, f"id {key_type}, n bigint, terms array<string>, times array<int>"
    )


def _wanted(items: DataFrame) -> np.ndarray:
    """The filter: the slots that the terms of all items fall into."""
    terms = items.select(F.explode("terms").alias("term"))
    slot = F.pmod(F.crc32("term"), F.lit(FILTER_BITS)).alias("slot")
    slots = terms.select(slot).distinct().toArrow().column("slot").to_numpy()
    out = np.zeros(FILTER_BITS, bool)
    out[slots.astype(np.int64)] = True
    return out


def _queries(items: DataFrame, postings: DataFrame, n: int) -> DataFrame:
    """``row, item_id, terms, weights``: weights count the repeats of a term. Terms that no
    document holds are left out."""
    asked = items.select("row", "item_id", F.explode(F.arrays_zip("terms", "times")).alias("t"))
    asked = asked.select("row", "item_id", F.col("t.terms").alias("term"), F.col("t.times").alias("times"))
    held = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0)
    weight = F.floor(F.lit(float(WEIGHT_SCALE)) * F.log(ratio)).cast("bigint")
    pair = F.struct("term", (weight * F.col("times")).alias("weight"))
    weighed = asked.join(held, "term").groupBy("row").agg(
        F.first("item_id").alias("item_id"), F.sort_array(F.collect_list(pair)).alias("pairs")
    )
    return weighed.select(
        "row", "item_id", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights")
    )


class Block:
    """Impact lists of one block: postings sorted by term and descending impact, and the same
    postings by document, for direct accesses."""

    def __init__(self, docs: pa.Table, total: int, length: int) -> None:
        lists = docs.column("terms").combine_chunks()
        owners = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.code = {term: i for i, term in enumerate(coded.dictionary.to_pylist())}
        codes = coded.indices.to_numpy().astype(np.int64)
        tf = docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        n = docs.column("n").to_numpy().astype(np.int64)
        norm = WHOLE - LENGTH_SHARE + (LENGTH_SHARE * n * total) // length
        impact = (IMPACT_SCALE * tf) // (TERM_SCALE * tf + LENGTH_SCALE * norm[owners])

        order = np.lexsort((owners, -impact, codes))
        self.docs, self.impacts = owners[order], impact[order]
        self.starts = np.searchsorted(codes[order], np.arange(len(self.code) + 1))
        # By document: its terms, their impacts and their places in the sorted lists.
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.codes, self.by_doc = codes, impact
        self.rows = np.searchsorted(owners, np.arange(docs.num_rows + 1))
        keys = docs.column("id").combine_chunks()
        ranks = pc.rank(keys, "ascending", null_placement="at_start", tiebreaker="dense")
        self.key_order = ranks.to_numpy().astype(np.int64)

    def best(self, codes: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` documents with the highest scores above 0, equal ones by
        ascending key.

        Every round reads on in all lists. A document met for the first time is scored at once by
        direct accesses, which mark its position in every list it stands in. The best position of a
        list is the last one before which all are marked; no unmet document can score more than
        what stands right after the best positions. The search ends when that is strictly below
        the k-th score, so that no equal score is missed.
        """
        weight = np.zeros(len(self.code), np.int64)
        weight[codes] = weights
        seen = np.zeros(len(self.docs), bool)
        met = np.zeros(len(self.key_order), bool)
        ends = self.starts[codes + 1]
        position = self.starts[codes].copy()
        found = np.zeros(0, np.int64)
        scores = np.zeros(0, np.int64)
        depth, step = 0, STEP
        while len(codes):
            read = [
                self.docs[start + depth : min(start + depth + step, end)]
                for start, end in zip(self.starts[codes], ends)
            ]
            fresh = np.concatenate(read)
            fresh = np.unique(fresh[~met[fresh]])
            met[fresh] = True
            if len(fresh):
                sizes = self.rows[fresh + 1] - self.rows[fresh]
                firsts = np.cumsum(sizes) - sizes
                at = np.arange(sizes.sum()) + np.repeat(self.rows[fresh] - firsts, sizes)
                local = weight[self.codes[at]]
                seen[self.place[at[local > 0]]] = True
                found = np.concatenate([found, fresh])
                scores = np.concatenate([scores, np.add.reduceat(local * self.by_doc[at], firsts)])
                order = np.lexsort((self.key_order[found], -scores))[:k]
                found, scores = found[order], scores[order]
            depth, step = depth + step, 2 * step
            bound = 0
            for i, (end, factor) in enumerate(zip(ends, weights)):
                rest = seen[position[i] : end]
                ahead = int(rest.argmin()) if len(rest) else 0
                # No unmarked position at all: the list is read.
                position[i] = end if len(rest) and rest[ahead] else position[i] + ahead
                if position[i] < end:
                    bound += int(factor) * int(self.impacts[position[i]])
            if bound == 0 or (len(found) == k and bound < scores[-1]):
                break
        above = scores > 0
        return found[above], scores[above]


def _search(docs: pa.Table, items: pa.Table, total: int, length: int, k: int) -> pa.Table:
    schema = pa.schema(
        [
            ("row", pa.int64()),
            ("item_id", items.schema.field("item_id").type),
            ("doc_id", docs.schema.field("id").type),
            ("score", pa.int64()),
        ]
    )
    if not docs.num_rows or not items.num_rows:
        return schema.empty_table()
    block = Block(docs, total, length)
    rows, places, scores = [], [], []
    terms, weights = (items.column(name).combine_chunks() for name in ("terms", "weights"))
    for i in range(items.num_rows):
        known = [
            (block.code[term], weight)
            for term, weight in zip(terms[i].as_py(), weights[i].as_py())
            if term in block.code and weight > 0
        ]
        pairs = np.array(known, np.int64).reshape(-1, 2)
        found, score = block.best(pairs[:, 0], pairs[:, 1], k)
        rows.append(np.full(len(found), i))
        places.append(found)
        scores.append(score)
    at, where = pa.array(np.concatenate(rows)), pa.array(np.concatenate(places))
    columns = [
        items.column("row").take(at),
        items.column("item_id").take(at),
        docs.column("id").take(where),
        pa.array(np.concatenate(scores)),
    ]
    return pa.table(columns, schema=schema)


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_documents: int = BLOCK_DOCUMENTS,
    items_per_part: int = ITEMS_PER_PART,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 for
    every item, equal scores by ascending key, a null key first.

    Terms, weights and scores are those of the contract. The texts are read once: only terms that
    pass a filter of what the items ask for leave the scan, with the number of all terms. The filter
    has a fixed size; a term that passes by chance is in no query. Blocks of documents are shuffled
    once; what is repeated for each block are the items, which are few against the documents. Hashes
    of row numbers deal the blocks, so that no key, text or term can fill one.

    Null and empty texts have no terms: they count nowhere and are found by nothing. Rows that
    repeat a key or a text are documents or items of their own. A text of any length is one
    document. No documents, or no items, give no rows. Other columns are not read.
    """
    number = F.monotonically_increasing_id().alias("row")
    wanted_rows = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("text"))
    asked = _count_terms(wanted_rows, None).where("n > 0")
    asked = stage(
        asked.select(number, F.col("id").alias("item_id"), "terms", "times"), "ranked-items"
    )
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    held = _count_terms(texts, _wanted(asked)).where("n > 0")
    # A row's number holds once it is written.
    postings = stage(held.select(number, "id", "n", "terms", "times"), "ranked-postings")
    whole = postings.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    total, length = whole["n"], max(whole["l"], 1)
    queries = stage(_queries(asked, postings, total), "ranked-queries")

    blocks = max(1, -(-total // block_documents))
    parts = max(1, -(-queries.count() // items_per_part))

    def dealt(column: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked_rows = postings.where(F.size("terms") > 0)
    left = asked_rows.select(
        dealt(F.col("row"), blocks).alias("block"), each(parts).alias("part"),
        "id", "n", "terms", "times",
    )
    right = queries.select(
        each(blocks).alias("block"), dealt(F.col("row"), parts).alias("part"),
        "row", "item_id", "terms", "weights",
    )

    def search(some: pa.Table, for_items: pa.Table) -> pa.Table:
        return _search(some, for_items, total, length, k)

    types = [queries.schema["item_id"], postings.schema["id"]]
    item_type, key_type = (field.dataType.simpleString() for field in types)
    hits = (
        left.groupBy("block", "part")
        .cogroup(right.groupBy("block", "part"))
        .applyInArrow(search, f"row bigint, item_id {item_type}, doc_id {key_type}, score bigint")
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), "doc_id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
