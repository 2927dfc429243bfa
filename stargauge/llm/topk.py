"""Exact top-k inner products by an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stargauge.sources.staging import stage

SCALE = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
LEVELS = 12
# Possible members per query and block below which rescoring beats another level.
FEW = 32

SEGMENTS = (
    "block int, level int, dim int, impact bigint, places binary, ids binary, vectors binary, "
    "dims int, rest binary"
)
HITS = "query_id bigint, vec_id bigint, score bigint"


def quantized(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, floor(256 * x) of every component as a double. Rows with a null key,
    a null vector or a null or non-finite component are left out."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return (
        vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        .where(finite)
        .select(F.col(key).alias("vec_id"), scaled.alias("v"))
    )


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    if lengths.sum():
        rows = np.repeat(np.arange(len(lists)), lengths)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, np.arange(len(rows)) - starts] = lists.flatten().to_numpy()
    return out


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def index_block(rows: pa.Table) -> pa.Table:
    """Posting segments of one block of vectors.

    A segment holds the places of the vectors that share a dimension and a quantised value, its
    impact. Segments of a level have impacts of one magnitude; level 0 is the greatest. The row of
    level -1 holds keys and exact vectors, for rescoring, and the length of what each vector still
    lacks after every level, for the proof.
    """
    ids = _column(rows, "vec_id").to_numpy().astype(np.int64)
    vectors = _matrix(_column(rows, "v"))
    block = rows.column("block")[0].as_py()
    step = max(1, -(-int(np.abs(vectors).max(initial=0)) // LEVELS))
    magnitude = np.abs(vectors) // step
    # The middle of the quantised range; values of the lowest level, near zero, have none.
    impact = np.sign(vectors) * np.where(magnitude > 0, magnitude * step + step // 2, 0)
    out: list[dict] = []
    rest = []
    missing = vectors.astype(np.float64)
    top = int(magnitude.max(initial=0))
    for level, size in enumerate(range(top, 0, -1)):
        places, dims = np.nonzero(magnitude == size)
        values = impact[places, dims]
        order = np.lexsort((places, values, dims))
        places, dims, values = places[order], dims[order], values[order]
        cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(values) != 0)) + 1
        for part in np.split(np.arange(len(places)), cuts) if len(places) else []:
            out.append(
                {
                    "block": block,
                    "level": level,
                    "dim": int(dims[part[0]]),
                    "impact": int(values[part[0]]),
                    "places": places[part].astype(np.int32).tobytes(),
                }
            )
        missing[places, dims] -= values
        rest.append(np.sqrt((missing**2).sum(axis=1)))
    rest.append(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)))
    out.append(
        {
            "block": block,
            "level": -1,
            "ids": ids.tobytes(),
            "vectors": vectors.tobytes(),
            "dims": vectors.shape[1],
            "rest": np.asarray(rest).tobytes(),
        }
    )
    return pa.Table.from_pylist(out, schema=_SEGMENT_TYPES)


_SEGMENT_TYPES = pa.schema(
    [
        ("block", pa.int32()),
        ("level", pa.int32()),
        ("dim", pa.int32()),
        ("impact", pa.int64()),
        ("places", pa.binary()),
        ("ids", pa.binary()),
        ("vectors", pa.binary()),
        ("dims", pa.int32()),
        ("rest", pa.binary()),
    ]
)
_HIT_TYPES = pa.schema(
    [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
)


def search_block(segments: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The ``k`` best vectors of one block for every query of one block."""
    if not segments.num_rows or not queries.num_rows:
        return _HIT_TYPES.empty_table()
    level = _column(segments, "level").to_numpy()
    head = segments.slice(int(np.flatnonzero(level == -1)[0]), 1).to_pylist()[0]
    ids = np.frombuffer(head["ids"], np.int64)
    vectors = np.frombuffer(head["vectors"], np.int64).reshape(len(ids), head["dims"])
    rest = np.frombuffer(head["rest"], np.float64).reshape(-1, len(ids))
    query_ids = _column(queries, "vec_id").to_numpy().astype(np.int64)
    asked = _matrix(_column(queries, "v"))
    # Dimensions that one side lacks add nothing.
    width = min(vectors.shape[1], asked.shape[1])
    asked = asked[:, :width]
    lengths = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))
    own = ids[:, None] == query_ids[None, :]

    scores = np.zeros((len(ids), len(query_ids)))
    dims, impacts = (_column(segments, n).to_numpy(zero_copy_only=False) for n in ("dim", "impact"))
    places = segments.column("places")
    levels = rest.shape[0] - 1
    possible = ~own
    for at in range(-1, levels):
        if at >= 0:
            postings = np.zeros((len(ids), width))
            for i in np.flatnonzero(level == at):
                if dims[i] < width:
                    found = np.frombuffer(places[int(i)].as_py(), np.int32)
                    postings[found, int(dims[i])] = impacts[i]
            scores += postings @ asked.T
        if len(ids) <= k or (at < 0 < levels):
            continue
        # Cauchy-Schwarz: what is still missing cannot move a score by more than this.
        slack = rest[at][:, None] * lengths[None, :] * (1 + 1e-9) + 1e-6
        low = np.where(own, -np.inf, scores - slack)
        kth = np.partition(low, len(ids) - k, axis=0)[len(ids) - k]
        possible = ~own & (scores + slack >= kth[None, :])
        if possible.sum() <= FEW * len(query_ids):
            break
    rows, columns = np.nonzero(possible)
    exact = np.empty(len(rows), np.int64)
    for start in range(0, len(rows), 1 << 17):
        part = slice(start, start + (1 << 17))
        exact[part] = np.einsum("ij,ij->i", vectors[rows[part], :width], asked[columns[part]])
    order = np.lexsort((ids[rows], -exact, columns))
    rows, columns, exact = rows[order], columns[order], exact[order]
    first = np.searchsorted(columns, np.arange(len(query_ids)))
    kept = np.arange(len(columns)) - first[columns] < k
    return pa.table(
        [query_ids[columns[kept]], ids[rows[kept]], exact[kept]], schema=_HIT_TYPES
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest integer inner products of every query
    with all vectors but those of its own key, ties to the smaller key.

    Both inputs are ``quantized``. Every vector is indexed, in blocks of about ``block_rows``; each
    block of queries meets each block of the index once, and only ``k`` rows per query leave such
    a task. Within a block, posting segments are added up by descending quantised impact until the
    vectors that could still be among the best are few; those, and no others, are rescored
    exactly. Vectors of different length count as filled up with zeros. Repeated rows are vectors
    of their own, but a key is asked once, with its smallest vector. No vectors or no queries give
    no rows. Components must stay below 2 ** 24.
    """
    total, asked = vectors.count(), queries.count()
    blocks = max(1, -(-total // block_rows))
    query_blocks = max(1, -(-asked // query_rows))
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    index = stage(
        vectors.withColumn("block", block_of).groupBy("block").applyInArrow(index_block, SEGMENTS),
        "topk-index",
    )
    packed = (
        queries.groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
    )
    packed = stage(packed, "topk-queries")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = index.select("*", every_part).groupBy("block", "part")
    right = packed.select("*", every_block).groupBy("block", "part")

    def search(segments: pa.Table, asked: pa.Table) -> pa.Table:
        return search_block(segments, asked, k)

    hits = left.cogroup(right).applyInArrow(search, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
