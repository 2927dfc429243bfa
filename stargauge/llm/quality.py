"""Quality by compression: dictionaries of good and bad text, and a calibrated difference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.llm.common import (
    bounded_sample,
    fit_logistic,
    held_out,
    known_labels,
    labelled_sample,
    logistic,
    slices,
    small_batches,
)
from stargauge.sources.staging import stage

CHUNK = 2048
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
# Bytes that any compressed chunk has besides its content.
FRAME = 9
# Bounds of the fit.
DOCS_PER_CLASS = 4_000
CHUNKS_PER_CLASS = 4_000
CELLS = 64
PRIOR = 0.5
# What short texts are mixed with: so many bytes that compress to this share with either dictionary.
MIXED_BYTES = 64
MIXED_SHARE = 0.4
KEEP = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False
    )


def measures(good: bytes, bad: bytes, texts: list[str | None]) -> np.ndarray:
    """Per text: how much larger it gets with the bad dictionary than with the good one, as a
    share of the larger size, and its smaller size as a share of its bytes. Whole texts, in equal
    chunks that start afresh with the dictionary. Both shares are as if ``MIXED_BYTES`` neutral
    bytes stood in front, so a short text says little; an empty or null one says nothing."""
    with_good, with_bad = _compressor(good), _compressor(bad)
    neutral = MIXED_BYTES * MIXED_SHARE
    out = np.tile([0.0, MIXED_SHARE], (len(texts), 1))
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            continue
        first = second = 0
        size = -(-len(data) // -(-len(data) // CHUNK))
        for at in range(0, len(data), size):
            chunk = data[at : at + size]
            first += len(with_good.compress(chunk)) - FRAME
            second += len(with_bad.compress(chunk)) - FRAME
        difference = (second - first) / (max(first, second) + neutral)
        out[i] = difference, (min(first, second) + neutral) / (len(data) + MIXED_BYTES)
    return out


def _inputs(found: np.ndarray) -> np.ndarray:
    """What the calibration weighs: difference and share, their squares and product."""
    difference = np.clip(found[:, 0] * 10, -5, 5)
    share = np.log(np.clip(found[:, 1], 1e-3, 2))
    return np.column_stack(
        [difference, share, difference * share, share * share, np.tanh(difference)]
    )


def _chunks(sample: DataFrame) -> DataFrame:
    """Distinct lines, packed into pieces of about a chunk: a line that both classes have, or that
    several texts have, belongs to none."""
    lines = sample.select("label", F.xxhash64("text").alias("doc"),
                          F.posexplode(F.split("text", "\n")).alias("at", "line"))
    own = (
        lines.groupBy("line")
        .agg(F.count_distinct("doc").alias("docs"), F.min("doc").alias("doc"),
             F.min("label").alias("label"), F.min("at").alias("at"))
        .where("docs = 1")
    )
    pieces = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.floor(F.char_length("line") / CHUNK)),
            lambda i: F.substr(F.col("line"), (i * CHUNK + 1).cast("int"), F.lit(CHUNK)),
        )
    )
    return own.select("label", "doc", "at", pieces.alias("piece")).where("piece <> ''")


def _dictionary(pieces: list[str]) -> bytes:
    samples = [piece.encode("utf-8", "surrogatepass") for piece in pieces]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        # Too little text to train on: the text itself is the dictionary.
        return b"\n".join(samples)[-DICTIONARY_BYTES:] or b"\n" * 8


def fit(
    docs: DataFrame,
    labels: DataFrame,
    eligible: Column,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    docs_per_class: int = DOCS_PER_CLASS,
) -> Model | None:
    """Dictionaries and calibration from at most about ``docs_per_class`` documents of each label.

    One half of them, by a hash and at every size, gives the dictionaries (at most about ``CHUNKS_PER_CLASS`` pieces
    of lines a class reach the driver), the other half the calibration, of which the driver sees
    ``CELLS ** 2`` cells of counts. None if a label has no document.
    """
    # Bounded, and read several times.
    sample = stage(
        labelled_sample(docs, labels, label, eligible, docs_per_class, key, text), "quality-sample"
    )
    pieces: dict[int, list[str]] = {}
    parts = {(r["label"], r["half"]) for r in sample.groupBy("label", "half").count().collect()}
    # Only where a half has no document of a label does every document teach both.
    whole = len(parts) < 4
    teach = sample if whole else sample.where("half = 0")
    for value in (0, 1):
        own = _chunks(teach).where(F.col("label") == value)
        n = own.count()
        chosen = bounded_sample(own, F.col("piece"), n, CHUNKS_PER_CLASS)
        found = chosen.orderBy("doc", "at").limit(2 * CHUNKS_PER_CLASS).collect()
        pieces[value] = [r["piece"] for r in found]
    if not pieces[0] or not pieces[1]:
        return None
    good, bad = _dictionary(pieces[1]), _dictionary(pieces[0])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            found = measures(good, bad, part.column(0).to_pylist())
            places = np.floor((np.clip(found, -0.9999, 0.9999) + 1) / 2 * CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(places[:, 0]), pa.array(places[:, 1]),
                 pa.array(found[:, 0]), pa.array(found[:, 1])],
                names=["label", "x", "y", "difference", "share"],
            )

    check = sample if whole else sample.where("half = 1")
    measured = small_batches(check.select("text", "label")).mapInArrow(
        cells, "label int, x int, y int, difference double, share double"
    )
    table = (
        measured.groupBy("label", "x", "y")
        .agg(F.count("*").alias("n"), F.avg("difference").alias("d"), F.avg("share").alias("s"))
        .toPandas()
    )
    if table["label"].nunique() < 2:
        return None
    positive = (table["label"] == 1).to_numpy().astype(float)
    # The sample may hold a larger share of the rarer label than there is.
    shares = {r["label"]: r["count"] for r in known_labels(labels, label, eligible, key)}
    held = {value: table["n"][table["label"] == value].sum() for value in (0, 1)}
    weigh = table["label"].map({v: shares[v] / held[v] for v in (0, 1)}).to_numpy(float)
    weights = fit_logistic(
        _inputs(table[["d", "s"]].to_numpy()), positive, weigh * table["n"].to_numpy(float)
    )
    return Model(good, bad, weights)


def scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), PRIOR)
    return logistic(_inputs(measures(model.good, model.bad, texts)), model.weights)


def score(
    docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, score`` of every row: 1 is like text labelled good. Null and empty texts get the
    score of no difference; without a model every score is ``PRIOR``. Null keys and repeated rows
    are kept, other columns are not read."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = scores(model, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    return small_batches(rows).mapInArrow(run, f"doc_id {key_type}, score double")


def teaching(key: str = "doc_id") -> Column:
    """Keys whose crc32 does not leave 2 modulo 4."""
    return ~held_out(F.col(key), 4, 2)
