"""Vector columns as Arrow arrays, and fitted weights as models.

Fits that read the rows in Arrow batches see every vector as the places and values of its entries,
so a wide sparse vector is never widened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.sources.staging import stage

# Bytes of a cell of packed rows, so that a batch of cells stays small, and rows worked on at a time.
_CELL = 4096
_ROWS = 10_000


def entries(vector: str) -> list[Column]:
    """``size``, ``indices`` and ``values`` of a vector; a dense one has no indices."""
    parts = F.unwrap_udt(vector)
    values = parts["values"]
    size = F.coalesce(parts["size"], F.size(values)).alias("size")
    return [size, parts["indices"].alias("indices"), values.alias("values")]


@dataclass(frozen=True)
class Rows:
    """Sparse rows: entries ``offsets[i]`` to ``offsets[i + 1]`` are those of row i."""

    offsets: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table) -> Rows:
        """From columns ``indices`` and ``values``, of vectors of either form, as lists or as bytes
        (``as_bytes``)."""
        values, indices = (_whole(batch.column(name)) for name in ("values", "indices"))
        if not pa.types.is_nested(values.type):
            sizes, numbers = _numbers(values, np.float64)
            listed = _numbers(indices, np.int32)[1]
        else:
            sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = values.flatten().to_numpy(zero_copy_only=False)
            listed = indices.flatten().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
        sparse = indices.is_valid().to_numpy(zero_copy_only=False)
        places[np.repeat(sparse, sizes)] = listed
        return Rows(offsets, places, numbers)

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def dense(self, width: int) -> np.ndarray:
        out = np.zeros((len(self.offsets) - 1, width))
        out[self.owners, self.indices] = self.values
        return out

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """The product of every row with the weights."""
        products = np.zeros(len(self.values) + 1)
        np.cumsum(self.values * weights[self.indices], out=products[1:])
        return products[self.offsets[1:]] - products[self.offsets[:-1]]

    def transposed_dot(self, numbers: np.ndarray, width: int) -> np.ndarray:
        """The rows summed with one number each."""
        spread = np.repeat(numbers, np.diff(self.offsets))
        return np.bincount(self.indices, self.values * spread, width)


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each of some byte strings holds, none if it is null, and all of them."""
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(len(column), np.int64), np.zeros(0, kind)
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(ends, wide)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    held = np.frombuffer(data, kind, int(offsets[-1] - offsets[0]) // width, int(offsets[0]))
    return np.diff(offsets).astype(np.int64) // width, held


def as_bytes(df: DataFrame) -> DataFrame:
    """``df`` with ``indices`` and ``values`` as byte strings, which travel to Python and back many
    times as fast as lists do."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, kind in (("indices", np.int32), ("values", np.float64)):
                column = batch.column(name)
                held = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.r_[0, np.cumsum(sizes)].astype(np.int32) * held.itemsize
                known = pa.array(column.is_valid()).buffers()[1]
                parts = [known, pa.py_buffer(ends), pa.py_buffer(held.tobytes())]
                made = pa.Array.from_buffers(pa.binary(), len(column), parts)
                batch = batch.set_column(batch.schema.get_field_index(name), name, made)
            yield batch

    kinds = dict(df.dtypes) | {"indices": "binary", "values": "binary"}
    return df.mapInArrow(convert, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def width_of(df: DataFrame, vector: str) -> int:
    """The size of the first vector, 0 if there is none."""
    first = df.where(F.col(vector).isNotNull()).select(entries(vector)[0]).first()
    return first["size"] if first else 0


def packed(dataset: DataFrame, width: int, vector: str, label: str, name: str) -> DataFrame:
    """Rows as cells of some dozen feature vectors and their labels. They are read many times, and
    a vector of its own would cost more on the way to Python than the work on it."""
    together = max(1, _CELL // (8 * width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = Rows.of(batch).dense(width)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            cells = range(0, len(y), together)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([column[i : i + together].tobytes() for i in cells], pa.binary())
                    for column in (x, y)
                ],
                names=["features", "labels"],
            )

    columns = [F.col(label).cast("double").alias("label"), *entries(vector)]
    cells = dataset.select(*columns).mapInArrow(pack, "features binary, labels binary")
    return stage(cells, name)


def unpacked(
    batches: Iterator[pa.RecordBatch], width: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of packed rows, some thousand rows at a time."""
    for batch in batches:
        x, y = (
            np.frombuffer(b"".join(batch.column(name).to_pylist()))
            for name in ("features", "labels")
        )
        x = x.reshape(-1, width)
        for i in range(0, len(y), _ROWS):
            yield x[i : i + _ROWS], y[i : i + _ROWS]


def summed(parts: DataFrame, by: list[str] | None = None, fan_in: int = 64) -> DataFrame:
    """Element-wise sums of the arrays ``part``, per ``by``, in two steps: no task adds up the
    arrays of all tasks. Sums depend on the order in the last digits only."""
    by = by or []
    near = (F.monotonically_increasing_id() / (1 << 33)).cast("bigint") % fan_in
    total = Summarizer.sum(F.col("part"))
    vectors = parts.select(*by, array_to_vector("part").alias("part"), near.alias("near"))
    halfway = vectors.groupBy(*by, "near").agg(total.alias("part"))
    return halfway.groupBy(*by).agg(total.alias("part"))


def linear_model(
    spark, weights: np.ndarray, intercept: float, features: str, label: str
) -> LinearRegressionModel:
    """Weights as an ordinary linear model, which scores, is saved and is loaded as one."""
    uid = f"LinearRegression_{uuid.uuid4().hex[:12]}"
    vector = _py2java(spark.sparkContext, DenseVector(weights))
    made = spark._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
        uid, vector, float(intercept)
    )
    model = LinearRegressionModel(made)
    model._resetUid(uid)
    return model._set(featuresCol=features, labelCol=label)

