"""Toxicity by a gap-weighted subsequence kernel: a support vector machine on Nystrom landmarks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.llm.common import (
    bounded_sample,
    code_points,
    distinct_words,
    fit_logistic,
    held_out,
    labelled_sample,
    logistic,
    slices,
    small_batches,
)
from stargauge.llm.language import letters_only

# The kernel: three characters in order, within a span, each character of the span at DECAY.
SPAN = 6
DECAY = 0.7
BITS = 18
GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
# A token longer than this is read in overlapping windows.
WINDOW = 24
# Single letters in a row are read as one token.
SPELLED = 3

# Bounds of the fit.
DOCS_PER_CLASS = 4_000
TOXIC_TOKENS = 400
CLEAN_TOKENS = 20_000
CANDIDATES = 20_000
LANDMARKS = 192
LEAST_EVIDENCE = 9.0
RIDGE = 1e-2
BINS = 400
SPREAD = 4.0
NOTHING = -2.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of hashed subsequences
    bias: float
    calibration: np.ndarray


# ---- kernel -------------------------------------------------------------------------------


def windows(token: str) -> list[str]:
    if len(token) <= 2 * WINDOW:
        return [token]
    return [token[i : i + WINDOW] for i in range(0, len(token) - WINDOW // 2, WINDOW // 2)]


def subsequences(tokens: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each way to skip characters: token of every subsequence, its hash and its weight. Ends
    of a token count as a character."""
    joined, starts = code_points([f"\x02{token}\x03" for token in tokens])
    points = joined.astype(np.uint64)
    owner = np.repeat(np.arange(len(tokens)), np.diff(starts))
    ends = np.repeat(starts[1:], np.diff(starts))
    for first, second in GAPS:
        n = len(points) - second
        if n <= 0:
            return
        inside = np.arange(n) + second < ends[:n]
        a, b, c = points[:n][inside], points[first : first + n][inside], points[second:][inside]
        mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (c * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
        yield owner[:n][inside], (mixed >> np.uint64(64 - BITS)).astype(np.int64), DECAY ** (
            second + 1
        )


def lengths(tokens: list[str]) -> np.ndarray:
    """What a token's subsequences are divided by: the root of their summed squares."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 2
    total = np.zeros(len(tokens))
    for _, second in GAPS:
        total += np.maximum(sizes - second, 0) * DECAY ** (2 * (second + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def kernel(tokens: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of tokens with landmarks."""
    parts = list(subsequences(landmarks))
    known = np.unique(np.concatenate([ids for _, ids, _ in parts]))
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)
    for owner, ids, weight in parts:
        np.add.at(table, (np.searchsorted(known, ids), owner), weight)
    table /= lengths(landmarks).astype(np.float32)
    out = np.zeros((len(tokens), len(landmarks)), np.float32)
    for start in range(0, len(tokens), 1000):
        part = tokens[start : start + 1000]
        for owner, ids, weight in subsequences(part):
            place = np.searchsorted(known, ids)
            hit = known[np.minimum(place, len(known) - 1)] == ids
            values = table[place[hit]] * np.float32(weight)
            rows = owner[hit]
            if len(rows):
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                out[start + rows[first]] += np.add.reduceat(values, first, axis=0)
        out[start : start + len(part)] /= lengths(part)[:, None]
    return out


# ---- tokens -------------------------------------------------------------------------------


def _evidence(sample: DataFrame) -> DataFrame:
    """Per token: distinct toxic and clean sentences that hold it. A sentence has the label of its
    texts, clean if they differ, so copies and shared passages count once."""
    sentences = (
        sample.select("label", F.explode(F.split(F.lower("text"), r"[.!?\n]+\s")).alias("sentence"))
        .groupBy("sentence")
        .agg(F.min("label").alias("label"))
    )
    tokens = F.array_distinct(F.split(F.regexp_replace("sentence", r"[^\p{L}\p{M}\s]+", ""), r"\s+"))
    return (
        sentences.select("label", F.explode(tokens).alias("token"))
        .where(F.char_length("token").between(3, 2 * WINDOW))
        .groupBy("token")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    )


def _with_insertions(tokens: list[str]) -> list[str]:
    """Each token with one letter inserted, at a place and of a kind that its own letters decide."""
    out = []
    for token in tokens:
        code = sum(map(ord, token))
        at = 1 + code % max(1, len(token) - 1)
        out.append(token[:at] + "xqzkjvwy"[code % 8] + token[at:])
    return out


# ---- fit ----------------------------------------------------------------------------------


def _machine(features: np.ndarray, sign: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared-hinge support vector machine by Newton's method; the bias last."""
    x = np.column_stack([features, np.ones(len(features))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = RIDGE * weight.sum() / len(x) * np.eye(x.shape[1])
    ridge[-1, -1] *= 1e-3
    for _ in range(30):
        active = sign * (x @ w) < 1
        part = x[active] * weight[active][:, None]
        new = np.linalg.solve(part.T @ x[active] + ridge, part.T @ sign[active])
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


def _train(toxic: list[str], clean: list[str], landmarks: list[str]) -> tuple[np.ndarray, float]:
    """Weights of hashed subsequences, and the bias. The machine is linear in the Nystrom
    features, which are linear in the subsequences of a token, so it folds into one table."""
    between = kernel(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    tokens = toxic + clean
    sign = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    weight = np.where(sign > 0, len(tokens) / 4 / len(toxic), 1.0)
    w = _machine(kernel(tokens, landmarks) @ root, sign, weight)
    per_landmark = (root @ w[:-1]) / lengths(landmarks)
    table = np.zeros(1 << BITS)
    for owner, ids, decay in subsequences(landmarks):
        np.add.at(table, ids, per_landmark[owner] * decay)
    return table.astype(np.float32), float(w[-1])


def token_margins(weights: np.ndarray, bias: float, tokens: list[str]) -> np.ndarray:
    total = np.zeros(len(tokens))
    for owner, ids, decay in subsequences(tokens):
        total += np.bincount(owner, weights[ids] * decay, len(tokens))
    return total / lengths(tokens) + bias


def fit(
    docs: DataFrame,
    labels: DataFrame,
    eligible: Column,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    docs_per_class: int = DOCS_PER_CLASS,
) -> Model | None:
    """Machine and calibration from at most about ``docs_per_class`` documents of each label.

    Sentences carry the label of their texts. Tokens that toxic sentences hold far more often than
    chance are the first positives (at most ``TOXIC_TOKENS``); clean sentences give the negatives
    (about ``CLEAN_TOKENS``). The machine then judges the other tokens of toxic sentences (about
    ``CANDIDATES``): those it finds toxic become positives of a second fit. No more than these
    tokens reach the driver. None if a label has no sentence or no token stands out.
    """
    sample = labelled_sample(docs, labels, label, eligible, docs_per_class, key, text)
    found = _evidence(sample).persist()
    try:
        total = found.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
        if not total["t"] or not total["c"]:
            return None
        share = total["t"] / (total["t"] + total["c"])
        n = F.col("toxic") + F.col("clean")
        # Log-likelihood of the toxic share of a token against the share of all tokens.
        part = (F.col("toxic") + 0.01) / (n + 0.02)
        evidence = n * (
            part * F.log(part / share) + (1 - part) * F.log((1 - part) / (1 - share))
        )
        marked = found.withColumn("evidence", F.when(part > 0.8, evidence).otherwise(0.0))
        best = (
            marked.where(F.col("evidence") > LEAST_EVIDENCE)
            .orderBy(F.desc("evidence"), "token")
            .limit(TOXIC_TOKENS)
            .collect()
        )
        toxic = [r["token"] for r in best]
        if not toxic:
            return None
        clean_rows = found.where("clean > 0")
        rest_rows = found.where("clean = 0 AND toxic > 0")
        clean = [
            r["token"]
            for r in bounded_sample(
                clean_rows, F.col("token"), clean_rows.count(), CLEAN_TOKENS
            ).select("token").orderBy("token").collect()
        ]
        rest = [
            r["token"]
            for r in bounded_sample(rest_rows, F.col("token"), rest_rows.count(), CANDIDATES)
            .select("token").orderBy("token").collect()
        ]
    finally:
        found.unpersist()
    if not clean:
        return None
    every = max(1, len(clean) // LANDMARKS)
    landmarks = sorted(set(toxic[:LANDMARKS] + clean[::every][:LANDMARKS]))
    positives = toxic + _with_insertions(toxic)
    weights, bias = _train(positives, clean, landmarks)
    judged = token_margins(weights, bias, rest) if rest else np.zeros(0)
    witnesses = [token for token, value in zip(rest, judged, strict=True) if value > 0.5]
    if witnesses:
        weights, bias = _train(sorted({*positives, *witnesses}), clean, landmarks)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            first, second = margins(weights, bias, part.column(0))
            place = np.floor((np.column_stack([first, second]) + SPREAD) / (2 * SPREAD) * BINS)
            place = np.clip(place, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(place[:, 0]), pa.array(place[:, 1])],
                names=["label", "x", "y"],
            )

    counted = small_batches(sample.select("text", "label")).mapInArrow(bins, "label int, x int, y int")
    table = counted.groupBy("label", "x", "y").count().toPandas()
    values = (table[["x", "y"]].to_numpy() + 0.5) / BINS * 2 * SPREAD - SPREAD
    positive = (table["label"] == 1).to_numpy().astype(float)
    return Model(weights, bias, fit_logistic(_inputs(values), positive, table["count"].to_numpy(float)))


# ---- scores -------------------------------------------------------------------------------


def margins(weights: np.ndarray, bias: float, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The greatest token margin of each whole text and the next one; ``NOTHING`` for none."""
    words = distinct_words(texts)
    tokens = letters_only(words.entries).to_pylist()
    place = np.arange(len(tokens))
    long = [i for i, token in enumerate(tokens) if len(token) > 2 * WINDOW]
    value = token_margins(weights, bias, [t if len(t) <= 2 * WINDOW else "" for t in tokens])
    for i in long:
        value[i] = token_margins(weights, bias, windows(tokens[i])).max()
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    value[sizes < 3] = NOTHING
    per_word = np.maximum(value[place[words.codes]], NOTHING)
    first, second = _two_best(per_word, words.offsets)
    spelled = sizes[words.codes] == 1
    if spelled.any():
        _spelled_out(weights, bias, words, tokens, spelled, first, second)
    return first, second


def _two_best(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    order = np.lexsort((-values, owner))
    counts = np.diff(offsets)
    ranked = values[order]
    first, second = np.full(texts, NOTHING), np.full(texts, NOTHING)
    first[counts > 0] = ranked[offsets[:-1][counts > 0]]
    second[counts > 1] = ranked[offsets[:-1][counts > 1] + 1]
    return first, second


def _spelled_out(weights, bias, words, tokens, spelled, first, second) -> None:
    """Judge runs of single letters as tokens; changes the two best of their texts."""
    owner = np.repeat(np.arange(len(first)), np.diff(words.offsets))
    at = np.flatnonzero(spelled)
    breaks = (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])
    runs = np.split(at, np.flatnonzero(breaks) + 1)
    for run in runs:
        if len(run) < SPELLED:
            continue
        token = "".join(tokens[words.codes[i]] for i in run)
        value = token_margins(weights, bias, windows(token)).max()
        text = owner[run[0]]
        first[text], second[text] = sorted((value, first[text], second[text]), reverse=True)[:2]


def _inputs(values: np.ndarray) -> np.ndarray:
    bounded = np.clip(values, NOTHING, SPREAD)
    return np.column_stack([bounded, np.maximum(bounded, 0)])


def scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    return logistic(
        _inputs(np.column_stack(margins(model.weights, model.bias, texts))), model.calibration
    )


def score(
    docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, score`` of every row: 1 is like text labelled toxic. Null, empty and letterless
    texts get the lowest score; without a model every score is 0. Null keys and repeated rows are
    kept, other columns are not read."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = scores(model, part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    return small_batches(rows).mapInArrow(run, f"doc_id {key_type}, score double")


def civil(docs: DataFrame, model: Model | None, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below the limit."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, place):
            yield part.filter(pa.array(scores(model, part.column(place)) < limit))

    return small_batches(docs).mapInArrow(run, docs.schema)


def teaching(key: str = "doc_id") -> Column:
    """Keys whose crc32 does not leave 0 modulo 5."""
    return ~held_out(F.col(key), 5, 0)
