"""Language identification: expectation-maximisation over a mixture of n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.llm.common import (
    Words,
    code_points,
    distinct_words,
    held_out,
    segment_sums,
    slices,
    small_batches,
)

UNDETERMINED = "und"
GRAM_BITS = 16
SMOOTHING = 0.1
TRAINING_DOCS = 20_000
ROUNDS = 12
REFIT_ROUNDS = 6
# Cost of one more language, in units of the logarithm of the number of words.
PENALTY = 2.0
# Proportions below this are not tried as languages of their own.
LEAST = 0.01

COUNTS = "lang string, gram int, n bigint"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_probability: np.ndarray  # grams x languages


def letters_only(entries: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(entries, pattern=r"[^\p{L}\p{M}]+", replacement="")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of words set between blanks: one for each letter, so an empty
    word has none. Returns them and where those of each word start."""
    joined, starts = code_points([f" {word}" for word in words] + [" "])
    points = joined.astype(np.uint64)
    before, here, after = points[:-2], points[1:-1], points[2:]
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (here * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (after * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
    ids = (mixed >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
    kept = here != 32
    # Letters before position p of the joined string.
    seen = np.concatenate([[0, 0], np.cumsum(kept)]) if len(kept) else np.zeros(2, np.int64)
    return ids[kept], seen[np.minimum(starts[:-2], len(seen) - 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for part in slices(batches, 1):
        words = distinct_words(part.column(1))
        ids, starts = grams(letters_only(words.entries).to_pylist())
        langs = part.column(0).to_pylist()
        for lang in set(langs):
            rows = [i for i, name in enumerate(langs) if name == lang]
            codes = np.concatenate(
                [words.codes[words.offsets[i] : words.offsets[i + 1]] for i in rows]
            )
            weight = np.bincount(codes, minlength=len(words.entries)).astype(np.float64)
            per_gram = np.repeat(weight, np.diff(np.append(starts, len(ids))))
            found = np.bincount(ids, per_gram, 1 << GRAM_BITS)
            totals[lang] = totals.get(lang, 0) + found
    for lang, found in totals.items():
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen)), pa.array(seen, pa.int32()),
             pa.array(found[seen].astype(np.int64))],
            names=["lang", "gram", "n"],
        )


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_docs: int = TRAINING_DOCS,
) -> Model:
    """Trigram models of every non-null ``lang`` value.

    Of each language, at most about ``max_docs`` documents are read, chosen by a hash of the key;
    their counts are summed in Spark. What reaches the driver is one row per language and one of
    the ``2 ** GRAM_BITS`` gram hashes. Null texts teach nothing; no labelled rows give a model
    without languages.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not rows:
        return Model([], np.zeros((1 << GRAM_BITS, 0)))
    # One scan for all languages: a row is read by the share of its own.
    share = F.lit(1 << 31)
    for name, n in sorted(rows.items()):
        if n > max_docs:
            share = F.when(F.col("lang") == name, int(max_docs / n * (1 << 31))).otherwise(share)
    chance = F.pmod(F.xxhash64(F.lit(0), F.col("key")), F.lit(1 << 31))
    sample = labelled.where(chance < share)
    counted = small_batches(sample.select("lang", "text")).mapInArrow(_count, COUNTS)
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows)
    counts = np.full((1 << GRAM_BITS, len(languages)), SMOOTHING)
    place = {name: i for i, name in enumerate(languages)}
    counts[found["gram"].to_numpy(), found["lang"].map(place).to_numpy()] += found["n"].to_numpy()
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _mixture(
    likelihood: np.ndarray, offsets: np.ndarray, start: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document after ``rounds``, and the log-likelihood under them."""
    counts = np.diff(offsets)
    share = start
    for _ in range(rounds):
        joint = likelihood * np.repeat(share, counts, axis=0)
        joint /= joint.sum(axis=1, keepdims=True) + 1e-300
        share = segment_sums(joint, offsets) / np.maximum(counts, 1)[:, None]
    joint = (likelihood * np.repeat(share, counts, axis=0)).sum(axis=1)
    return share, segment_sums(np.log(joint + 1e-300), offsets)


def proportions(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages selected for each text, and its number of words with letters.

    A word's likelihood is the product over its trigrams; combining marks alone make no word. All
    languages are mixed first; then the first one, two, ... by proportion are fitted alone, and the
    set with the best log-likelihood, less ``PENALTY * log(words + 1)`` for each further language,
    stays. Likelihoods are taken relative to the best language of each word, so no set has a
    log-likelihood above 0: a text is done when the cost of its next language is more than that
    leaves to be gained.
    """
    ids, starts = grams(letters_only(words.entries).to_pylist())
    ends = np.append(starts[1:], len(ids))
    per_word = segment_sums(model.log_probability[ids], np.append(starts, len(ids)))
    lettered = pc.match_substring_regex(words.entries, r"\p{L}").to_numpy(zero_copy_only=False)
    with_letters = (ends > starts) & lettered.astype(bool)
    texts = len(words.offsets) - 1
    document = np.repeat(np.arange(texts), np.diff(words.offsets))
    used = with_letters[words.codes]
    codes, document = words.codes[used], document[used]
    counts = np.bincount(document, minlength=texts)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    best = per_word.max(axis=1, keepdims=True)
    likelihood = np.exp(np.maximum(per_word - best, -60.0))[codes]
    languages = len(model.languages)
    even = np.full((texts, languages), 1.0 / max(1, languages))
    share, _ = _mixture(likelihood, offsets, even, ROUNDS)

    mixed = np.flatnonzero(np.sort(share, axis=1)[:, -2:-1].max(axis=1, initial=0) > LEAST)
    chosen = np.zeros_like(share)
    chosen[np.arange(texts), share.argmax(axis=1)] = 1.0
    order = np.argsort(-share, axis=1, kind="stable")
    value = np.full(texts, -np.inf)
    for size in range(1, languages + 1):
        cost = PENALTY * (size - 1) * np.log1p(counts)
        mixed = mixed[-cost[mixed] > value[mixed]]
        if not len(mixed):
            break
        rows = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in mixed])
        part_offsets = np.concatenate([[0], np.cumsum(counts[mixed])])
        start = np.zeros((len(mixed), languages))
        np.put_along_axis(start, order[mixed, :size], 1.0 / size, axis=1)
        fitted, fit_value = _mixture(likelihood[rows], part_offsets, start, REFIT_ROUNDS)
        fit_value = fit_value - cost[mixed]
        better = fit_value > value[mixed]
        value[mixed[better]] = fit_value[better]
        chosen[mixed[better]] = fitted[better]
    chosen[counts == 0] = 0.0
    return chosen, counts


def predict_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language with the largest proportion and that proportion; ``und`` and 0 without
    letters or without a learned language."""
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    share, counts = proportions(model, distinct_words(texts))
    top = share.argmax(axis=1)
    names = [
        model.languages[i] if n else UNDETERMINED for i, n in zip(top, counts, strict=True)
    ]
    return names, np.where(counts > 0, share.max(axis=1), 0.0)


def predict(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, repeated ones included. Null keys stay null, a
    null text or one without letters is ``und`` with score 0; other columns are not read."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            names, scores = predict_texts(model, part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return small_batches(rows).mapInArrow(run, f"doc_id {key_type}, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.35) -> DataFrame:
    """The rows, with all their columns, whose text has a language of at least ``least`` of it."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, place):
            names, scores = predict_texts(model, part.column(place))
            kept = (np.array(names) != UNDETERMINED) & (scores >= least)
            yield part.filter(pa.array(kept))

    return small_batches(docs).mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that may teach: those whose crc32 of the key leaves no 0 modulo 5."""
    return docs.where(~held_out(F.col(key), 5, 0))
