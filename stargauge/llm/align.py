"""Alignment of the tokens of two tokenizers, in Arrow tables.

Tokens of a text are aligned by where they end. Both lists of ends meet in a hash join on document
and end; where both tokenizers end, a group of tokens is complete, and between two neighbouring
ends exactly one token of each covers the text, so those rows are the links.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.llm.common import slices, small_batches
from stargauge.sources.staging import stage

# Fixed value: how byte-level vocabularies of this family cut a text into words.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
BLANK = "▁"
# An id pair is one number: the first id above the second.
SHIFT = 32


@dataclass(frozen=True)
class Vocabularies:
    """Two tokenizers as data that travels with a task: the bytes of every token of the first, and
    the model file of the second."""

    first: list[bytes]
    second: bytes


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow each other from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load(first_path: str, second_path: str) -> Vocabularies:
    """The vocabulary of a byte-level pair file whose ids follow its merges, and a byte-pair model
    file with identity normalisation. Other kinds are refused."""
    with open(first_path, encoding="utf-8") as file:
        described = json.load(file)
    model, cutter = described["model"], described["pre_tokenizer"]
    plain = cutter["type"] == "ByteLevel" and cutter.get("use_regex") and not cutter["add_prefix_space"]
    if model["type"] != "BPE" or described["normalizer"] or not plain:
        raise ValueError("the first tokenizer is not a plain byte-level pair vocabulary")
    letters = _byte_letters()
    vocabulary = model["vocab"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [vocabulary[token] for token in made] != list(range(256, 256 + len(made))):
        raise ValueError("the ids of the first tokenizer do not follow its merges")
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        tokens[i] = bytes(letters[letter] for letter in token)
    with open(second_path, "rb") as file:
        second = file.read()
    return Vocabularies(tokens, second)


class Encoders:
    """Both tokenizers of one task, with the bytes of all their tokens as Arrow columns."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        ranks = {token: i for i, token in enumerate(vocabularies.first) if token}
        self._first = tiktoken.Encoding(
            "first", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self._second = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.second)
        self.first_bytes = pa.array(vocabularies.first, pa.large_binary())
        self.second_bytes = pa.array(
            [self._piece_bytes(i) for i in range(self._second.get_piece_size())], pa.large_binary()
        )

    def _piece_bytes(self, i: int) -> bytes:
        piece = self._second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._second.is_byte(i) else piece.replace(BLANK, " ").encode()

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of blank and text by the first, and of the text by the second, which adds the blank."""
        one = [self._first.encode_ordinary(" " + text) for text in texts]
        two = self._second.encode(texts, num_threads=1)
        kind = pa.list_(pa.int32())
        return pa.array(one, kind), pa.array(two, kind)


# ---- one slice ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Tokens:
    """Tokens of a slice: their text, where they end in it, in bytes, and their ids."""

    document: pa.Array
    end: pa.Array
    id: pa.Array
    per_document: np.ndarray


def _segment_ends(lengths: pa.Array, parents: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Running sums of lengths that start anew in every document."""
    running = pc.cumulative_sum(lengths)
    padded = np.concatenate([[0], running.to_numpy()])
    before = pa.array(padded[np.cumsum(sizes) - sizes])
    return pc.subtract(running, before.take(parents))


def _whole(ids: pa.Array, sizes: np.ndarray, known: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether the bytes of the tokens of a text, joined, are the text."""
    made = known.take(ids)
    lengths = pc.binary_length(made).to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(np.r_[0, sizes])]
    joined = made.buffers()[2].to_pybytes() if len(made) else b""
    same = (joined[a:b] == text for a, b, text in zip(ends, ends[1:], texts))
    return np.fromiter(same, bool, len(texts))


def _tokens(lists: pa.ListArray, valid: np.ndarray, known: pa.Array) -> Tokens:
    """The flat tokens of the valid texts."""
    parents, ids = pc.list_parent_indices(lists), lists.flatten()
    kept = pa.array(valid).take(parents)
    parents, ids = parents.filter(kept), ids.filter(kept)
    sizes = np.where(valid, lists.value_lengths().to_numpy(zero_copy_only=False), 0).astype(np.int64)
    lengths = pc.binary_length(known).cast(pa.int64()).take(ids)
    return Tokens(parents.cast(pa.int64()), _segment_ends(lengths, parents, sizes), ids, sizes)


def _ends(tokens: Tokens, name: str) -> pa.Table:
    ends = pa.table({"document": tokens.document, "end": tokens.end})
    return ends.append_column(name, pa.array(np.ones(len(tokens.id), bool)))


def _covering(ended: pa.Array) -> np.ndarray:
    """The token that covers the text up to each end: as many tokens ended before."""
    return pc.subtract(pc.cumulative_sum(ended), ended).to_numpy()


def _joined_groups(tokens: Tokens, groups: np.ndarray, n_groups: int) -> pa.Array:
    """The ids of each group, comma-joined. ``groups`` rises along the tokens."""
    offsets = pa.array(np.searchsorted(groups, np.arange(n_groups + 1)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens.id.cast(pa.string())), ",")


def align(texts: pa.Array, encoders: Encoders) -> pa.Table:
    """One row per text: numbers of tokens, groups and links, digest of the groups, and its
    different linked id pairs with the number of links of each."""
    given = texts.fill_null("").to_pylist()
    lists = encoders.encode(given)
    wanted = [b" " + text.encode() for text in given]
    valid = np.fromiter(map(bool, given), bool, len(given))
    known = (encoders.first_bytes, encoders.second_bytes)
    for ids, of in zip(lists, known):
        sizes = ids.value_lengths().to_numpy().astype(np.int64)
        valid &= _whole(ids.flatten(), sizes, of, wanted)
    one, two = (_tokens(ids, valid, of) for ids, of in zip(lists, known))

    ends = _ends(one, "one").join(
        _ends(two, "two"), ["document", "end"], join_type="full outer", use_threads=False
    )
    # Texts follow each other: one number orders documents and ends.
    starts = np.cumsum([0, *map(len, wanted)])[:-1]
    place = pc.add(ends["end"], pa.array(starts).take(ends["document"]))
    ends = ends.take(pc.sort_indices(place)).combine_chunks()
    document = ends["document"].combine_chunks()
    first, second = (
        ends[name].combine_chunks().fill_null(False).cast(pa.int64()) for name in ("one", "two")
    )
    both = pc.multiply(first, second)
    pair = pc.add(
        pc.multiply(one.id.take(pa.array(_covering(first))).cast(pa.int64()), 1 << SHIFT),
        two.id.take(pa.array(_covering(second))).cast(pa.int64()),
    )

    group = _covering(both)
    n_all = int(pc.sum(both).as_py() or 0)
    parts = [
        _joined_groups(tokens, group[ended.to_numpy().astype(bool)], n_all)
        for tokens, ended in ((one, first), (two, second))
    ]
    written = pc.binary_join_element_wise(*parts, "|")
    n_groups = np.bincount(document.filter(both.cast(pa.bool_())).to_numpy(), minlength=len(given))
    bounds = pa.array(np.r_[0, np.cumsum(n_groups)].astype(np.int32))
    told = pc.binary_join(pa.ListArray.from_arrays(bounds, written), ";").to_pylist()
    digests = [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in told]

    links = pa.table({"document": document, "pair": pair})
    counted = links.group_by(["document", "pair"], use_threads=False).aggregate([([], "count_all")])
    counted = counted.sort_by("document")
    per_text = np.bincount(counted["document"].to_numpy(), minlength=len(given))
    offsets = pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32))
    return pa.table(
        {
            "n_a": pa.array(one.per_document),
            "n_b": pa.array(two.per_document),
            "n_groups": pa.array(n_groups),
            "n_links": pa.array(np.bincount(document.to_numpy(), minlength=len(given))),
            "groups_sha256": pa.array(digests),
            "pairs": pa.ListArray.from_arrays(offsets, counted["pair"].combine_chunks()),
            "times": pa.ListArray.from_arrays(
                offsets, counted["count_all"].combine_chunks().cast(pa.int32())
            ),
        }
    )


# ---- all documents ------------------------------------------------------------------------

_FOUND = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def _with_dictionary(part: int, keys: pa.Array, aligned: pa.Table) -> pa.RecordBatch:
    """The rows of a batch, whose pairs are places in a list of the different pairs of the batch.
    The first row carries that list, and how many rows of the batch hold each pair."""
    pairs = aligned["pairs"].combine_chunks()
    flat = pa.table({"pair": pairs.flatten()})
    held = flat.group_by("pair", use_threads=False).aggregate([([], "count_all")])
    codes = pc.index_in(pairs.flatten(), held["pair"].combine_chunks())
    rows = aligned.num_rows
    only_first = pa.array(np.r_[0, np.full(rows, held.num_rows)].astype(np.int32))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, part, np.int64)),
            keys,
            *(aligned[name].combine_chunks() for name in names),
            pa.ListArray.from_arrays(pairs.offsets, codes),
            aligned["times"].combine_chunks(),
            pa.ListArray.from_arrays(only_first, held["pair"].combine_chunks()),
            pa.ListArray.from_arrays(
                only_first, held["count_all"].combine_chunks().cast(pa.int32())
            ),
        ],
        names=["part", "id", *names, "codes", "times", "pairs", "held"],
    )


def _aligned(rows: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    # Plain values: a broadcast is not pickled by value.
    shared = rows.sparkSession.sparkContext.broadcast((vocabularies.first, vocabularies.second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(Vocabularies(*shared.value))
        part = TaskContext.get().partitionId() << 33
        for batch in batches:
            found, keys = [], []
            for some in slices(iter([batch]), 1):
                found.append(align(some.column(1), encoders))
                keys.append(some.column(0))
            if found:
                yield _with_dictionary(part, pa.concat_arrays(keys), pa.concat_tables(found))
                part += 1

    key_type = rows.schema["id"].dataType.simpleString()
    return small_batches(rows).mapInArrow(
        run,
        f"part bigint, id {key_type}, {_FOUND}, codes array<int>, times array<int>, "
        "pairs array<bigint>, held array<int>",
    )


def _judged(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """Adds up over the links of each row what its pairs count in the corpus."""
    codes, times = (rows.column(name).combine_chunks() for name in ("codes", "times"))
    n = rows.num_rows
    count = np.zeros(pairs.num_rows, np.int64)
    best = np.zeros(pairs.num_rows, bool)
    code = pairs.column("code").to_numpy()
    count[code] = pairs.column("documents").to_numpy()
    best[code] = pairs.column("best").to_numpy(zero_copy_only=False)
    places, links = codes.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    owners = pc.list_parent_indices(codes).to_numpy().astype(np.int64)

    def per_row(values: np.ndarray) -> pa.Array:
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        cuts = np.searchsorted(owners, np.arange(n + 1))
        return pa.array(total[cuts[1:]] - total[cuts[:-1]])

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kept = rows.select(names).rename_columns(["doc_id", *names[1:]])
    return kept.append_column("n_best", per_row(np.where(best[places], links, 0))).append_column(
        "count_sum", per_row(count[places] * links)
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, documents, best``: how many documents hold each id pair linked, and whether no
    other pair of its first id is held by more."""
    counts = stage(
        aligned.where("size(pairs) > 0")
        .select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.held").alias("documents")),
        "align-counts",
    )
    first = F.shiftright("pair", SHIFT)
    most = counts.groupBy(first.alias("first")).agg(F.max("documents").alias("most"))
    both = counts.withColumn("first", first).join(most, "first")
    return both.select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def align_documents(
    docs: DataFrame,
    vocabularies: Vocabularies,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, numbers of tokens, groups and links, ``groups_sha256``, ``n_best`` and
    ``count_sum`` of every row.

    A batch of rows (a few megabytes, or one longer text whole) is aligned in Arrow tables. Its
    linked id pairs are counted there, once per row that holds them, and Spark adds up the counts of
    all batches. A batch then gets back the counts of its own pairs only: per pair and batch one row
    is shuffled, never one per link, and a pair that every text holds is split at run time. The
    batches and the counts are written, so a lost executor costs a read.

    Null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have
    no tokens: zeros and an empty digest. Null keys are kept, rows that repeat a key or a text
    are documents of their own. No rows give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    aligned = stage(_aligned(rows, vocabularies), "aligned")
    pairs = aligned.where("size(pairs) > 0").select(
        F.col("part").alias("of"), F.posexplode("pairs").alias("code", "pair")
    )
    counted = pairs.join(stage(pair_counts(aligned), "align-pairs"), "pair")
    left = aligned.drop("pairs", "held")
    key_type = rows.schema["id"].dataType.simpleString()
    return (
        left.groupBy("part")
        .cogroup(counted.select("of", "code", "documents", "best").groupBy("of"))
        .applyInArrow(_judged, f"doc_id {key_type}, {_FOUND}, n_best bigint, count_sum bigint")
    )
