"""Alignment of two tokenizers against plain loops over the libraries' own tokens."""

from __future__ import annotations

import collections
import hashlib
import json
import os

import pyarrow as pa
import pytest
import sentencepiece
from helpers import LONG, documents, no_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stargauge.llm import align
from stargauge.llm.queries import BYTE_FILE, tokenizer_path

COUNTS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
TEXTS = [
    "Plain words, and a few more: it's 12,345.67 of them!",
    "Plain words, and a few more: it's 12,345.67 of them!",
    "", None, " ", "  two  blanks\n\n\tand tabs ", "<|endoftext|> </s> <s>[INST]", "日本語 ümlaut é 🙂🙂",
    "▁ a piece's own blank", "x" * 3000, "null \x00 byte", "ﬁ ligature ① K", LONG[:5000],
]


@pytest.fixture(scope="module")
def vocabularies():
    return align.load(tokenizer_path(BYTE_FILE), tokenizer_path())


class Plain:
    """The contract by loops, with the tokens of the public libraries."""

    def __init__(self):
        path = tokenizer_path(BYTE_FILE)
        self.one = Tokenizer.from_file(path)
        self.one.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.two = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())

    def piece(self, i):
        text = self.two.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if self.two.is_byte(i) else text.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a = self.one.encode(" " + text, add_special_tokens=False).ids
        b = self.two.encode(text)
        one = [(i, self.bytes.get(i, b"<|endoftext|>")) for i in a]
        two = [(i, self.piece(i)) for i in b]
        whole = (" " + text).encode()
        same = b"".join(t for _, t in one) == whole == b"".join(t for _, t in two)
        return (one, two) if same else ([], [])

    @staticmethod
    def ranges(tokens):
        at, out = 0, []
        for i, text in tokens:
            out.append((i, at, at + len(text)))
            at += len(text)
        return out

    def row(self, text):
        one, two = map(self.ranges, self.tokens(text))
        ends = sorted({e for _, _, e in one} & {e for _, _, e in two})
        links, groups, start = [], [], 0
        first = 0
        for a, low, high in one:
            while first < len(two) and two[first][2] <= low:
                first += 1
            j = first
            while j < len(two) and two[j][1] < high:
                links.append((a, two[j][0]))
                j += 1
        for end in ends:
            parts = [
                ",".join(str(i) for i, low, high in side if start <= low and high <= end)
                for side in (one, two)
            ]
            groups.append("|".join(parts))
            start = end
        told = ";".join(groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if told else ""
        return (len(one), len(two), len(groups), len(links), digest), links

    def table(self, texts):
        rows = [self.row(text) for text in texts]
        counts = collections.Counter(pair for _, links in rows for pair in set(links))
        most = collections.Counter()
        for (a, _), n in counts.items():
            most[a] = max(most[a], n)
        return [
            (*head, sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links))
            for head, links in rows
        ]


def test_every_awkward_text(spark, vocabularies):
    df = documents(spark, list(enumerate(TEXTS)))
    found = align.align_documents(df, vocabularies).orderBy("doc_id").collect()
    assert [tuple(row[name] for name in COUNTS) for row in found] == Plain().table(TEXTS)


def test_given_texts(spark, vocabularies):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    found = align.align_documents(
        spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id bigint, text string").repartition(7),
        vocabularies,
    )
    got = {row["doc_id"]: tuple(row[name] for name in COUNTS) for row in found.collect()}
    expected = Plain().table([row["text"] for row in docs])
    assert got == {row["doc_id"]: want for row, want in zip(docs, expected, strict=True)}


def test_rows_that_repeat_a_key_and_hot_null_keys(spark, vocabularies):
    rows = [(None, "the same words")] * 40 + [(7, "the same words"), (7, "other words"), (8, None)]
    found = align.align_documents(documents(spark, rows), vocabularies).collect()
    assert len(found) == 43
    expected = collections.Counter(Plain().table([text for _, text in rows]))
    assert collections.Counter(tuple(row[name] for name in COUNTS) for row in found) == expected


def test_no_rows(spark, vocabularies):
    assert align.align_documents(no_documents(spark), vocabularies).collect() == []


def test_one_row_per_pair_and_batch_is_shuffled(spark, vocabularies):
    """Pairs meet their counts once per batch, not once per link."""
    rows = documents(spark, [(i, "all of these words stand once") for i in range(50)]).coalesce(1)
    aligned = align._aligned(rows.selectExpr("doc_id AS id", "text"), vocabularies)
    links, pairs = aligned.agg(F.sum("n_links"), F.sum(F.size("pairs"))).first()
    assert links == 50 * pairs


def test_other_vocabularies_are_refused(tmp_path):
    with open(tokenizer_path(BYTE_FILE), encoding="utf-8") as file:
        described = json.load(file)
    described["model"]["merges"] = described["model"]["merges"][::-1]
    path = os.path.join(tmp_path, "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(described, file)
    with pytest.raises(ValueError, match="merges"):
        align.load(path, tokenizer_path())


def test_ids_equal_the_library(vocabularies):
    encoders, plain = align.Encoders(vocabularies), Plain()
    texts = [text for text in TEXTS if text] + ["a" * 5000 + "b" * 5000, "don't we'll I'd  x"]
    one, _ = encoders.encode(texts)
    assert one.to_pylist() == [plain.one.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert isinstance(one, pa.ListArray)
