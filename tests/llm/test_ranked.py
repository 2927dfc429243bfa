"""Ranked search against plain sums over all documents; its SQL runs in test_llm_queries."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, documents, no_documents

from stargauge.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def by_all_sums(docs, items, k=20):
    held = [(key, collections.Counter(terms(text))) for key, text in docs]
    held = [(key, counts) for key, counts in held if counts]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(term for _, counts in held for term in counts)
    out = []
    for item, text in items:
        asked, scored = collections.Counter(terms(text)), []
        for key, counts in held:
            m = 100 - 25 + (25 * sum(counts.values()) * n) // length
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m))
                for t, times in asked.items() if counts[t]
            )
            if score > 0:
                scored.append((-score, key is not None, key, score))
        scored.sort(key=lambda row: row[:2] + (row[2] or 0,))
        out += [(item, i, key, score) for i, (*_, key, score) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS rank", "'x' AS row")
    rows = ranked.ranked(documents(spark, docs), benchmark, **more).collect()
    return sorted(map(tuple, rows), key=repr)


def corpus(n=400, seed=4):
    noise = random.Random(seed)
    words = [f"w{int(noise.paretovariate(0.7)) % 300}" for _ in range(40000)]
    return [(i, " ".join(noise.choices(words, k=noise.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize(("block", "part"), [(8192, 4096), (40, 3)])
def test_equals_all_sums_in_any_blocks(spark, block, part):
    docs = corpus()
    items = [(i, docs[i * 7][1] + " extra words w1 w1 W1") for i in range(10)]
    got = found(spark, docs, items, block_documents=block, items_per_part=part)
    assert got == by_all_sums(docs, items)


def test_awkward_rows(spark):
    docs = [
        (1, "Ünï日本 a_b-c"), (2, None), (3, ""), (None, "a b c"), (None, "a b c"), (4, LONG), (5, "A B C"),
        (6, "a b c"), (6, "a b c"), (7, "!!! ---"), (8, "x" * 3000), (9, "ünï日本 tab\tnul\x00l c"),
    ]
    items = [
        (1, "a b c c"), (1, "a b c c"), (None, "lorem X ünï日本"), (2, None), (3, "..."), (4, "unseen"),
        (5, "x" * 3000),
    ]
    assert found(spark, docs, items) == by_all_sums(docs, items)


def test_ties_go_to_the_smaller_key(spark):
    docs = [(i, "same words here") for i in range(100, 0, -1)] + [(0, "something else")]
    got = found(spark, docs, [(1, "words")], k=20, block_documents=16)
    assert [row[2] for row in got] == sorted(range(1, 21), key=lambda i: repr((1, i, i)))


def test_a_third_of_all_rows_with_one_null_key(spark):
    docs = corpus(90) + [(None, "w1 w2 w3 unusual")] * 45
    items = [(1, "unusual w2"), (2, "w1 w5")]
    assert found(spark, docs, items, block_documents=10) == by_all_sums(docs, items)


def test_no_documents_and_no_items(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "words")], "item_id bigint, text string")
    assert ranked.ranked(no_documents(spark), some).collect() == []
    assert ranked.ranked(documents(spark), none).collect() == []


def test_the_search_stops_before_the_lists_end():
    """Documents with the passage stand first in all lists; what is left cannot reach them."""
    n = 4000
    lists = [["common", "rare", "word"] if i < 30 else ["common"] for i in range(n)]
    docs = pa.table(
        {
            "id": pa.array(range(n)),
            "n": pa.array([len(terms) if i < 30 else 10 for i, terms in enumerate(lists)]),
            "terms": pa.array(lists),
            "times": pa.array([[1] * len(terms) for terms in lists], pa.list_(pa.int32())),
        }
    )
    block = ranked.Block(docs, n, 10 * n)
    read = []
    docs_read = block.docs

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                read.append(at.stop - at.start)
            return np.asarray(docs_read)[at]

    block.docs = docs_read.view(Watched)
    codes = np.array([block.code[term] for term in ("common", "rare", "word")])
    places, scores = block.best(codes, np.array([1, 5000, 5000]), 20)
    assert sorted(places) == list(range(20)) and (np.diff(scores) <= 0).all()
    assert sum(read) < n / 4
