from __future__ import annotations

import random
import re

import pytest
from helpers import documents, no_documents
from stargauge.llm import common
from stargauge.llm import decontaminate as d

PASSAGE = " ".join(f"item{i}" for i in range(40))
SHORT = "only a few words"


def replaced(text, every):
    words = text.split()
    for i in range(every - 1, len(words), every):
        words[i] = "other"
    return " ".join(words)


BENCHMARK = ((1, PASSAGE), (2, SHORT), (3, None), (None, "un " * 12), (1, PASSAGE))


def benchmark(spark, rows=BENCHMARK):
    df = spark.createDataFrame(list(rows), "item_id bigint, text string")
    return df.selectExpr("*", "1 AS tokens", "2 AS doc_id", "3 AS seed")


ROWS = [
    (1, f"Before it. {PASSAGE.upper()}, after it"),
    (2, replaced(PASSAGE, 6)),
    (3, f"x {' '.join(PASSAGE.split()[10:30])} y"),
    (4, replaced(PASSAGE, 2)),
    (5, "nothing of the kind " * 30),
    (6, SHORT),
    (7, None),
    (None, PASSAGE),
    (8, ("word " * 20000) + PASSAGE),
    (8, ("word " * 20000) + PASSAGE),
    (9, " ".join(PASSAGE.split()[::-1])),
]


def brute_force(rows, items):
    """Pairs with a seed hit whose surroundings agree, by comparing every window."""
    def tokens(text):
        return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]

    masks = [[i for i in range(d.SPAN) if mask[i] == "1"] for mask in d.MASKS]
    out = set()
    for key, text in rows:
        doc = tokens(text)
        for item_key, item_text in items:
            item = tokens(item_text)
            if 0 < len(item) < d.SPAN:
                if any(doc[q : q + len(item)] == item for q in range(len(doc))):
                    out.add((key, item_key))
            for p in range(len(item) - d.SPAN + 1):
                size = min(len(item), d.AROUND)
                start = max(0, min(p - (d.AROUND - d.SPAN) // 2, len(item) - size))
                for q in range(len(doc) - d.SPAN + 1):
                    if not any(all(doc[q + i] == item[p + i] for i in mask) for mask in masks):
                        continue
                    equal = sum(
                        0 <= q - p + i < len(doc) and doc[q - p + i] == item[i]
                        for i in range(start, start + size)
                    )
                    if equal >= size * d.LEAST_EQUAL:
                        out.add((key, item_key))
    return out


def test_planted_passages(spark):
    found = d.contaminated(documents(spark, ROWS), benchmark(spark))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (6, 2), (None, 1), (8, 1)}
    assert got == brute_force([row for row in ROWS if row[0] != 8], BENCHMARK) | {(8, 1)}
    assert found.count() == len(got)


def test_equals_brute_force_on_little_text(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdef") for _ in range(25))) for i in range(6)]
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(60))) for i in range(40)]
    rows += [(100 + i, replaced(text, 5)) for i, text in items]
    found = d.contaminated(documents(spark, rows), benchmark(spark, items))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute_force(rows, items)


@pytest.fixture(params=["as it is", "no broadcasts", "full filter"])
def form(request, spark, monkeypatch):
    """Join sides of any size, and a filter that rules nothing out."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    if request.param == "no broadcasts":
        spark.conf.set(setting, "-1")
    if request.param == "full filter":
        for call in (common.wanted_bits, common.may_hold):
            monkeypatch.setattr(call, "__defaults__", (64,))
    yield request.param
    spark.conf.set(setting, before)


def test_same_rows_in_every_form(spark, form):
    found = d.contaminated(documents(spark, ROWS), benchmark(spark))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (6, 2), (None, 1), (8, 1)}


def test_a_hit_is_verified_on_its_own_text(spark, form):
    """Texts that share a key, known or not, do not lend each other their words."""
    words = PASSAGE.split()
    one = " ".join(words[:9] + ["no"] * 31)
    two = " ".join(["no"] * 9 + words[9:16] + ["no"] * 24)
    rows = [(7, one), (7, two), (None, one), (None, two)]
    assert d.contaminated(documents(spark, rows), benchmark(spark)).collect() == []


def test_short_items_are_found_whole(spark):
    items = [(1, "Forty-two!"), (2, "a b c d e f g h"), (3, "one"), (4, "")]
    rows = [(1, "it is forty two, they say"), (2, "forty"), (3, "x a b c d e f g h"), (4, "a b c d e f g x h"),
            (5, "two forty"), (None, "ONE"), (6, None), (7, "one")]
    found = d.contaminated(documents(spark, rows), benchmark(spark, items)).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got == brute_force(rows, items) == {(1, 1), (3, 2), (None, 3), (7, 3)}
    assert all(r["equal"] == r["compared"] for r in found)


def test_a_third_null_keys(spark):
    rows = [(None, PASSAGE if i % 5 == 0 else f"text {i} " * 20) for i in range(100)]
    rows += [(i, f"other text {i} " * 20) for i in range(200)]
    docs = documents(spark, rows)
    assert [tuple(r)[:2] for r in d.contaminated(docs, benchmark(spark)).collect()] == [(None, 1)]
    assert d.clean(docs, benchmark(spark)).count() == 280


def test_clean_keeps_the_rest_with_all_columns(spark):
    docs = documents(spark, ROWS)
    kept = d.clean(docs, benchmark(spark))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 7, 9]


def test_empty_tables_and_no_python(spark):
    assert d.contaminated(no_documents(spark), benchmark(spark)).count() == 0
    assert d.contaminated(documents(spark, ROWS), benchmark(spark, [])).count() == 0
    plan = d.contaminated(documents(spark, ROWS), benchmark(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_clean_keeps_clean_rows_that_share_a_key_with_a_leak(spark, form):
    rows = [(None, PASSAGE), (None, "clean"), (None, "clean"), (None, None), (1, PASSAGE),
            (1, "a clean text of the same key"), (2, PASSAGE), (2, PASSAGE), (3, None)]
    expected = sorted((row for row in rows if row[1] != PASSAGE), key=str)
    out = d.clean(documents(spark, rows), benchmark(spark)).select("doc_id", "text")
    assert sorted(map(tuple, out.collect()), key=str) == expected
