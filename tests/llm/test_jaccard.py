from __future__ import annotations

import random
import re

import numpy as np
import pytest

from helpers import documents, no_documents
from stargauge.llm import components, jaccard


def grams(text):
    words = [re.sub(r"[\W_]+", "", w) for w in (text or "").lower().split()]
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    """Links and classes per row number."""
    sets = [grams(text) for _, text in rows]
    keys = [key if key is not None else jaccard.NO_KEY for key, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(keys[i])
    return sorted(
        (keys[i], min(groups[root(i)]), links[i]) for i in range(len(rows))
    )


def found(df):
    rows = jaccard.link_documents(df).collect()
    return sorted(
        (r["doc_id"] if r["doc_id"] is not None else jaccard.NO_KEY, r["class_id"], r["n_links"])
        for r in rows
    )


def near_copies(n, seed):
    """Texts of 60 to 200 words, each copied with a few words replaced."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows, key = [], 0
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((key, " ".join(text)))
            key += 1
    return rows


def test_equals_brute_force(spark):
    rows = near_copies(60, 11)
    assert found(documents(spark, rows)) == brute_force(rows)


def test_a_large_group_of_near_copies_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for key in range(160):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(150)] = f"new{key}"
        rows.append((key, " ".join(text)))
    assert found(documents(spark, rows)) == brute_force(rows)


def test_awkward_rows(spark):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert found(df) == brute_force(rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [
        -1, 1, 2, 3, 4, 6, 7, 8,
    ]


def test_no_rows(spark):
    assert found(no_documents(spark)) == []
    assert jaccard.one_of_each(no_documents(spark)).count() == 0


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_bands_reach_the_recall(similarity):
    bands, rows = jaccard.bands_and_rows(similarity, 0.9999, 80)
    assert bands * rows <= 80 and 1 - (1 - similarity**rows) ** bands >= 0.9999


def test_similarity_of_sets_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    allowed = np.triu(np.ones((40, 40), bool), 1)
    got = jaccard.similar(sets, allowed, 0.5)
    for i in range(40):
        for j in range(i + 1, 40):
            a, b = set(sets[i]), set(sets[j])
            assert got[i, j] == (len(a & b) >= 0.5 * len(a | b))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


A, B, C, D = (" ".join(f"{name}{i}" for i in range(60)) for name in "abcd")
SHARED_KEYS = [
    (3, A), (7, A), (7, B),
    (None, C), (None, D), (None, C + " more"), (10, C), (11, C + " other"), (12, D + " more"),
    (20, A + " more"), (21, A + " more"), (21, D + " other"),
]


def test_rows_that_share_a_key_have_the_links_of_their_own_text(spark):
    assert found(documents(spark, SHARED_KEYS)) == brute_force(SHARED_KEYS)
    rng = random.Random(8)
    rows = [(rng.choice([None, None, rng.randrange(40)]), text) for _, text in near_copies(25, 12)]
    assert found(documents(spark, rows)) == brute_force(rows)


def test_one_of_each_group_stays_where_keys_are_shared(spark):
    kept = jaccard.one_of_each(documents(spark, SHARED_KEYS)).collect()
    texts = [r["text"] for r in kept]
    assert sorted(text[0] for text in texts) == ["a", "b", "c", "d"]
    assert {(r["doc_id"], r["text"][0]) for r in kept} == {(3, "a"), (7, "b"), (None, "c"), (None, "d")}


def shuffled_rows(df):
    """Rows that the shuffles of a frame wrote, by the columns they carried."""
    df.collect()
    found = []

    def walk(plan):
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        if name == "Exchange":
            columns = [c.name() for c in _items(plan.output())]
            found.append((columns, plan.metrics().apply("shuffleRecordsWritten").value()))
        for child in _items(plan.children()):
            walk(child)

    def _items(seq):
        return [seq.apply(i) for i in range(seq.size())]

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_only_possible_hits_shuffle_their_text(spark):
    rows = [(i, f"a text of its own with the number {i} in it and more words") for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.one_of_each(documents(spark, rows))
        moved = shuffled_rows(kept)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept.count() == 400
    with_text = [n for columns, n in moved if "text" in columns]
    # The twenty copies, and what the filter lets pass by chance.
    assert with_text and sum(with_text) <= 25


def test_of_repeated_rows_the_least_other_columns_stay(spark):
    text = "some text that stands in the table three times over in all"
    df = spark.createDataFrame(
        [(1, text, "b", 2), (1, text, "a", 3), (1, text, "a", 4), (2, "another text", None, 1), (None, text, "z", 0)],
        "doc_id bigint, text string, source string, n_chars int",
    )
    for partitions in (1, 4):
        rows = jaccard.one_of_each(df.repartition(partitions)).collect()
        assert sorted(map(tuple, rows), key=str) == [(2, "another text", None, 1), (None, text, "z", 0)]
    rows = jaccard.one_of_each(df.where("doc_id IS NOT NULL")).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, text, "a", 3), (2, "another text", None, 1)]


@pytest.mark.parametrize("similarity", [0.05, 0.1])
def test_a_recall_out_of_reach_fails(similarity):
    with pytest.raises(ValueError, match="recall"):
        jaccard.bands_and_rows(similarity, 0.9999, jaccard.MAX_HASHES)
