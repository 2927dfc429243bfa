from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from helpers import documents, no_documents
from stargauge.llm import language
from stargauge.llm.common import distinct_words

ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs away with the thing".split()
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft dann schnell weg".split()


def sentence(words, seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, sentence(ENGLISH, i), "en") for i in range(40)]
    rows += [(100 + i, sentence(GERMAN, i), "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "no label " * 9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return language.fit(df)


def test_counts_equal_brute_force(spark):
    rows = [(1, "ab, a", "x"), (2, "AB", "x"), (3, "ba", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.fit(df)
    assert found.languages == ["x", "y"]
    ids, starts = language.grams(["ab", "a", "ba", ""])
    assert starts.tolist() == [0, 2, 3, 5]
    counts = np.exp(found.log_probability.astype(float))
    ratio = (2 + language.SMOOTHING) / (1 + language.SMOOTHING)
    assert counts[ids[0], 0] / counts[ids[2], 0] == pytest.approx(ratio, rel=1e-4)


def test_mixtures(model):
    text = sentence(ENGLISH, 1, 60) + " " + sentence(GERMAN, 2, 20)
    texts = pa.array([text, sentence(GERMAN, 3), "fox", "hund", "", None, "12 !!", text.upper()])
    names, scores = language.predict_texts(model, texts)
    assert names == ["en", "de", "en", "de", "und", "und", "und", "en"]
    assert scores[0] == pytest.approx(0.75, abs=0.06) and scores[7] == pytest.approx(scores[0])
    assert scores[1] > 0.95 and scores[4] == scores[5] == scores[6] == 0
    share, counts = language.proportions(model, distinct_words(texts))
    assert (share > 0).sum(axis=1).tolist() == [2, 1, 1, 1, 0, 0, 0, 2]
    assert counts.tolist() == [80, 40, 1, 1, 0, 0, 0, 80]


def test_mixture_step_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    likelihood, offsets = rng.random((12, 3)), np.array([0, 5, 5, 12])
    start = np.full((3, 3), 1 / 3)
    share, value = language._mixture(likelihood, offsets, start, 7)
    for text, (a, b) in enumerate(zip(offsets, offsets[1:])):
        mine = np.full(3, 1 / 3)
        for _ in range(7):
            weights = [likelihood[i] * mine / (likelihood[i] @ mine) for i in range(a, b)]
            mine = sum(weights, np.zeros(3)) / max(1, b - a)
        assert share[text] == pytest.approx(mine)
        assert value[text] == pytest.approx(sum(np.log(likelihood[i] @ mine) for i in range(a, b)))


def test_awkward_rows(spark, model):
    docs = documents(spark)
    found = language.predict(docs, model)
    assert found.count() == docs.count()
    by_key = {row["doc_id"]: row for row in found.collect()}
    assert {by_key[k]["lang_pred"] for k in (2, 3, 6)} == {"und"}
    kept = language.identified(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "7", "7", "8", "None"]
    assert language.predict(no_documents(spark), model).count() == 0


def test_without_training_rows(spark):
    model = language.fit(no_documents(spark))
    rows = language.predict(documents(spark), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_sampling_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, second = (language.fit(df, max_docs=20) for df in (docs, docs.repartition(5)))
    assert np.array_equal(first.log_probability, second.log_probability)


def test_marks_alone_are_no_letters(model):
    texts = pa.array(["́̂ ̈", "é", "́ fox"])
    names, scores = language.predict_texts(model, texts)
    assert names[0] == "und" and scores[0] == 0 and names[1] != "und" and names[2] == "en"
    _, counts = language.proportions(model, distinct_words(texts))
    assert counts.tolist() == [0, 1, 1]


ALPHABETS = ["abc", "def", "ghi", "jkl", "mno", "pqr", "stu"]


def word(alphabet, rng, n=6):
    return "".join(rng.choice(list(alphabet), n))


@pytest.fixture(scope="module")
def seven(spark):
    rng = np.random.default_rng(0)
    rows = [
        (i * 100 + j, " ".join(word(letters, rng) for _ in range(40)), f"l{i}")
        for i, letters in enumerate(ALPHABETS)
        for j in range(20)
    ]
    return language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def plain_selection(model, text):
    """The penalised choice with every number of languages tried, for one text."""
    words = distinct_words(pa.array([text]))
    ids, starts = language.grams(language.letters_only(words.entries).to_pylist())
    bounds = np.append(starts, len(ids))
    per_word = np.array([model.log_probability[ids[a:b]].sum(axis=0) for a, b in zip(bounds, bounds[1:])])
    likelihood = np.exp(np.maximum(per_word - per_word.max(axis=1, keepdims=True), -60))[words.codes]
    n, languages = likelihood.shape

    def climb(share, rounds):
        for _ in range(rounds):
            joint = likelihood * share
            share = (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0) / n
        return share, np.log((likelihood * share).sum(axis=1)).sum()

    whole, _ = climb(np.full(languages, 1 / languages), language.ROUNDS)
    order = np.argsort(-whole, kind="stable")
    best = None
    for size in range(1, languages + 1):
        start = np.zeros(languages)
        start[order[:size]] = 1 / size
        share, value = climb(start, language.REFIT_ROUNDS)
        value -= language.PENALTY * (size - 1) * np.log1p(n)
        if best is None or value > best[0]:
            best = value, share
    return best[1]


def test_any_number_of_languages(seven):
    rng = np.random.default_rng(9)
    texts = [
        " ".join(word(ALPHABETS[i], rng) for i in range(used) for _ in range(30))
        for used in (1, 2, 5, 7)
    ]
    share, _ = language.proportions(seven, distinct_words(pa.array(texts)))
    assert (share > 0).sum(axis=1).tolist() == [1, 2, 5, 7]
    for row, text in zip(share, texts, strict=True):
        assert row == pytest.approx(plain_selection(seven, text), abs=1e-6)
