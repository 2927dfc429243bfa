"""The stages one after another, on planted rows and on whole tables."""

from __future__ import annotations

import re

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from helpers import documents, no_documents
from stargauge.llm import language, toxicity
from stargauge.llm.queries import tokenizer_path
from test_decontaminate import brute_force
from test_jaccard import grams
from test_language import plain_selection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, each output written and read again."""
    from stargauge.sources.staging import stage

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {}
    for name, apply in pipeline.STAGES:
        made = stage(apply(spark, docs, FOLDER), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def test_all_but_the_last_return_documents(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        keys = [r["doc_id"] for r in after.collect()]
        assert 0 < len(keys) == len(set(keys)) <= before.count()


def test_near_duplicates_leave_one_of_each(stages):
    before, after = stages["near-duplicates"]
    rows = {r["doc_id"]: grams(r["text"]) for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}

    def linked(a, b):
        return a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9

    for key, own in rows.items():
        if key not in kept:
            assert any(linked(own, other) for k, other in rows.items() if k != key)
        else:
            assert not any(linked(own, rows[k]) for k in kept if k != key)


def texts_and_gone(before, after):
    kept = {r["doc_id"] for r in after.collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    return texts, set(texts) - kept


def test_language_decides_text_by_text(stages):
    before, after = stages["language"]
    texts, gone = texts_and_gone(before, after)
    model = language.fit(language.training_rows(before))
    for key, text in texts.items():
        if not re.search(r"[^\W\d_]", text or ""):
            assert key in gone
            continue
        share = plain_selection(model, text)
        # A share at the limit may fall on either side of it by rounding.
        if abs(share.max() - 0.35) > 1e-6:
            assert (share.max() < 0.35) == (key in gone)


def test_toxicity_decides_text_by_text(spark, stages):
    """Tokens judged one by one; the two worst of a text make its score."""
    before, after = stages["toxicity"]
    texts, gone = texts_and_gone(before, after)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit(before, labels, toxicity.teaching())

    def judged(token):
        parts = toxicity.windows(token)
        return max(toxicity.token_margins(model.weights, model.bias, [part])[0] for part in parts)

    known = {}
    for key, text in texts.items():
        tokens = [re.sub(r"[\W\d_]+", "", word) for word in (text or "").lower().split()]
        values = [known.setdefault(t, judged(t)) if t not in known else known[t] for t in tokens if len(t) >= 3]
        run = []
        for token in [*tokens, "end"]:
            if len(token) == 1:
                run.append(token)
                continue
            if len(run) >= toxicity.SPELLED:
                values.append(judged("".join(run)))
            run = []
        two = sorted([max(v, toxicity.NOTHING) for v in values], reverse=True)[:2]
        two += [toxicity.NOTHING] * (2 - len(two))
        inputs = np.array([*np.clip(two, toxicity.NOTHING, toxicity.SPREAD), *np.maximum(two, 0), 1.0])
        value = 1 / (1 + np.exp(-inputs @ model.calibration))
        if abs(value - 0.5) > 1e-3:
            assert (value >= 0.5) == (key in gone)


def test_decontamination_equals_brute_force(spark, stages):
    before, after = stages["decontamination"]
    texts, gone = texts_and_gone(before, after)
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    # All removed texts, and those short enough to compare every window in Python.
    compared = [(k, t) for k, t in texts.items() if k in gone or len(t or "") < 700]
    assert len(compared) > len(gone) + 10
    assert gone == {key for key, _ in brute_force(compared, items)}


def test_pieces_are_those_of_the_library(stages):
    before, after = stages["pieces"]
    texts, gone = texts_and_gone(before, after)
    assert not gone and after.where("NOT round_trip").count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    for row in after.collect():
        assert list(row["ids"]) == library.encode(texts[row["doc_id"]] or "")


def test_run_equals_the_stages(spark, stages):
    rows = pipeline.run(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(
        r["doc_id"] for r in stages["pieces"][1].collect()
    )


@pytest.mark.parametrize("make", [documents, no_documents])
def test_stages_take_awkward_and_empty_tables(make, spark):
    docs = make(spark)
    for _, apply in pipeline.STAGES:
        docs = apply(spark, docs, FOLDER)
        assert docs.count() >= 0
