"""Quality and toxicity: kernels and sizes by definition, awkward rows, learnt accuracy."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from helpers import documents, no_documents
from stargauge.llm import quality, toxicity



def always():
    return F.lit(True)

CLEAN = "the garden was quiet this morning and nobody walked along the river bank".split()
INSULTS = ["blockhead", "nitwit", "scoundrel"]


def clean_text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(CLEAN, n)).replace("river ", "river. ")


def toxic_text(seed):
    rng = np.random.default_rng(seed)
    words = clean_text(seed).split()
    words[int(rng.integers(5, 50))] = str(rng.choice(INSULTS))
    words[int(rng.integers(5, 50))] = str(rng.choice(INSULTS))
    return " ".join(words)


def noise(seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"{w}$$${rng.integers(9)}###" for w in rng.choice(CLEAN, 60))


def tables(spark, bad):
    rows = [(i, clean_text(i)) for i in range(120)] + [(1000 + i, bad(i)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.selectExpr(
        "doc_id", "int(doc_id < 1000) AS quality", "int(doc_id >= 1000) AS toxic"
    )
    return docs, labels


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.fit(*tables(spark, toxic_text), always())


@pytest.fixture(scope="module")
def quality_model(spark):
    return quality.fit(*tables(spark, noise), always())


def kernel_by_definition(a, b):
    def features(token):
        padded, out = f"\x02{token}\x03", {}
        for i, j, k in itertools.combinations(range(len(padded)), 3):
            if k - i < toxicity.SPAN:
                key = padded[i] + padded[j] + padded[k]
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    return sum(value * y.get(key, 0) for key, value in x.items())


def test_subsequence_kernel():
    words = ["idiot", "ixdiot", "garden", "aaa", "b"]
    got = toxicity.kernel(words, ["idiot", "garden", "aaaa"])
    sizes = toxicity.lengths(words), toxicity.lengths(["idiot", "garden", "aaaa"])
    for i, word in enumerate(words):
        for j, landmark in enumerate(["idiot", "garden", "aaaa"]):
            wanted = kernel_by_definition(word, landmark) / sizes[0][i] / sizes[1][j]
            assert got[i, j] == pytest.approx(wanted, abs=1e-4)


def test_folded_weights_equal_the_machine():
    rng = np.random.default_rng(4)
    clean = sorted({"".join(rng.choice(list("abcdefgh"), 6)) for _ in range(80)})
    weights, bias = toxicity._train(INSULTS, clean, INSULTS + clean[:20])
    margins = toxicity.token_margins(weights, bias, INSULTS + clean)
    assert (margins[:3] > 0.5).all() and (margins[3:] < 0).all()


def test_gapped_and_inserted_insults(toxic_model):
    base = clean_text(7)
    forms = ["blockhead", "BLOCKHEAD!", "b.l.o.c.k.h.e.a.d", "blockxhead", "b l o c k h e a d", "nit-wit", "scounzdrel"]
    found = toxicity.scores(toxic_model, pa.array([f"{base} {form} {base}" for form in forms]))
    assert (found >= 0.5).all(), dict(zip(forms, found))
    clean = toxicity.scores(toxic_model, pa.array([clean_text(500 + i, 3000) for i in range(20)]))
    assert (clean < 0.5).all()


def test_toxicity_of_awkward_rows(spark, toxic_model):
    docs = documents(spark)
    rows = toxicity.score(docs, toxic_model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] < 0.5 for r in rows)
    kept = toxicity.civil(docs, toxic_model)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    long = pa.array(["x" * 500 + "blockhead" + "y" * 500, "z" * 5000])
    assert np.isfinite(toxicity.scores(toxic_model, long)).all()
    assert toxicity.score(no_documents(spark), toxic_model).count() == 0


def test_toxic_rows_go_and_others_stay(spark, toxic_model):
    rows = [(i, toxic_text(900 + i)) for i in range(30)] + [(100 + i, clean_text(900 + i)) for i in range(30)]
    kept = toxicity.civil(documents(spark, rows), toxic_model).collect()
    assert {r["doc_id"] for r in kept} == set(range(100, 130))


def test_nothing_to_learn_from(spark):
    docs, labels = tables(spark, toxic_text)
    for nothing in (labels.where("toxic = 0"), labels.limit(0)):
        assert toxicity.fit(docs, nothing, always()) is None
    assert quality.fit(docs, labels.where("quality = 1"), always()) is None
    assert {r["score"] for r in toxicity.score(documents(spark), None).collect()} == {0.0}
    assert {r["score"] for r in quality.score(documents(spark), None).collect()} == {quality.PRIOR}


def test_quality_separates_noise(quality_model):
    good = quality.scores(quality_model, [clean_text(2000 + i) for i in range(20)])
    bad = quality.scores(quality_model, [noise(2000 + i) for i in range(20)])
    assert (good >= quality.KEEP).all() and (bad < quality.KEEP).all()


def test_sizes_cover_whole_texts(quality_model):
    good, bad = quality_model.good, quality_model.bad
    head = clean_text(1, 2000)
    plain, spoilt = quality.measures(good, bad, [head, head + " " + noise(5) * 40])
    assert spoilt[0] < plain[0]
    assert quality.measures(good, bad, ["", None]).tolist() == [
        [0.0, quality.MIXED_SHARE]
    ] * 2


def test_quality_of_awkward_rows(spark, quality_model):
    docs = documents(spark)
    rows = quality.score(docs, quality_model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_key = {r["doc_id"]: r["score"] for r in rows}
    assert by_key[2] == by_key[3] and by_key[1] == by_key[5]
    assert quality.score(no_documents(spark), quality_model).count() == 0


def measured_plainly(good, bad, text):
    """Sizes of whole equal chunks with either dictionary, one compressor for each chunk."""
    data = (text or "").encode()
    if not data:
        return 0.0, quality.MIXED_SHARE
    chunks = -(-len(data) // quality.CHUNK)
    size = -(-len(data) // chunks)
    total = []
    for dictionary in (good, bad):
        known = zstandard.ZstdCompressionDict(dictionary)
        made = [
            zstandard.ZstdCompressor(
                level=quality.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False
            ).compress(data[at : at + size])
            for at in range(0, len(data), size)
        ]
        total.append(sum(map(len, made)) - quality.FRAME * len(made))
    neutral = quality.MIXED_BYTES * quality.MIXED_SHARE
    difference = (total[1] - total[0]) / (max(total) + neutral)
    return difference, (min(total) + neutral) / (len(data) + quality.MIXED_BYTES)


def test_quality_scores_by_definition(spark, quality_model):
    texts = [clean_text(1, 400), noise(3), "short", "", None, "é" * 5000, clean_text(2, 3000) + noise(4)]
    rows = quality.score(documents(spark, list(enumerate(texts))), quality_model).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        difference, share = measured_plainly(quality_model.good, quality_model.bad, text)
        d, s = min(max(10 * difference, -5), 5), np.log(min(max(share, 1e-3), 2))
        inputs = np.array([d, s, d * s, s * s, np.tanh(d), 1.0])
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-inputs @ quality_model.weights)), abs=0.01)


def test_one_half_teaches_and_the_other_calibrates_at_every_size(spark, monkeypatch):
    """What the dictionaries were taught is never measured for the calibration."""
    taught, measured = [], []
    monkeypatch.setattr(quality, "_dictionary", lambda pieces: taught.append(pieces) or b"some bytes " * 9)
    docs, labels = tables(spark, noise)
    seen = quality.stage
    monkeypatch.setattr(quality, "stage", lambda df, label: measured.append(seen(df, label)) or measured[-1])
    quality.fit(docs, labels, always())
    halves = {r["text"]: r["half"] for r in measured[0].collect()}
    pieces = {piece for part in taught for piece in part}
    assert all(halves[text] == 0 for text in halves if any(piece in text for piece in pieces))
    assert 0.3 < sum(halves.values()) / len(halves) < 0.7
