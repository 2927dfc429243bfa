from __future__ import annotations

from conftest import values
from stargauge.operators import sentiment, sizing

TEXTS = [
    ("1", "good good bad"),
    ("2", "nothing known"),
    ("3", ""),
    ("4", None),
    ("5", "Good bad, not good"),
    ("6", "not good"),
]
WORDS = [("good", 3), ("bad", -2), ("not good", -5)]
SCORES = [("1", 4), ("2", 0), ("3", 0), ("4", 0), ("5", 3), ("6", 3)]


def frames(spark):
    return (
        spark.createDataFrame(TEXTS, "review_id string, text string"),
        spark.createDataFrame(WORDS, "term string, score int"),
    )


def test_scores(spark):
    assert values(sentiment.sentiment_scores(*frames(spark))) == SCORES


def test_scores_with_a_lexicon_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sentiment, "fits_broadcast", lambda df: False)
    assert values(sentiment.sentiment_scores(*frames(spark))) == SCORES


def test_normalized_scores(spark):
    scored = sentiment.sentiment_scores(*frames(spark), normalize=True)
    assert dict(values(scored))["5"] == 4


def test_broadcast_bounds(spark):
    rows = spark.range(10)
    assert sizing.fits_broadcast(rows, max_rows=10)
    assert not sizing.fits_broadcast(rows, max_rows=9)
    assert not sizing.fits_broadcast(rows, max_bytes=20)
    assert sizing.fits_broadcast(rows.limit(0))
