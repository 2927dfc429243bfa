"""Score a file of reviews against a lexicon file and write the scores."""

from __future__ import annotations

from pyspark.sql import SparkSession

from stargauge.operators.sentiment import sentiment_scores
from stargauge.sources.readers import read_keyed_reviews, read_lexicon
from stargauge.sources.writers import write_sentiment


def score_reviews(spark: SparkSession, reviews: str, lexicon: str, output: str) -> str:
    scores = sentiment_scores(
        read_keyed_reviews(spark, reviews).select("review_id", "text"),
        read_lexicon(spark, lexicon),
    )
    return write_sentiment(scores, output)
