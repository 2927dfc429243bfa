"""Sum of word valences per review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.functions.text import split_words
from stargauge.operators.sizing import fits_broadcast
from stargauge.sources.staging import stage


def review_words(
    reviews: DataFrame, key: str = "review_id", text: str = "text", normalize: bool = False
) -> DataFrame:
    """One row per piece of text between white space.

    Pieces may be empty, and a missing text gives one NULL piece; neither is ever a term.
    """
    pieces = split_words(F.col(text), normalize)
    return reviews.select(key, F.explode_outer(pieces).alias("term"))


def _side(lexicon: DataFrame) -> tuple[DataFrame, bool]:
    """The lexicon as a join side, and whether it is broadcast.

    A large one is staged, so that the join can split a word that very many reviews share.
    """
    terms = lexicon.where(F.col("term") != "")
    if fits_broadcast(terms):
        return F.broadcast(terms), True
    return stage(terms, "lexicon"), False


def lexicon_hits(
    reviews: DataFrame,
    lexicon: DataFrame,
    key: str = "review_id",
    text: str = "text",
    normalize: bool = False,
) -> DataFrame:
    """Each word that the lexicon knows, with its score."""
    spoken = review_words(reviews, key, text, normalize)
    return spoken.join(_side(lexicon)[0], "term", "inner")


def sentiment_scores(
    reviews: DataFrame,
    lexicon: DataFrame,
    key: str = "review_id",
    text: str = "text",
    normalize: bool = False,
) -> DataFrame:
    """Score of every review, 0 where no word is known.

    The explode and the left join keep each review, so nothing has to be joined back.
    With a small lexicon the words are never shuffled: all words of a review lie in one
    partition and are summed there. With a large one, the words are counted per review before
    they are shuffled to the lexicon.
    """
    spoken = review_words(reviews, key, text, normalize)
    side, is_small = _side(lexicon)
    if is_small:
        spoken = spoken.withColumn("times", F.lit(1))
    else:
        spoken = spoken.groupBy(key, "term").agg(F.count("*").alias("times"))
    value = F.coalesce(F.col("score") * F.col("times"), F.lit(0))
    return spoken.join(side, "term", "left").groupBy(key).agg(F.sum(value).alias("score"))
