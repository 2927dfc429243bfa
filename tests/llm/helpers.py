"""Tables with every awkward row, for all operators."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet " * 4000
# Null and empty texts, a null key, a repeated row, equal texts, a very long one, no letters.
ROWS = [
    (1, "Plain words of a first document, nothing else to see in here."),
    (2, None),
    (3, ""),
    (None, "A document whose key is not known, but which has some words."),
    (4, LONG),
    (5, "Plain words of a first document, nothing else to see in here."),
    (6, "1234 !!! ???"),
    (7, "Repeated row with one text that stands twice in the table, for once."),
    (7, "Repeated row with one text that stands twice in the table, for once."),
    (8, "x" * 3000),
]
# Names that operators use themselves.
CLASHES = (
    "score", "shard", "bin", "id", "tokens", "label", "n", "class_id", "seed", "payload", "size",
    "lang_pred", "key", "half", "rep", "band", "high", "ids",
)


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    extra = [f"'x' AS {name}" for name in CLASHES]
    return df.selectExpr("*", "'en' AS lang", "'src' AS source", *extra)


def no_documents(spark):
    return documents(spark, [])
