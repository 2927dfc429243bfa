"""Expressions on names, addresses, category lists and review text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space at which review text is cut into words. One-byte characters
# are listed singly and the rest sits behind a range check, which the matcher tests fastest.
WHITESPACE = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+"
)

ZIP_LENGTH = 5
STATE = "AZ"
NO_ZIP = "Missing"
NO_CATEGORY = "MISSING"


def zip_code(address: Column) -> Column:
    """Last five characters, unless the state shows that the address has no zip."""
    tail = F.right(address, F.lit(ZIP_LENGTH))
    return F.when(tail.contains(STATE), F.lit(NO_ZIP)).otherwise(tail)


def flat_categories(categories: Column) -> Column:
    """``[a, b]`` as ``-a-b``; an empty list as ``MISSING``."""
    joined = F.concat(F.lit("-"), F.array_join(categories, "-"))
    return F.when(F.size(categories) > 0, joined).otherwise(F.lit(NO_CATEGORY))


def categories_or_missing(categories: Column) -> Column:
    """The list itself, or ``[MISSING]`` for an empty one."""
    return F.when(F.size(categories) > 0, categories).otherwise(
        F.array(F.lit(NO_CATEGORY))
    )


def split_words(text: Column, normalize: bool = False) -> Column:
    """The text cut at white space; the first and last piece may be empty.

    Case and punctuation are kept unless ``normalize`` asks for lower-case words without
    leading and trailing punctuation.
    """
    if not normalize:
        return F.split(text, WHITESPACE)
    return F.transform(
        F.split(F.lower(text), WHITESPACE),
        lambda word: F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", ""),
    )


def words(text: Column, normalize: bool = False) -> Column:
    """Whitespace-separated words of the whole text."""
    return F.filter(split_words(text, normalize), lambda word: word != "")
