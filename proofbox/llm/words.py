"""Words of a text as DataFrame expressions: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased.

Words are cut from the text as it stands (a capital letter is a word character there) and
lower-cased where they are compared: ``folded`` is exact, while ``key`` (Spark's ``lower``,
which is cheaper) may join words that differ in other capitals, so it only finds candidates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATOR), "")


def folded(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def key(word: Column) -> Column:
    return F.lower(word)


def duck_words(text: str) -> str:
    """The same words in DuckDB SQL."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
