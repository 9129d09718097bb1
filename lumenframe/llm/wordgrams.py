"""Word arrays and their hashes as column expressions, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.llm.staging import text_lower

_SPACES = " \t\n\x0b\f\r"


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; null and blank texts have none."""
    body = F.btrim(text_lower(text), F.lit(_SPACES))
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def shifted(values: Column, by: int) -> Column:
    """values without the first `by` elements."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))
