"""Views of whole parsed objects: expressions over the array of their elements, so nothing is shuffled or parsed again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.dictionary import TAGS
from lumenframe.operators.select import Selection

ELEMENTS = "elements"


def of_tag(tag: str, top: bool = True) -> Column:
    """The elements of a tag, in order."""
    return F.filter(ELEMENTS, lambda e: (e["tag"] == tag) & (e["depth"] == 0) if top else e["tag"] == tag)


def value_of(tag: str, field: str = "str", last: bool = False, top: bool = True) -> Column:
    """A field of the first (or last) element of a tag; null without one."""
    return F.try_element_at(of_tag(tag, top), F.lit(-1 if last else 1))[field]


def name_of(tag: str) -> str:
    return TAGS[tag].keyword if tag in TAGS else tag


def facts(parsed: DataFrame, selection: Selection, keep: Sequence[str] = ("instance_id",), last: bool = False, top: bool = True) -> DataFrame:
    """One row per object that parsed, and a column per tag, named by keyword."""
    return parsed.filter("error_message is null").select(*keep, *(value_of(t, last=last, top=top).alias(name_of(t)) for t in selection.tags))
