"""Projection and predicates over element rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.dictionary import TAGS, tag_of


class Selection:
    """A projection list of data elements, built by keyword, tag or (gggg,eeee)."""

    def __init__(self, *names: str):
        self.tags: tuple[str, ...] = tuple(dict.fromkeys(tag_of(n) for n in names))

    def include(self, *names: str) -> Selection:
        return Selection(*self.tags, *names)

    def has(self, name: str) -> bool:
        return tag_of(name) in self.tags

    @property
    def max_tag(self) -> str | None:
        """The last tag in data set order; a reader of top-level elements may stop after it."""
        return max(self.tags, default=None)


def select_elements(elements: DataFrame, selection: Selection) -> DataFrame:
    """Rows of the selected tags, also those inside sequences. The builder hands the tags to the parser as well (`part10.Options.wanted`), which then decodes no others."""
    return elements.filter(F.col("tag").isin(*selection.tags)) if selection.tags else elements.limit(0)


def pivot_first(elements: DataFrame, selection: Selection, keys: Sequence[str] = ("instance_id",), value: str = "str", last: bool = False) -> DataFrame:
    """One row per object and one column per tag (named by keyword): the first value by ordinal, or the last."""
    pick = F.max_by if last else F.min_by
    columns = [pick(value, F.when(F.col("tag") == t, F.col("ordinal"))).alias(TAGS[t].keyword if t in TAGS else t) for t in selection.tags]
    columns = [F.when(F.count(F.when(F.col("tag") == t, 1)) > 0, c).alias(TAGS[t].keyword if t in TAGS else t) for t, c in zip(selection.tags, columns, strict=True)]
    return select_elements(elements, selection).groupBy(*keys).agg(*columns)


def skip_below(elements: DataFrame, prefix: str) -> DataFrame:
    """Without the elements inside the sequence item (or sequence) of that path."""
    return elements.filter(~F.coalesce(F.startswith("path_text", F.lit(prefix)), F.lit(False)))


def until(elements: DataFrame, ordinal: Column | int) -> DataFrame:
    """The elements before an ordinal."""
    return elements.filter(F.col("ordinal") < ordinal)


def frame_indexes(count: Column, selector: str | Sequence[int] | dict | None) -> Column:
    """The frames a selector names: 'first', 'all', a list (out of range: dropped) or {start, end, step} (clamped)."""
    none = F.array().cast("array<int>")
    if selector is None or selector == "first":
        out = F.array(F.lit(0))
    elif selector == "all":
        out = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    elif isinstance(selector, dict):
        clamp = lambda x: F.greatest(F.lit(0), F.least(count - 1, x))
        start, end = clamp(F.lit(int(selector.get("start", 0)))), clamp(F.lit(int(selector["end"])) if "end" in selector else count - 1)
        out = F.when(start <= end, F.sequence(start, F.greatest(start, end), F.lit(max(1, int(selector.get("step", 1)))))).otherwise(none)
    else:
        out = F.filter(F.array(*(F.lit(int(i)) for i in selector)).cast("array<int>"), lambda i: (i >= 0) & (i < count))
    return F.when(count > 0, out).otherwise(none)


def matches(value: Column, wanted: str, vr: str = "LO") -> Column:
    """Query matching: empty is universal, backslash lists UIDs, * and ? are wildcards, a-b a range of dates or times."""
    if wanted == "":
        return F.lit(True)
    if vr == "UI":
        return value.isin(*wanted.split("\\"))
    if vr in ("DA", "TM", "DT") and "-" in wanted:
        lo, hi = wanted.split("-", 1)
        return (value >= lo if lo else F.lit(True)) & (value <= hi if hi else F.lit(True))
    if "*" in wanted or "?" in wanted:
        return value.rlike("^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in wanted) + "$")
    return value == wanted


def query(instances: DataFrame, keys: dict[str, str], vrs: dict[str, str] | None = None, return_keys: Sequence[str] = ()) -> DataFrame:
    """Rows that match all keys; keys and return keys are the columns of the answer."""
    cond = F.lit(True)
    for k, v in keys.items():
        cond = cond & F.coalesce(matches(F.col(k), v, (vrs or {}).get(k, "LO")), F.lit(False))
    return instances.filter(cond).select(*sorted({*keys, *return_keys})).distinct()


def references(elements: DataFrame, instances: DataFrame) -> DataFrame:
    """Referenced SOP instances of key objects, segmentations and presentation states, and whether they are there."""
    refs = elements.filter((F.col("tag") == tag_of("ReferencedSOPInstanceUID")) & (F.col("depth") > 0)).select("instance_id", F.col("str").alias("referenced_uid")).distinct()
    there = instances.select(F.col("sop_instance_uid").alias("referenced_uid"), F.lit(True).alias("_there")).distinct()
    return refs.join(there, "referenced_uid", "left").select("instance_id", "referenced_uid", F.coalesce("_there", F.lit(False)).alias("resolved"))


def references_within(elements: DataFrame, there: Column, uid: str = "str") -> DataFrame:
    """`references` to what the same elements say is there (uid, where `there` holds): these are read once and shuffled once, not once for each side of a join."""
    refers = F.coalesce((F.col("tag") == tag_of("ReferencedSOPInstanceUID")) & (F.col("depth") > 0), F.lit(False))
    found = F.coalesce(there, F.lit(False)) & F.col(uid).isNotNull()
    claim = lambda value, own, held: F.struct(F.col(value).alias("referenced_uid"), own.alias("_by"), F.lit(held).alias("_there"))
    instance = F.struct("instance_id")  # a reference has one, whatever its instance_id
    claims = F.array_compact(F.array(F.when(refers, claim("str", instance, False)), F.when(found, claim(uid, F.when(F.lit(False), instance), True))))
    held = elements.select(F.explode(claims).alias("c")).select("c.*").repartition("referenced_uid").distinct()
    known = held.withColumn("_any", F.max("_there").over(Window.partitionBy("referenced_uid"))).filter("_by is not null")
    return known.select(F.col("_by.instance_id").alias("instance_id"), "referenced_uid", F.col("_any").alias("resolved"))
