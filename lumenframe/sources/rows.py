"""Parsed objects as Arrow batches: one row per object, with its elements as an array of structs."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe import arrow
from lumenframe.schema import ELEMENT_NAMES, ELEMENT_STRUCT, ELEMENTS, PARSED

#: Elements, and bytes of their values, that a batch holds before it is handed on.
BATCH_ELEMENTS, BATCH_BYTES = 8_000, 8 << 20

#: Leaves of plans of this size and more do not tell theirs.
UNKNOWN_BYTES = 1 << 60

_TEXTS, _LONGS = pa.list_(pa.string()), pa.int64()
_TYPES = {
    "ordinal": _LONGS, "path": pa.list_(pa.struct([("tag", pa.string()), ("item", pa.int32())])), "path_text": pa.string(), "depth": pa.int32(), "is_meta": pa.bool_(), "tag": pa.string(), "vr": pa.string(), "value_length": _LONGS, "is_complete": pa.bool_(),
    "str": pa.string(), "strs": _TEXTS, "ints": pa.list_(_LONGS), "dbls": pa.list_(pa.float64()), "bin": pa.binary(), "bulk_uri": pa.string(), "is_bulk": pa.bool_(), "bulk_offset": _LONGS,
}
_FIELDS = [pa.field(n, _TYPES[n]) for n in ELEMENT_NAMES]
_BIN = 1 + ELEMENT_NAMES.index("bin")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    flat = [row for *_, rows in held for row in rows]
    columns = list(zip(*flat, strict=True))[1:] if flat else [()] * len(_FIELDS)
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], fields=_FIELDS)
    offsets = [0]
    for *_, rows in held:
        offsets.append(offsets[-1] + len(rows))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
    texts = [pa.array([h[i] for h in held], pa.string()) for i in range(4)]
    return pa.RecordBatch.from_arrays([*texts, lists], ["instance_id", "seen", "transfer_syntax_uid", "error_message", "elements"])


def batches_of(parsed: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Of (instance, seen, syntax, error, element rows that begin with the instance)."""
    held: list[tuple] = []
    n = size = 0
    for one in parsed:
        held.append(one)
        n += len(one[4]) + 1
        size += sum(len(row[_BIN]) for row in one[4] if row[_BIN] is not None)
        if n >= BATCH_ELEMENTS or size >= BATCH_BYTES:
            yield _batch(held)
            held, n, size = [], 0, 0
    if held:
        yield _batch(held)


def objects_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches of four columns, a few at a time."""
    for piece in arrow.pieces(batches):
        yield from zip(*(c.to_pylist() for c in piece.columns), strict=True)


def custom_objects(objects: DataFrame, parse: Callable[[str, bytes], Iterable[dict]]) -> DataFrame:
    """Whole parsed objects by a user's parser: (instance, bytes) to elements as dicts of their columns (tag, vr and str at least). An error it raises is the object's message."""
    failed = F.col("error_message") if "error_message" in objects.columns else F.lit(None).cast("string")
    plain = {"path": [], "path_text": "", "depth": 0, "is_meta": False, "is_complete": True, "is_bulk": False}

    def row(instance: str, ordinal: int, given: dict) -> tuple:
        text = given.get("str")
        held = {**plain, "ordinal": ordinal, "value_length": len(text.encode()) if text is not None else len(given.get("bin") or b""), "strs": None if text is None else text.split("\\"), **given}
        return (instance, *(held.get(n) for n in ELEMENT_NAMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for instance, seen, error, content in objects_of(batches):
                rows: list[tuple] = []
                if error is None:
                    try:
                        rows = [row(instance, k, e) for k, e in enumerate(parse(instance, content or b""))]
                    except Exception as e:  # a user's code fails in its own ways
                        error = f"{type(e).__name__}: {e}"
                yield instance, seen, None, error, rows

        return batches_of(each())

    return objects.select("instance_id", order_of(objects), failed, "content").mapInArrow(run, PARSED)


def source_bytes(rows: DataFrame) -> int:
    """Bytes of the files that the rows are made of, 0 where a source does not tell (streams, rows of the driver or of a cluster's memory); nothing runs.

    Not the size that the plan is estimated to have: that of a join is the product of its sides.
    """
    if rows.isStreaming:
        return 0
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < UNKNOWN_BYTES)


def order_of(objects: DataFrame) -> Column:
    """What orders the objects of a source: path and part, or the name of objects that have none."""
    have = set(objects.columns)
    if not {"source_uri", "part_no"} <= have:
        return F.col("instance_id")
    return F.concat(F.coalesce("source_uri", "instance_id"), F.lit("#"), F.lpad(F.coalesce("part_no", F.lit(0)).cast("string"), 10, "0"))


def element_rows(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per element, with further columns of its object; an object that did not parse gives one of ordinal -1 whose str is the message."""
    known = {"ordinal": F.lit(-1).cast("long"), "path_text": F.lit(""), "depth": F.lit(0), "value_length": F.lit(0).cast("long"), "is_complete": F.lit(False), "str": F.col("error_message"), "is_bulk": F.lit(False)}
    types = dict(x.strip().split(" ", 1) for x in _columns(ELEMENTS))
    bad = F.array(F.struct(*(known.get(n, F.array().cast(types[n]) if n == "path" else F.lit(None).cast(types[n])).alias(n) for n in ELEMENT_NAMES)).cast(ELEMENT_STRUCT))
    e = F.explode(F.when(F.col("error_message").isNull(), F.col("elements")).otherwise(bad))
    return parsed.select("instance_id", "transfer_syntax_uid", *keep, e.alias("e")).select("instance_id", "e.*", "transfer_syntax_uid", *keep)


def _columns(schema: str) -> list[str]:
    import re

    return re.split(r",(?![^<]*>)", schema)


def object_rows(elements: DataFrame, wanted: Collection[str] | None = None) -> DataFrame:
    """Whole objects from element rows, wherever these come from (seen is their order, if they have it): one shuffle by instance. wanted: the only tags whose elements are put together; objects without any of them stay."""
    have = set(elements.columns)
    types = dict(x.strip().split(" ", 1) for x in _columns(ELEMENTS))
    fields = F.struct(*(F.col(n).cast(types[n]).alias(n) if n in have else F.lit(None).cast(types[n]).alias(n) for n in ELEMENT_NAMES))
    kept = F.col("ordinal") >= 0 if wanted is None else (F.col("ordinal") >= 0) & F.col("tag").isin(*wanted)
    syntax = F.max("transfer_syntax_uid") if "transfer_syntax_uid" in have else F.lit(None).cast("string")
    rows = elements.groupBy("instance_id").agg(
        F.coalesce(F.min("seen") if "seen" in have else F.lit(None).cast("string"), F.first("instance_id")).alias("seen"),
        F.max(F.when(F.col("ordinal") < 0, F.coalesce("str", F.lit("unreadable")) if "str" in have else F.lit("unreadable"))).alias("error_message"), syntax.alias("transfer_syntax_uid"),
        F.sort_array(F.collect_list(F.when(kept, fields))).alias("elements"),
    )
    return rows.select("instance_id", "seen", "transfer_syntax_uid", "error_message", "elements")


__all__ = ["PARSED", "batches_of", "custom_objects", "element_rows", "object_rows", "order_of", "source_bytes"]
