"""Running totals over arrays as column expressions, linear in the array, and names bound once in an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _short(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, F.array(zero), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """[zero, op(zero, v1), op(op(zero, v1), v2), ...]: one more than the values. op is associative, zero its neutral element.

    Appending to an array copies it, so blocks of 32 are scanned apart and moved
    by the running totals of the blocks before them, on two levels.
    """

    def whole(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / _BLOCK).cast("int") - 1, F.lit(0)))
        blocks = F.transform(at, lambda i: F.slice(x, i * _BLOCK + 1, _BLOCK))

        def joined(b: Column) -> Column:
            before = running(F.transform(b, lambda v: F.aggregate(v, zero, op)), zero, op, levels - 1)
            moved = F.zip_with(F.slice(before, 1, F.size(b)), b, lambda p, v: F.slice(_short(v, p, op), 2, F.size(v)))
            return F.concat(F.array(zero), F.flatten(moved))

        return let(blocks, joined)

    return let(values, whole) if levels else _short(values, zero, op)


def running_sum(values: Column) -> Column:
    return running(values, F.lit(0), lambda a, v: a + v)


def running_max(values: Column, zero: int = -1) -> Column:
    return running(values, F.lit(zero), lambda a, v: F.greatest(a, v))


def pieces_of(text: Column, starts: Column, ends: Column, size: int = 1024) -> Column:
    """The code points [start, end) of the text for each pair of two arrays, without walking the text from its start for each."""

    def cut(x: Column) -> Column:
        def one(start: Column, end: Column) -> Column:
            first = F.floor(start / size).cast("int")
            near = F.array_join(F.slice(x, first + 1, F.greatest(F.floor((end - 1) / size).cast("int") - first + 1, F.lit(0))), "")
            return F.when(end > start, F.substring(near, start - first * size + 1, end - start)).otherwise(F.lit(""))

        return F.zip_with(starts, ends, one)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), cut)
