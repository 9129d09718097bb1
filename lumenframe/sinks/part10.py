"""Element rows back to Part-10 bytes; sequences are written with undefined lengths."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe import arrow
from lumenframe.dictionary import BIG, BYTE_VRS, EXPLICIT, IMPLICIT, LONG_VRS, NUMBER_FORMATS, TRANSFER_SYNTAXES, VR_SIZE
from lumenframe.sources.rows import object_rows

_SWAP = {"OW": 2, "OF": 4, "OL": 4, "OD": 8, "OV": 8}


def value_bytes(vr: str, text: str | None, raw: bytes | None, order: str, charset: str = "utf-8", from_order: str = "<") -> bytes:
    """A value's bytes, padded to an even length (blank for text, NUL for UIDs and bytes)."""
    if vr in BYTE_VRS:
        out = raw or b""
        width = _SWAP.get(vr, 1)
        if order != from_order and width > 1 and len(out) % width == 0:
            out = b"".join(out[i : i + width][::-1] for i in range(0, len(out), width))
    elif vr in NUMBER_FORMATS:
        kind = float if vr in ("FL", "FD") else int
        nums = [kind(float(x)) if kind is int and "." in x else kind(x) for x in (text or "").split("\\") if x != ""]
        if vr == "UV":
            nums = [x % (1 << 64) for x in nums]
        out = struct.pack(f"{order}{len(nums)}{NUMBER_FORMATS[vr]}", *nums)
    elif vr == "AT":
        out = b"".join(struct.pack(order + "HH", int(x[:4], 16), int(x[4:], 16)) for x in (text or "").split("\\") if len(x) == 8)
    else:
        out = (text or "").encode(charset, "replace")
    return out + (b"\x00" if vr in BYTE_VRS or vr == "UI" else b" ") * (len(out) % 2)


@lru_cache(8192)
def _head(tag: str, vr: str, order: str, explicit: bool) -> tuple[bytes, bool, bytes]:
    """Tag and VR as they are written, whether the length has 32 bits, and the head of a value that is too long for 16."""
    head = struct.pack(order + "HH", int(tag[:4], 16), int(tag[4:], 16))
    if not explicit:
        return head, True, b""
    return (head + vr.encode() + b"\x00\x00", True, b"") if vr in LONG_VRS else (head + vr.encode(), False, head + b"UN\x00\x00")


def _element(tag: str, vr: str, value: bytes, order: str, explicit: bool, undefined: bool = False) -> bytes:
    head, wide, longer = _head(tag, vr, order, explicit)
    n = 0xFFFFFFFF if undefined else len(value)
    if not wide and n <= 0xFFFF:
        return head + struct.pack(order + "H", n) + value
    return (head if wide else longer) + struct.pack(order + "I", n) + value


#: What is written of an element, in this order.
_FIELDS = ("tag", "vr", "str", "bin", "is_meta", "path", "value_length", "is_bulk")


def serialise(rows: list[dict], syntax: str, part10: bool = True, from_syntax: str | None = None) -> bytes:
    """One object's bytes from its element rows in order. The meta group's length is computed."""
    return _serialise([tuple(r.get(c) for c in _FIELDS) for r in rows], syntax, part10, from_syntax)


def _serialise(rows: list[tuple], syntax: str, part10: bool, from_syntax: str | None) -> bytes:
    known = TRANSFER_SYNTAXES.get(syntax) or TRANSFER_SYNTAXES[EXPLICIT]
    order, explicit = ("<" if known.little else ">"), known.explicit
    source_order = ">" if from_syntax == BIG else "<"
    charset = next((text for tag, _, text, *_ in rows if tag == "00080005" and text), "")
    codec = {"ISO_IR 100": "latin-1"}.get(charset, "utf-8")
    metas, out, open_ = [], [], []
    has_syntax = False

    def close(depth: int) -> None:
        while len(open_) > depth:
            kind = open_.pop()
            out.append(struct.pack(order + "HHI", 0xFFFE, 0xE00D if kind[0] == "item" else 0xE0DD, 0))

    for tag, vr, text, raw, is_meta, steps, length, _ in rows:
        if is_meta:
            if tag == "00020010":
                text, has_syntax = syntax, True
            if tag != "00020000":
                metas.append(_element(tag, vr, value_bytes(vr, text, raw, "<", codec), "<", True))
            continue
        if steps or open_:
            path = [(p["tag"], p["item"]) for p in steps or ()]
            keep = 0
            for i, (own, item) in enumerate(path):
                if len(open_) > 2 * i + 1 and open_[2 * i] == ("seq", own) and open_[2 * i + 1] == ("item", item):
                    keep = 2 * i + 2
                else:
                    if len(open_) > 2 * i and open_[2 * i] == ("seq", own):
                        keep = 2 * i + 1
                    break
            close(keep)
            for i in range(len(open_) // 2, len(path)):
                own, item = path[i]
                if len(open_) == 2 * i:
                    out.append(_element(own, "SQ", b"", order, explicit, True))
                    open_.append(("seq", own))
                out.append(struct.pack(order + "HHI", 0xFFFE, 0xE000, 0xFFFFFFFF))
                open_.append(("item", item))
        if vr == "SQ":
            out.append(_element(tag, "SQ", b"", order, explicit, True))
            open_.append(("seq", tag))
            continue
        undefined = tag == "7FE00010" and length == 0xFFFFFFFF
        value = (raw or b"") if undefined else value_bytes(vr, text, raw, order, codec, source_order)
        out.append(_element(tag, vr if vr in VR_SIZE else "UN", value, order, explicit, undefined))
    close(0)
    if not part10:
        return b"".join(out)
    if not has_syntax:
        metas.append(_element("00020010", "UI", value_bytes("UI", syntax, None, "<"), "<", True))
    meta = b"".join(metas)
    group = _element("00020000", "UL", struct.pack("<I", len(meta)), "<", True)
    return b"\x00" * 128 + b"DICM" + group + meta + b"".join(out)


def write_bytes(elements: DataFrame, syntax: str | None = None, part10: bool = True) -> DataFrame:
    """Bytes of the objects of element rows, which are first put together by a shuffle."""
    return write_objects(object_rows(elements.filter("ordinal >= 0")), syntax, part10)


def _listed(column: pa.Array) -> list:
    """`to_pylist` at once and not value by value, which takes most of the time of small objects."""
    if pa.types.is_list(column.type):
        ends = column.offsets.to_pylist()
        if ends[0] == ends[-1]:
            return [()] * len(column)
        inner = column.flatten()  # nulls are empty here
        steps = list(zip(*(inner.field(i).to_pylist() for i in range(inner.type.num_fields)), strict=True))
        sizes = column.value_lengths().fill_null(0).to_pylist()
        at, out = 0, []
        for n in sizes:
            out.append([{"tag": tag, "item": item} for tag, item in steps[at : at + n]])
            at += n
        return out
    if pa.types.is_integer(column.type) and column.null_count:
        return column.to_pylist()  # numpy would make them floats
    return column.to_numpy(zero_copy_only=False).tolist()


def write_objects(parsed: DataFrame, syntax: str | None = None, part10: bool = True) -> DataFrame:
    """instance_id, content for each whole parsed object; syntax: the target, else that of the object's file meta (or explicit little endian). Bulk values left out on reading cannot be written and raise."""

    def one(instance: str, rows: list[tuple]) -> bytes:
        if any(r[7] for r in rows):
            raise ValueError(f"object {instance} has bulk values that were not read")
        own = next((r[2] for r in rows if r[0] == "00020010"), None) or EXPLICIT
        target = syntax or own
        if TRANSFER_SYNTAXES.get(own, TRANSFER_SYNTAXES[EXPLICIT]).compressed and target in (IMPLICIT, EXPLICIT, BIG) and target != own and any(r[6] == 0xFFFFFFFF for r in rows):
            raise ValueError("encapsulated pixel data has to be decoded before it can be written natively")
        return _serialise(rows, target, part10, own)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for piece in arrow.pieces(batches):
            lists = piece.column(1)
            ends = lists.offsets.to_pylist()
            held = lists.values.slice(ends[0], ends[-1] - ends[0])
            rows = list(zip(*(_listed(held.field(i)) for i in range(len(_FIELDS))), strict=True))
            for instance, a, b in zip(piece.column(0).to_pylist(), ends, ends[1:], strict=False):
                yield instance, one(instance, rows[a - ends[0] : b - ends[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow.batches_of(made(batches), arrow.schema_of(_WRITTEN))

    slim = F.transform("elements", lambda e: F.struct(*(e[c].alias(c) for c in _FIELDS)))
    return parsed.filter("error_message is null").select("instance_id", slim.alias("elements")).mapInArrow(run, _WRITTEN)


_WRITTEN = "instance_id string, content binary"


def write_files(objects: DataFrame, folder: str, extension: str = "dcm") -> int:
    """Each object's content as a file of its own in a folder that all executors see: written beside and renamed. Returns their number."""
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["instance_id"], batch["content"], strict=True):
                safe = "".join(c if c.isalnum() or c in "._-" else "_" for c in name)
                os.makedirs(folder, exist_ok=True)
                temporary = os.path.join(folder, f".{safe}.{os.getpid()}.tmp")
                with open(temporary, "wb") as f:
                    f.write(bytes(content))
                os.replace(temporary, os.path.join(folder, f"{safe}.{extension}"))
            yield pd.DataFrame({"n": [len(batch)]})

    return objects.select("instance_id", "content").mapInPandas(run, "n long").groupBy().sum("n").first()[0] or 0
