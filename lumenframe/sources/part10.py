"""Part-10 objects and raw data sets: Arrow batches of objects in, whole parsed objects out, each parsed once."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.dictionary import BIG, BYTE_VRS, DEFLATED, EXPLICIT, IMPLICIT, LONG_VRS, NUMBER_FORMATS, TAGS, TEXT_VRS, TRANSFER_SYNTAXES, VR_SIZE, vr_of
from lumenframe.schema import PARSED
from lumenframe.sources import rows as parsed_rows

BULK_THRESHOLD = 1 << 20
BULK_CAP = 16 << 20
_UNDEFINED = 0xFFFFFFFF
_CHARSETS = {"": "ascii", "ISO_IR 6": "ascii", "ISO_IR 100": "latin-1", "ISO_IR 192": "utf-8"}


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    """bulk: materialize, auto (values over the threshold are left out) or stream (all byte values are).

    wanted: the only tags, at any depth, whose elements are kept; others are passed over without decoding their values.
    stop_after: a top-level tag after which nothing is read, so that an object which is cut off later is not noticed. Ordinals are those of a full read.
    """

    bulk: str = "auto"
    strict: bool = False
    stop_after: str | None = None
    wanted: frozenset[str] | None = None
    inflate: bool = False


def guess_syntax(data: bytes) -> str:
    """Of a data set without file meta: explicit if bytes 4-5 are a VR, big-endian only if its tags fit strictly better."""
    if len(data) < 8:
        return IMPLICIT
    if data[4:6].decode("latin-1") not in VR_SIZE:
        return IMPLICIT

    def score(order: str) -> int:
        at = total = 0
        for _ in range(4):
            if at + 8 > len(data):
                break
            g, e = struct.unpack_from(order + "HH", data, at)
            vr, tag = data[at + 4 : at + 6].decode("latin-1"), f"{g:04X}{e:04X}"
            if tag in TAGS:
                total += 3 if TAGS[tag].vr == vr else -1
            n = struct.unpack_from(order + "I", data, at + 8)[0] + 12 if vr in LONG_VRS and at + 12 <= len(data) else struct.unpack_from(order + "H", data, at + 6)[0] + 8
            at += n
        return total

    return BIG if score(">") > score("<") else EXPLICIT


#: How a length is given: 16 bits after the VR, 32 bits after it and two bytes, 32 bits without a VR, 32 bits where the VR is unknown.
_SHORT, _LONG, _PLAIN, _UNKNOWN = range(4)
_UINT16, _UINT32 = ({order: order + c for order in "<>"} for c in "HI")
_INTEGER, _DECIMAL = re.compile(r"\s*[+-]?\d+"), re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


_HEADS: dict[tuple, tuple[str, str, int]] = {}  # a plain dict, as functions may be shipped by value


def _head(raw: bytes, order: str, explicit: bool) -> tuple[str, str, int]:
    """`_new_head`, kept.

    It is of an element's first six bytes (four if implicit): the same few begin the elements of all objects.
    """
    found = _HEADS.get((raw, order, explicit))
    if found is None:
        if len(_HEADS) >= 8192:
            _HEADS.clear()
        found = _HEADS[raw, order, explicit] = _new_head(raw, order, explicit)
    return found


def _new_head(raw: bytes, order: str, explicit: bool) -> tuple[str, str, int]:
    """Tag, VR and how the length is given."""
    g, e = struct.unpack_from(order + "HH", raw)
    tag = f"{g:04X}{e:04X}"
    if g == 0xFFFE:
        return tag, "NONE", _PLAIN
    if not explicit:
        return tag, vr_of(tag), _PLAIN
    vr = raw[4:6].decode("latin-1")
    if vr not in VR_SIZE:
        return tag, vr_of(tag), _UNKNOWN
    return tag, vr, _LONG if vr in LONG_VRS else _SHORT


class _Reader:
    def __init__(self, instance: str, data: bytes, options: Options):
        self.id, self.data, self.options = instance, data, options
        self.rows: list[tuple] = []
        self.n = 0
        self.syntax = ""
        self.charset = "ascii"
        self.stopped = False

    def header(self, at: int, order: str, explicit: bool) -> tuple[str, str, int, int]:
        """(tag, VR, length, where the value starts)."""
        data = self.data
        if at + 8 > len(data):
            raise ParseError(f"truncated element header at {at}")
        tag, vr, kind = _head(data[at : at + (6 if explicit else 4)], order, explicit)
        if kind == _SHORT:
            return tag, vr, struct.unpack_from(_UINT16[order], data, at + 6)[0], at + 8
        if kind == _LONG:
            if at + 12 > len(data):
                raise ParseError(f"truncated element header at {at}")
            return tag, vr, struct.unpack_from(_UINT32[order], data, at + 8)[0], at + 12
        if kind == _UNKNOWN and self.options.strict:
            raise ParseError(f"unknown VR {data[at + 4 : at + 6].decode('latin-1')!r} of {tag}")
        return tag, vr, struct.unpack_from(_UINT32[order], data, at + 4)[0], at + 8

    def add(self, path: list, meta: bool, tag: str, vr: str, value: bytes, length: int, order: str, offset: int, complete: bool = True) -> None:
        ordinal, self.n = self.n, self.n + 1
        wanted = self.options.wanted is None or tag in self.options.wanted
        if not wanted and tag not in ("00080005", "00020010"):
            return
        bulk = vr in BYTE_VRS and (self.options.bulk == "stream" or (self.options.bulk == "auto" and len(value) >= BULK_THRESHOLD))
        if vr in BYTE_VRS and not bulk and len(value) > BULK_CAP and self.options.bulk != "materialize":
            bulk = True
        text = strs = ints = dbls = raw = None
        if vr in TEXT_VRS:
            code = "utf-8" if vr == "UR" else self.charset
            text = value.decode(code if vr not in ("UI", "DA", "TM", "CS", "AE") else "latin-1", "replace").replace("\x00", "").strip()
            if tag == "00080005":
                self.charset = _CHARSETS.get(text.split("\\")[0], "latin-1")
            elif tag == "00020010" and meta:
                self.syntax = text
            strs = text.split("\\") if vr not in ("LT", "ST", "UT") else [text]
            if vr in ("IS", "DS"):
                kind, form = (int, _INTEGER) if vr == "IS" else (float, _DECIMAL)
                nums = []
                for x in strs:
                    m = form.match(x)
                    nums.append(kind(m[0]) if m else None)
                ints, dbls = (nums, None) if vr == "IS" else (None, nums)
        elif vr in NUMBER_FORMATS:
            n = len(value) // VR_SIZE[vr]
            got = list(struct.unpack_from(f"{order}{n}{NUMBER_FORMATS[vr]}", value)) if n else []
            if vr in ("FL", "FD"):
                dbls = got
            else:
                ints = [x - (1 << 64) if x >= 1 << 63 else x for x in got]
            strs = [repr(x) if vr in ("FL", "FD") else str(x) for x in got]
            text = "\\".join(strs)
        elif vr == "AT":
            n = len(value) // 4
            pairs = struct.unpack_from(f"{order}{2 * n}H", value)
            strs = [f"{pairs[2 * i]:04X}{pairs[2 * i + 1]:04X}" for i in range(n)]
            text = "\\".join(strs)
        elif vr in BYTE_VRS and not bulk:
            raw = value
        if not wanted:
            return
        path_text = "".join(f"{t}[{i}]/" for t, i in path)
        self.rows.append((self.id, ordinal, [{"tag": t, "item": i} for t, i in path], path_text, len(path), meta, tag, vr, length, complete, text, strs, ints, dbls, raw, None, bulk, offset if bulk else None))

    def passes_over(self, tag: str) -> bool:
        """Whether an element is only counted; its value is not copied."""
        if self.options.wanted is None or tag in self.options.wanted or tag in ("00080005", "00020010"):
            return False
        self.n += 1
        return True

    def encapsulated(self, at: int, order: str) -> int:
        """The end of an encapsulated value, after checking its items."""
        first, count = True, 0
        while True:
            tag, _, n, start = self.header(at, order, True)
            if tag == "FFFEE0DD":
                if count < 2:
                    raise ParseError("encapsulated value without a fragment")
                return start
            if tag != "FFFEE000" or n == _UNDEFINED:
                raise ParseError("encapsulated value with an item of undefined length")
            if first and n % 4:
                raise ParseError("offset table length is no multiple of 4")
            if not first and (n % 2 or n < 2):
                raise ParseError("fragment of odd or no length")
            if start + n > len(self.data):
                raise ParseError("truncated fragment")
            first, at, count = False, start + n, count + 1

    def sequence(self, at: int, end: int | None, path: list, tag: str, order: str, explicit: bool) -> int:
        item = 0
        while end is None or at < end:
            got, _, n, start = self.header(at, order, explicit)
            if got == "FFFEE0DD" and end is None:
                return start
            if got != "FFFEE000":
                raise ParseError(f"expected an item of {tag}, found {got}")
            stop = None if n == _UNDEFINED else start + n
            if stop is not None and (stop > len(self.data) or (end is not None and stop > end)):
                raise ParseError(f"item of {tag} is longer than its sequence")
            at = self.elements(start, stop, [*path, (tag, item)], False, order, explicit)
            item += 1
        return at

    def elements(self, at: int, end: int | None, path: list, meta: bool, order: str, explicit: bool) -> int:
        limit = len(self.data) if end is None else end
        while at < limit:
            if meta and self.data[at : at + 2] != b"\x02\x00":
                return at
            tag, vr, n, start = self.header(at, order, explicit)
            if tag == "FFFEE00D" and path:
                return start
            if tag == "FFFEE0DD" and path:
                return at  # the sequence ends although its item is open
            if not path and not meta and self.options.stop_after and tag > self.options.stop_after:
                self.stopped = True
                return limit
            if vr == "SQ" or (vr == "UN" and n == _UNDEFINED):
                self.add(path, meta, tag, "SQ", b"", 0, order, start)
                inner = explicit and vr == "SQ"
                stop = None if n == _UNDEFINED else start + n
                if stop is not None and stop > limit:
                    raise ParseError(f"sequence {tag} is longer than what holds it")
                at = self.sequence(start, stop, path, tag, "<" if vr == "UN" else order, inner)
                continue
            if n == _UNDEFINED:
                if tag != "7FE00010" and vr not in ("OB", "OW"):
                    raise ParseError(f"undefined length of {tag} {vr}")
                stop = self.encapsulated(start, order)
                if not self.passes_over(tag):
                    self.add(path, meta, tag, vr, self.data[start:stop], _UNDEFINED, order, start)
                at = stop
                continue
            if start + n > len(self.data) or start + n > limit:
                raise ParseError(f"value of {tag} is cut off: {n} bytes declared, {limit - start} there")
            if not self.passes_over(tag):
                self.add(path, meta, tag, vr, self.data[start : start + n], n, order, start)
            at = start + n
        if path and end is None and at >= limit:
            raise ParseError("item without its end")
        return at


def parse(instance: str, data: bytes, options: Options = Options()) -> tuple[list[tuple], str]:  # noqa: B008
    """(element rows, transfer syntax UID). Raises ParseError."""
    r = _Reader(instance, data, options)
    syntax, at = "", 0
    if data[128:132] == b"DICM" and data[132:134] == b"\x02\x00":
        at = r.elements(132, None, [], True, "<", True)
        syntax = r.syntax or IMPLICIT
    else:
        syntax = guess_syntax(data)
    known = TRANSFER_SYNTAXES.get(syntax)
    if syntax == DEFLATED:
        if not options.inflate:
            raise ParseError("deflated transfer syntax is not supported")
        r.data, at = zlib.decompress(data[at:], -15), 0
    if at < len(r.data):
        r.elements(at, None, [], False, ">" if known and not known.little else "<", known.explicit if known else True)
    return r.rows, syntax


def read_objects(objects: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Whole parsed objects (schema.PARSED) of objects(instance_id, content, ...), in one pass; one that does not parse, or came with an error_message, has a message and no partial result."""
    failed = F.col("error_message") if "error_message" in objects.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for instance, seen, error, content in parsed_rows.objects_of(batches):
                rows, syntax = [], None
                if error is None:
                    try:
                        rows, syntax = parse(instance, content or b"", options)
                    except ParseError as e:
                        error = str(e)
                yield instance, seen, syntax, error, rows

        return parsed_rows.batches_of(each())

    return objects.select("instance_id", parsed_rows.order_of(objects), failed, "content").mapInArrow(run, PARSED)


def read_elements(objects: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Element rows and transfer_syntax_uid; an object that does not parse gives one row of ordinal -1 whose str is the message."""
    return parsed_rows.element_rows(read_objects(objects, options))


def statuses(elements: DataFrame) -> DataFrame:
    """instance_id, status (ok or error), error_message of read objects."""
    bad = F.max(F.when(F.col("ordinal") < 0, F.coalesce("str", F.lit("unreadable"))))
    return elements.groupBy("instance_id").agg(bad.alias("error_message")).select("instance_id", F.when(F.col("error_message").isNull(), "ok").otherwise("error").alias("status"), "error_message")
