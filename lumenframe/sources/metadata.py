"""DICOM JSON and XML metadata as element rows, by built-in functions for the flat part and Arrow batches for nesting."""

from __future__ import annotations

import base64
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.dictionary import BYTE_VRS, KEYWORDS, vr_of
from lumenframe.schema import PARSED
from lumenframe.sources import rows as parsed_rows

_INTS, _DBLS = frozenset("US SS UL SL SV UV IS".split()), frozenset("FL FD DS".split())
JSON_SCHEMA = "array<map<string,struct<vr:string,Value:array<string>,InlineBinary:string,BulkDataURI:string>>>"


def flat_json(documents: DataFrame, text: str = "json") -> DataFrame:
    """Top-level elements of DICOM JSON text (an array of objects, or one), without Python: instance_id, object_no, tag, vr, values, inline, bulk_uri."""
    body = F.when(F.ltrim(F.col(text)).startswith("{"), F.concat(F.lit("["), F.col(text), F.lit("]"))).otherwise(F.col(text))
    rows = documents.select("instance_id", F.posexplode(F.from_json(body, JSON_SCHEMA)).alias("object_no", "o")).select("instance_id", "object_no", F.explode("o").alias("tag", "e"))
    return rows.select("instance_id", "object_no", F.upper("tag").alias("tag"), F.coalesce("e.vr", F.lit("UN")).alias("vr"), F.col("e.Value").alias("values"), F.col("e.InlineBinary").alias("inline"), F.col("e.BulkDataURI").alias("bulk_uri"))


def studies_of_json(documents: DataFrame, text: str = "json") -> DataFrame:
    """study_uid, n_series, n_instances, modalities: the smallest whole query, two shuffles after the parse."""
    tags = {"study_uid": "StudyInstanceUID", "series_uid": "SeriesInstanceUID", "sop_uid": "SOPInstanceUID", "modality": "Modality"}
    first: list[Column] = [F.max(F.when(F.col("tag") == KEYWORDS[t], F.get("values", F.lit(0)))).alias(n) for n, t in tags.items()]
    objects = flat_json(documents, text).filter(F.col("tag").isin(*(KEYWORDS[t] for t in tags.values()))).groupBy("instance_id", "object_no").agg(*first)
    series = objects.groupBy("study_uid", "series_uid").agg(F.countDistinct("sop_uid").alias("n"), F.min("modality").alias("modality"))
    return series.groupBy("study_uid").agg(F.count(F.lit(1)).alias("n_series"), F.sum("n").alias("n_instances"), F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("modalities"))


def _row(instance: str, ordinal: int, path: list[tuple[str, int]], tag: str, vr: str, vals: list, raw: bytes | None = None, uri: str | None = None) -> tuple:
    text = "\\".join("" if v is None else str(v) for v in vals) if vals and vr not in BYTE_VRS and vr != "SQ" else None
    numbers = lambda kind: [_number(v, kind) for v in vals]
    path_text = "".join(f"{t}[{i}]/" for t, i in path)
    return (
        instance, ordinal, [{"tag": t, "item": i} for t, i in path], path_text, len(path), tag.startswith("0002"), tag, vr, len(raw) if raw is not None else len((text or "").encode()), True,
        text, [None if v is None else str(v) for v in vals] if text is not None else None, numbers(int) if vr in _INTS and vals else None, numbers(float) if vr in _DBLS and vals else None, raw, uri, uri is not None, None,
    )


def _number(v, kind):
    try:
        return kind(v)
    except (TypeError, ValueError):
        return None


def _pn(v) -> str | None:
    if isinstance(v, dict):
        groups = [v.get(k) or "" for k in ("Alphabetic", "Ideographic", "Phonetic")]
        return "=".join(groups).rstrip("=") or v.get("value")
    return v


def json_rows(instance: str, objects: list[dict]) -> Iterator[tuple]:
    for number, obj in enumerate(objects):
        key, n = (instance if len(objects) == 1 else f"{instance}#{number}"), 0

        def walk(node: dict, path: list, key: str = key) -> Iterator[tuple]:
            nonlocal n
            for tag, e in sorted(node.items()):
                tag, vr = tag.upper(), e.get("vr") or vr_of(tag.upper())
                vals = e.get("Value") or []
                raw = base64.b64decode(re.sub(r"^data:[^,]*,", "", e["InlineBinary"])) if "InlineBinary" in e and vr in BYTE_VRS else None
                if vr == "SQ":
                    yield _row(key, n, path, tag, vr, [])
                    n += 1
                    for i, item in enumerate(vals):
                        yield from walk(item or {}, [*path, (tag, i)])
                else:
                    yield _row(key, n, path, tag, vr, [_pn(v) if vr == "PN" else v for v in vals], raw, e.get("BulkDataURI"))
                    n += 1

        yield from walk(obj, [])


def xml_rows(instance: str, text: str) -> Iterator[tuple]:
    n = 0

    def pn(e: ET.Element) -> str:
        groups = []
        for g in ("Alphabetic", "Ideographic", "Phonetic"):
            part = next((c for c in e if c.tag.split("}")[-1] == g), None)
            names = {c.tag.split("}")[-1]: (c.text or "") for c in part} if part is not None else {}
            groups.append("^".join(names.get(k, "") for k in ("FamilyName", "GivenName", "MiddleName", "NamePrefix", "NameSuffix")).rstrip("^"))
        return "=".join(groups).rstrip("=")

    def walk(node: ET.Element, path: list) -> Iterator[tuple]:
        nonlocal n
        for e in (c for c in node if c.tag.split("}")[-1] == "DicomAttribute"):
            tag = e.get("tag", "").upper().replace("(", "").replace(")", "").replace(",", "") or KEYWORDS.get(e.get("keyword", ""), "")
            vr = e.get("vr") or vr_of(tag)
            named = [(c.tag.split("}")[-1], c) for c in e]
            inline = next((c.text or "" for k, c in named if k == "InlineBinary"), None)
            uri = next((c.get("uri") or c.get("uuid") for k, c in named if k == "BulkData"), None)
            order = sorted((c for k, c in named if k in ("Value", "PersonName")), key=lambda c: int(c.get("number", "0") or 0))
            vals = [pn(c) if c.tag.split("}")[-1] == "PersonName" else (c.text or "") for c in order]
            if vr in _INTS | {"FL", "FD"}:
                vals = [_typed(v, vr) for v in vals]
            yield _row(instance, n, path, tag, vr, [] if vr == "SQ" else vals, base64.b64decode(inline) if inline is not None and vr in BYTE_VRS else None, uri)
            n += 1
            for i, item in enumerate(c for k, c in named if k == "Item"):
                yield from walk(item, [*path, (tag, i)])

    yield from walk(ET.fromstring(text), [])


def _typed(v: str, vr: str):
    got = _number(v, float if vr in ("FL", "FD") else int)
    return v if got is None or vr == "IS" else got


def _objects(documents: DataFrame, text: str, objects_of: Callable[[str, str], Iterator[tuple[str, list[tuple]]]]) -> DataFrame:
    """Whole parsed objects of documents(instance_id, text): objects_of gives the name and element rows of each object in a text."""
    failed = F.col("error_message") if "error_message" in documents.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for instance, seen, error, body in parsed_rows.objects_of(batches):
                found = []
                if error is None:
                    try:
                        found = list(objects_of(instance, body or ""))
                    except (ValueError, AttributeError, TypeError, ET.ParseError) as e:
                        error = str(e)
                if error is not None:
                    yield instance, seen, None, error, []
                for i, (name, rows) in enumerate(found):
                    yield name, f"{seen}#{i:010d}", None, None, rows

        return parsed_rows.batches_of(each())

    return documents.select("instance_id", parsed_rows.order_of(documents), failed, F.col(text).cast("string")).mapInArrow(run, PARSED)


def read_json_objects(documents: DataFrame, text: str = "json") -> DataFrame:
    """Whole parsed objects of DICOM JSON text, sequences included; text that does not parse gives a message."""

    def objects_of(instance: str, body: str) -> Iterator[tuple[str, list[tuple]]]:
        found = json.loads(body)
        found = found if isinstance(found, list) else [found]
        for i, one in enumerate(found):
            name = instance if len(found) == 1 else f"{instance}#{i}"
            yield name, list(json_rows(name, [one]))

    return _objects(documents, text, objects_of)


def read_xml_objects(documents: DataFrame, text: str = "xml") -> DataFrame:
    """Whole parsed objects of native-model XML text; values by their number, inline binaries decoded."""
    return _objects(documents, text, lambda instance, body: iter([(instance, list(xml_rows(instance, body)))]))


def read_json(documents: DataFrame, text: str = "json") -> DataFrame:
    """Element rows of DICOM JSON text; text that does not parse gives one row of ordinal -1 with the message."""
    return parsed_rows.element_rows(read_json_objects(documents, text)).drop("transfer_syntax_uid")


def read_xml(documents: DataFrame, text: str = "xml") -> DataFrame:
    """Element rows of native-model XML text."""
    return parsed_rows.element_rows(read_xml_objects(documents, text)).drop("transfer_syntax_uid")


def _xml_tree(body: str) -> dict:
    """A document node with its elements and texts in order; adjacent texts are one, comments and instructions are left out."""
    document: dict = {"type": "document", "children": []}
    stack = [document]
    parser = expat.ParserCreate()
    parser.ordered_attributes = True

    def begin(name: str, attributes: list[str]) -> None:
        prefix, _, local = name.rpartition(":")
        node = {"type": "element", "name": name, "prefix": prefix or None, "localName": local, "attributes": dict(zip(attributes[::2], attributes[1::2], strict=True)), "children": []}
        stack[-1]["children"].append(node)
        stack.append(node)

    def words(text: str) -> None:
        held = stack[-1]["children"]
        if held and held[-1]["type"] == "text":
            held[-1]["text"] += text
        elif len(stack) > 1:
            held.append({"type": "text", "text": text})

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, lambda _: stack.pop(), words
    parser.Parse(body, True)
    return document


def structured_values(documents: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """instance_id, value (VARIANT), concern of JSON or XML text; what does not parse has no value and a concern."""
    if kind == "json":
        # The parser stops at the end of a value: an element after it shows that nothing else follows.
        pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(',"end"]'))), "$", "array<variant>")
        whole = F.coalesce(F.size(pair) == 2, F.lit(False))
        return documents.select("instance_id", F.when(whole, F.get(pair, F.lit(0))).alias("value"), F.when(~whole, F.lit("malformed JSON")).alias("concern"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, concerns = [], []
            for body in batch.column(1).to_pylist():
                try:
                    values.append(json.dumps(_xml_tree(body or "")))
                    concerns.append(None)
                except (expat.ExpatError, RecursionError) as e:
                    values.append(None)
                    concerns.append(f"malformed XML: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string()), pa.array(concerns, pa.string())], ["instance_id", "value", "concern"])

    found = documents.select("instance_id", F.col(text).cast("string")).mapInArrow(run, "instance_id string, value string, concern string")
    return found.select("instance_id", F.try_parse_json("value").alias("value"), "concern")


def parse_dump(lines: DataFrame, text: str = "line") -> DataFrame:
    """tag, vr, value, value_length, keyword of the lines of a text dump: (gggg,eeee) VR [value] # length, multiplicity Keyword."""
    p = r"^\s*\(([0-9a-fA-F]{4}),([0-9a-fA-F]{4})\)\s+([A-Z]{2})\s+(.*?)\s*#\s*(\d+|u/l),\s*(\d+)\s+(\S+)\s*$"
    c = F.col(text)
    return lines.filter(c.rlike(p)).select(
        F.upper(F.concat(F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2))).alias("tag"), F.regexp_extract(c, p, 3).alias("vr"),
        F.regexp_replace(F.regexp_replace(F.regexp_extract(c, p, 4), r"^\[(.*)\]$", "$1"), r"^\(no value available\)$", "").alias("value"),
        F.regexp_extract(c, p, 5).try_cast("long").alias("value_length"), F.regexp_extract(c, p, 7).alias("keyword"),
    )
