"""Assets of objects: their metadata, frames and contents, as rows or as one ZIP archive an object, in one pass over whole objects."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe import arrow
from lumenframe.dictionary import TRANSFER_SYNTAXES
from lumenframe.functions.dicom import mime_extension, safe_name
from lumenframe.operators import frames
from lumenframe.operators.mapping import Mapping
from lumenframe.operators.objects import of_tag, value_of
from lumenframe.pixels import codecs

#: Elements whose bytes are contents: encapsulated documents, waveforms, audio.
CONTENT_TAGS = ("00420011", "54001010", "5400100C", "0050200C")
ASSET = "instance_id string, instance_uid string, kind string, number int, frame_index int, category string, mime_type string, transfer_syntax_uid string, width int, height int, content binary, concern string"
_NAMES = tuple(x.strip().split(" ")[0] for x in ASSET.split(","))
_MIME = {"png": "image/png", "tiff": "image/tiff", "jpeg": "image/jpeg", "rgba": "application/octet-stream", "native": "application/octet-stream"}
_ENDINGS = {"png": "png", "tiff": "tif", "jpeg": "jpg", "rgba": "rgba", "native": "bin"}
#: Transfer syntaxes whose pixel data are a film as a whole, not frames.
_FILMS = tuple(u for u, t in TRANSFER_SYNTAXES.items() if "MPEG" in t.name or "HEVC" in t.name)


def needed(mapping: Mapping | None) -> frozenset[str]:
    """The tags that assets are made of."""
    own = {"00080018", "00080016", "00420012", *CONTENT_TAGS, *frames.NEEDED}
    return frozenset(own | set(mapping.needed_tags() if mapping else ()))


def _metadata(mapping: Mapping | None) -> Column:
    if mapping is None:
        return F.lit(None).cast("string")
    lookup = {t: value_of(t, last=True, top=False) for t in mapping.needed_tags()}
    columns = [c.alias(n) for n, c in mapping.columns(lookup)]
    return F.to_json(F.struct(*columns)) if columns else F.lit("{}")


def _sources(parsed: DataFrame, mapping: Mapping | None, selector) -> DataFrame:
    """A row per object with everything its assets are made of."""
    film = F.coalesce(F.col("transfer_syntax_uid").isin(*_FILMS), F.lit(False))
    found = F.concat(*(F.transform(of_tag(t, top=False), lambda e: F.struct(e["tag"].alias("tag"), e["bin"].alias("bin"))) for t in CONTENT_TAGS))
    films = F.when(film, F.transform(of_tag("7FE00010"), lambda e: F.struct(e["tag"].alias("tag"), e["bin"].alias("bin")))).otherwise(F.array().cast("array<struct<tag:string,bin:binary>>"))
    uid = F.coalesce(F.nullif(F.trim(value_of("00080018")), F.lit("")), F.col("instance_id"))
    held = parsed.select("*", uid.alias("instance_uid"), _metadata(mapping).alias("metadata"), F.concat(films, found).alias("contents"), mime_extension(value_of("00420012")).alias("ending"), value_of("00420012").alias("mime"), film.alias("film"))
    return frames.frame_facts(held, selector, ("instance_uid", "metadata", "contents", "ending", "mime", "film"))


def _assets(r, encode: str, registry: codecs.Registry) -> list[dict]:
    head = {"instance_id": r.instance_id, "instance_uid": r.instance_uid, "transfer_syntax_uid": r.transfer_syntax_uid}
    out: list[dict] = []
    if r.metadata is not None:
        out.append(head | {"kind": "metadata", "number": 1, "mime_type": "application/json", "content": r.metadata.encode()})
    rows = frames.frames_of(r) if r.pixels is not None and not r.film else []
    for i, row in enumerate(rows, 1):
        frame = SimpleNamespace(**dict(zip(frames.FRAME_NAMES, row, strict=True)))
        content, concern = None, frame.concern
        if frame.bytes is not None:
            try:
                content = frame.bytes if encode == "native" else frames.picture_of(frame, encode, registry)
            except (codecs.CodecError, TypeError) as e:
                concern = concern or str(e)
        out.append(head | {"kind": "frame", "number": i, "frame_index": frame.frame_index, "category": encode, "mime_type": _MIME[encode], "width": frame.columns, "height": frame.rows, "content": content, "concern": concern})
    for i, c in enumerate(r.contents, 1):
        document = c["tag"] == "00420011"
        out.append(head | {"kind": "content", "number": i, "category": "Video" if c["tag"] == "7FE00010" else "Content", "mime_type": r.mime if document and r.mime else "application/octet-stream", "content": None if c["bin"] is None else bytes(c["bin"]), "concern": "bulk value that was not read" if c["bin"] is None else None})
    return out


def assets(parsed: DataFrame, mapping: Mapping | None = None, selector="all", encode: str = "png", registry: codecs.Registry | None = None) -> DataFrame:
    """One row per asset of whole parsed objects: metadata (JSON of the mapping), frames (png, tiff, jpeg, rgba or native) and contents (documents, waveforms, audio, films)."""
    if encode not in _MIME:
        raise ValueError(f"encode is one of {tuple(_MIME)}")
    known = registry or codecs.Registry()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (a for r in arrow.rows_of(batches) for a in _assets(r, encode, known))
        return arrow.batches_of((tuple(map(a.get, _NAMES)) for a in found), arrow.schema_of(ASSET))

    return _sources(parsed, mapping, selector).mapInArrow(run, ASSET)


def archive_of(found: list[dict], instance: str, ending: str = "bin", manifest: bool = True) -> bytes:
    """A ZIP of an object's assets: metadata.json, frames/frame-000001.png, contents/content-000001.pdf, manifest.json; the same bytes at every run."""
    out, files = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def add(path: str, content: bytes, entry: dict) -> None:
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
            files.append({"path": path, **entry, "size": len(content)})

        for a in sorted(found, key=lambda a: ("frame", "content", "metadata").index(a["kind"])):
            content, concern = a["content"] or b"", {"concern": a["concern"]} if a.get("concern") else {}
            if a["kind"] == "frame":
                add(f"frames/frame-{a['number']:06d}.{_ENDINGS[a['category']]}", content, {"kind": "frame", "index": a["frame_index"], "mimeType": a["mime_type"], "width": a["width"], "height": a["height"], **concern})
            elif a["kind"] == "content":
                name = {"image/jpeg": "jpg"}.get(a["mime_type"], ending if a["mime_type"] != "application/octet-stream" else "bin")
                add(f"contents/content-{a['number']:06d}.{name}", content, {"kind": "content", "category": a["category"], **concern})
            else:
                add("metadata.json", content, {"kind": "metadata"})
        if manifest:
            held = {"version": "lumenframe-assets-1", "instanceUID": instance, "frameCount": sum(a["kind"] == "frame" for a in found), "contentCount": sum(a["kind"] == "content" for a in found), "files": files}
            z.writestr(zipfile.ZipInfo("manifest.json", (1980, 1, 1, 0, 0, 0)), json.dumps(held, indent=2), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def archives(parsed: DataFrame, mapping: Mapping | None = None, selector="all", encode: str = "png", manifest: bool = True, registry: codecs.Registry | None = None) -> DataFrame:
    """instance_id, file_name, content: one ZIP archive of all assets per whole parsed object."""
    if encode not in _MIME:
        raise ValueError(f"encode is one of {tuple(_MIME)}")
    known = registry or codecs.Registry()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((r.instance_id, r.instance_uid, archive_of(_assets(r, encode, known), r.instance_uid, r.ending or "bin", manifest)) for r in arrow.rows_of(batches))
        return arrow.batches_of(made, arrow.schema_of(schema))

    schema = "instance_id string, instance_uid string, content binary"
    made = _sources(parsed, mapping, selector).mapInArrow(run, schema)
    return made.select("instance_id", F.concat(safe_name(F.col("instance_uid")), F.lit(".zip")).alias("file_name"), "content")
