"""Mixed imaging objects as one kind: frames of all of them, or DICOM objects of all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe import arrow
from lumenframe.dictionary import EXPLICIT, KEYWORDS, SECONDARY_CAPTURE
from lumenframe.functions.dicom import deterministic_uid
from lumenframe.operators.frames import FRAME, FRAME_NAMES, LOST, NEEDED, object_frames, stretch
from lumenframe.pixels import codecs
from lumenframe.schema import PARSED
from lumenframe.sinks import packages
from lumenframe.sinks import part10 as writer
from lumenframe.sources import part10
from lumenframe.sources.kinds import format_of, kind_of
from lumenframe.sources.rows import batches_of, objects_of

READERS = {"png": codecs.png_decode, "tiff": codecs.tiff_decode, "jpeg": codecs.jpeg_picture}


def _samples(picture: np.ndarray) -> np.ndarray:
    """(rows, columns, 1 or 3) without alpha; grey keeps 16 bits, colours have 8."""
    px = picture[:, :, : 3 if picture.shape[2] > 2 else 1]
    return (px >> 8).astype(np.uint8) if px.shape[2] == 3 and px.dtype.itemsize == 2 else px


_PLAIN = dict.fromkeys(FRAME_NAMES) | {"frame_index": 0, "transfer_syntax_uid": EXPLICIT, "rows": 0, "columns": 0, "samples": 1, "allocated": 8, "stored": 8, "signed": False}
_PLAIN |= {"photometric": "MONOCHROME2", "planar": 0, "slope": 1.0, "intercept": 0.0, "modality": "OT", "palette_first": 0, "palette_bits": 16}


def _drawn(instance: str, name: str, content: bytes, stretched: bool) -> dict:
    """The frame row of a picture file of the format of that name."""
    row = _PLAIN | {"instance_id": instance}
    try:
        if name not in READERS:
            raise codecs.CodecError(f"no codec for {name}")
        px = _samples(READERS[name](content))
        px = stretch(px) if stretched and px.shape[2] == 1 and px.dtype.itemsize == 1 else px
        bits = 8 * px.dtype.itemsize
        row |= {"rows": px.shape[0], "columns": px.shape[1], "samples": px.shape[2], "allocated": bits, "stored": bits, "photometric": "RGB" if px.shape[2] == 3 else "MONOCHROME2", "bytes": px.astype(f"<u{bits // 8}").tobytes()}
    except Exception as e:  # damaged bytes fail in many ways; the object's concern says how
        row["frame_index"], row["concern"] = -1, f"{type(e).__name__}: {e}"
    return row


def image_frames(images: DataFrame, stretched: bool = False) -> DataFrame:
    """One frame row per PNG, TIFF or JPEG file of (instance_id, content); stretched: 8-bit grey levels are spread. What cannot be decoded has null bytes and a concern."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for r in arrow.rows_of(batches):
            yield tuple(_drawn(r.instance_id, r.format, r.content, stretched).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow.batches_of(each(batches), arrow.schema_of(FRAME))

    return images.select("instance_id", format_of(F.col("content")).alias("format"), "content").mapInArrow(run, FRAME)


def capture(frames: DataFrame) -> DataFrame:
    """A whole secondary capture for each single-frame picture (rows of `image_frames` without concerns)."""
    uid = lambda name: deterministic_uid(F.concat(F.lit(name + "|"), F.col("instance_id")))
    none, sop, text = F.lit(None), F.lit(SECONDARY_CAPTURE), lambda c: F.col(c).cast("string")
    plan = [
        (True, "FileMetaInformationVersion", "OB", none, F.lit(b"\x00\x01")), (True, "MediaStorageSOPClassUID", "UI", sop, none), (True, "MediaStorageSOPInstanceUID", "UI", uid("SOPInstanceUID"), none), (True, "TransferSyntaxUID", "UI", F.lit(EXPLICIT), none),
        (False, "SpecificCharacterSet", "CS", F.lit("ISO_IR 192"), none), (False, "SOPClassUID", "UI", sop, none), (False, "SOPInstanceUID", "UI", uid("SOPInstanceUID"), none), (False, "Modality", "CS", F.lit("OT"), none), (False, "ConversionType", "CS", F.lit("WSD"), none),
        (False, "StudyInstanceUID", "UI", uid("StudyInstanceUID"), none), (False, "SeriesInstanceUID", "UI", uid("SeriesInstanceUID"), none), (False, "SeriesNumber", "IS", F.lit("1"), none), (False, "InstanceNumber", "IS", F.lit("1"), none),
        (False, "SamplesPerPixel", "US", text("samples"), none), (False, "PhotometricInterpretation", "CS", F.col("photometric"), none), (False, "PlanarConfiguration", "US", F.lit("0"), none), (False, "Rows", "US", text("rows"), none), (False, "Columns", "US", text("columns"), none),
        (False, "BitsAllocated", "US", text("allocated"), none), (False, "BitsStored", "US", text("stored"), none), (False, "HighBit", "US", (F.col("stored") - 1).cast("string"), none), (False, "PixelRepresentation", "US", F.lit("0"), none), (False, "PixelData", "OW", none, F.col("bytes")),
    ]
    return packages.planned_objects(frames, plan)


def _opened(objects: DataFrame, stretched: bool) -> DataFrame:
    """Whole objects (schema.PARSED) of objects with _kind, in one pass: DICOM objects parsed, pictures as objects of the elements that frames are made of."""
    options = part10.Options(bulk="materialize", wanted=NEEDED)
    failed = F.col("error_message") if "error_message" in objects.columns else F.lit(None).cast("string")

    def element(instance: str, ordinal: int, tag: str, vr: str, text: str | None, raw: bytes | None = None) -> tuple:
        return instance, ordinal, [], "", 0, False, tag, vr, len(raw or text or ""), True, text, None, None, None, raw, None, False, None

    def opened(instance: str, kind: str, name: str, content: bytes) -> tuple[list[tuple], str | None]:
        if kind == "dicom":
            return part10.parse(instance, content or b"", options)
        if kind == "unknown":
            return [element(instance, 0, LOST, "UN", "unknown kind of object", content)], None
        row = _drawn(instance, name, content, stretched)
        if row["concern"] is not None:
            return [element(instance, 0, LOST, "UN", row["concern"])], None
        texts = {"SamplesPerPixel": "samples", "PhotometricInterpretation": "photometric", "Rows": "rows", "Columns": "columns", "BitsAllocated": "allocated", "BitsStored": "stored", "Modality": "modality"}
        rows = [element(instance, i, KEYWORDS[t], "LO", str(row[n])) for i, (t, n) in enumerate(texts.items())]
        return [*rows, element(instance, len(rows), KEYWORDS["PixelData"], "OW", None, row["bytes"])], EXPLICIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for instance, kind, name, error, content in objects_of(batches):
                rows, syntax = [], None
                if error is None or kind != "dicom":
                    try:
                        rows, syntax = opened(instance, kind, name, content)
                    except part10.ParseError as e:
                        error = str(e)
                yield instance, None, syntax, error if kind == "dicom" else None, rows

        return batches_of(each())

    return objects.select("instance_id", "_kind", format_of(F.col("content")).alias("format"), failed.alias("_failed"), "content").mapInArrow(run, PARSED)


def normalize(objects: DataFrame, mode: str = "frames", unknown: str = "fail", stretched: bool = False) -> DataFrame:
    """Objects (instance_id, content) of any imaging kind: as frames (rows of `extract_frames`), or as dicom (instance_id, content, concern).

    Pictures become secondary captures. What is neither a DICOM object nor a picture fails, or with `passthrough` keeps its bytes
    and a concern. DICOM objects pass as they are; pictures that cannot be decoded have null bytes and a concern.
    """
    if mode not in ("frames", "dicom") or unknown not in ("fail", "passthrough"):
        raise ValueError("mode is frames or dicom, unknown is fail or passthrough")
    kind = kind_of(format_of(F.col("content")))
    if unknown == "fail":
        kind = F.when(kind == "unknown", F.raise_error(F.concat(F.lit("neither DICOM nor a picture: "), F.col("instance_id")))).otherwise(kind)
    known = objects.withColumn("_kind", kind)
    of = lambda k: known.filter(F.col("_kind") == k).drop("_kind")
    if mode == "frames":
        return object_frames(_opened(known, stretched))
    drawn = image_frames(of("image"), stretched)
    none = F.lit(None).cast("string").alias("concern")
    made = writer.write_objects(capture(drawn.filter("concern is null"))).select("instance_id", "content", none)
    failed = drawn.filter("concern is not null").select("instance_id", F.col("bytes").alias("content"), "concern")
    passed = of("unknown").select("instance_id", "content", F.lit("unknown kind of object").alias("concern"))
    return of("dicom").select("instance_id", "content", none).unionByName(made).unionByName(failed).unionByName(passed)
