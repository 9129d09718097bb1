"""Frames of objects: extraction, transcoding, redaction and pictures, in Arrow batches of whole frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe import arrow
from lumenframe.dictionary import KEYWORDS, TRANSFER_SYNTAXES
from lumenframe.operators.objects import facts, value_of
from lumenframe.operators.select import Selection, frame_indexes
from lumenframe.pixels import codecs, redact
from lumenframe.sources.kinds import format_of
from lumenframe.sources.rows import object_rows

_READ = ("Rows", "Columns", "SamplesPerPixel", "BitsAllocated", "BitsStored", "PixelRepresentation", "PhotometricInterpretation", "PlanarConfiguration", "NumberOfFrames", "RescaleSlope", "RescaleIntercept", "WindowCenter", "WindowWidth", "Modality")
FRAME = "instance_id string, frame_index int, transfer_syntax_uid string, rows int, columns int, samples int, allocated int, stored int, signed boolean, photometric string, planar int, slope double, intercept double, center double, width double, modality string, palette binary, palette_first int, palette_bits int, bytes binary, concern string"


_PALETTES = [(part + color + "PaletteColorLookupTable" + end, field, alias + color) for color in ("Red", "Green", "Blue") for part, end, field, alias in (("", "Descriptor", "ints", "descriptor"), ("", "Data", "bin", "plain"), ("Segmented", "Data", "bin", "segmented"))]
#: All tags that frames are made of.
NEEDED = frozenset(KEYWORDS[n] for n in (*_READ, "PixelData", *(n for n, _, _ in _PALETTES)))


def _expanded(r) -> tuple[bytes | None, int, int]:
    """(red, green and blue tables of equal length as 16-bit values, first value mapped, bits of an entry)."""
    tables, first, bits = [], 0, 16
    for color in ("Red", "Green", "Blue"):
        descriptor, plain, segmented = getattr(r, "descriptor" + color), getattr(r, "plain" + color), getattr(r, "segmented" + color)
        if descriptor is None or len(descriptor) < 3 or (plain is None and segmented is None):
            raise codecs.CodecError("palette image without lookup tables")
        entries, first, bits = (int(x) for x in descriptor[:3])
        tables.append(codecs.expand_palette(bytes(plain if segmented is None else segmented), entries or 65536, bits, segmented is not None))
    if min(map(len, tables)) == 0:
        raise codecs.CodecError("palette without entries")
    return np.stack([t[: min(map(len, tables))] for t in tables]).astype("<u2").tobytes(), first, bits


def extract_frames(elements: DataFrame, selector: str | list[int] | dict = "all") -> DataFrame:
    """Frames of element rows, which are first put together as objects by a shuffle of the tags that frames need."""
    return object_frames(object_rows(elements.filter((F.col("depth") == 0) & F.col("tag").isin(*NEEDED))), selector)


_SCHEMA = arrow.schema_of(FRAME)
FRAME_NAMES = tuple(_SCHEMA.names)


def frame_facts(parsed: DataFrame, selector: str | list[int] | dict = "all", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per whole object with everything its frames are cut and drawn by; pixels is null for objects without any."""
    num = lambda c, kind, d: F.coalesce(F.element_at(F.split(c, r"\\"), -1 if kind == "int" else 1).try_cast(kind), F.lit(d).cast(kind)).alias(c)
    n = F.coalesce(F.trim("NumberOfFrames").try_cast("int"), F.lit(1))
    held = ("instance_id", "transfer_syntax_uid", "pixels", *keep, *(alias for _, _, alias in _PALETTES))
    known = parsed.select("*", value_of(KEYWORDS["PixelData"], "bin").alias("pixels"), *(value_of(KEYWORDS[name], field).alias(alias) for name, field, alias in _PALETTES))
    return facts(known, Selection(*_READ), held).select(
        *held, num("Rows", "int", 0), num("Columns", "int", 0), num("SamplesPerPixel", "int", 1), num("BitsAllocated", "int", 8), num("BitsStored", "int", None), num("PixelRepresentation", "int", 0),
        F.coalesce("PhotometricInterpretation", F.lit("MONOCHROME2")).alias("photometric"), num("PlanarConfiguration", "int", 0), num("RescaleSlope", "double", 1.0), num("RescaleIntercept", "double", 0.0), num("WindowCenter", "double", None), num("WindowWidth", "double", None),
        F.coalesce("Modality", F.lit("")).alias("modality"), n.alias("n"), frame_indexes(n, selector).alias("wanted"),
    )


def frames_of(r) -> list[tuple]:
    """The frame rows (FRAME) of a row of `frame_facts`."""
    stored = r.BitsAllocated if r.BitsStored is None else int(r.BitsStored)
    im = codecs.Image(int(r.Rows), int(r.Columns), int(r.SamplesPerPixel), int(r.BitsAllocated), stored)
    head = (r.instance_id, r.transfer_syntax_uid, im.rows, im.columns, im.samples, im.allocated, stored, bool(r.PixelRepresentation), r.photometric, int(r.PlanarConfiguration), r.RescaleSlope, r.RescaleIntercept, r.WindowCenter, r.WindowWidth, r.modality)
    out, palette = [], (None, 0, 16)
    try:
        palette = _expanded(r) if r.photometric == "PALETTE COLOR" else palette
        raw = bytes(r.pixels or b"")
        packed = TRANSFER_SYNTAXES.get(r.transfer_syntax_uid)
        all_frames = codecs.frames_of(raw, int(r.n)) if packed and packed.compressed else [raw[i * im.frame_bytes : (i + 1) * im.frame_bytes] for i in range(int(r.n))]
        for i in r.wanted:
            if i < len(all_frames):
                short = not (packed and packed.compressed) and len(all_frames[i]) < im.frame_bytes
                out.append((head[0], int(i), *head[1:], *palette, all_frames[i], "frame is cut off" if short else None))
    except (ValueError, IndexError, struct.error) as e:  # damaged tables fail in many ways
        out.append((head[0], -1, *head[1:], *palette, None, str(e)))
    return out


#: What stands in the place of a tag in an object that is no image: its message, and its bytes if they are kept.
LOST = "LOSTFILE"


def _lost(r) -> tuple:
    """The frame row of an object that is no image."""
    empty = (None,) * 18 if r.kept is not None else ("1.2.840.10008.1.2.1", 0, 0, 1, 8, 8, False, "MONOCHROME2", 0, 1.0, 0.0, None, None, "OT", None, 0, 16, None)
    return (r.instance_id, -1, *(empty[:17]), r.kept, r.lost)


def object_frames(parsed: DataFrame, selector: str | list[int] | dict = "all") -> DataFrame:
    """One row per selected frame of whole parsed objects with what its bytes mean; objects that cannot be divided give one row with a concern."""
    with_pixels = parsed.filter(F.exists("elements", lambda e: e["tag"].isin(KEYWORDS["PixelData"], LOST) & (e["depth"] == 0)))
    held = with_pixels.select("*", value_of(LOST).alias("lost"), value_of(LOST, "bin").alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow.batches_of((row for r in arrow.rows_of(batches) for row in ([_lost(r)] if r.lost is not None else frames_of(r))), _SCHEMA)

    return frame_facts(held, selector, ("lost", "kept")).mapInArrow(run, FRAME)


def _image(r) -> codecs.Image:
    none = lambda v: None if v is None or v != v else float(v)  # noqa: E731, a window that is no number is none
    im = codecs.Image(int(r.rows), int(r.columns), int(r.samples), int(r.allocated), int(r.stored), bool(r.signed), r.photometric, int(r.planar), float(r.slope), float(r.intercept), none(r.center), none(r.width), r.modality)
    if r.palette is not None:
        im.palette = tuple(np.frombuffer(r.palette, "<u2").reshape(3, -1).astype(np.int64))
        im.palette_first, im.palette_bits = int(r.palette_first), int(r.palette_bits)
    return im


def _each(frames: DataFrame, change, hold_back: bool = False) -> DataFrame:
    """change(row, image) -> dict of new values; a codec error is kept as the row's concern, and with hold_back the frame's bytes are not."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for r in arrow.rows_of(batches):
            new: dict = {}
            if r.bytes is not None:
                try:
                    new = change(r, _image(r))
                except (codecs.CodecError, redact.RegionError) as e:
                    new = {"concern": str(e)} | ({"bytes": None} if hold_back else {})
            yield [new[n] if n in new else v for n, v in zip(FRAME_NAMES, r, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow.batches_of(each(batches), _SCHEMA)

    return frames.select(*FRAME_NAMES).mapInArrow(run, FRAME)


def _facts(im: codecs.Image) -> dict:
    """Columns that follow an image; decoded frames have full colour resolution."""
    photometric = "YBR_FULL" if im.photometric == "YBR_FULL_422" else im.photometric
    spent = {"palette": None} if im.palette is None else {}
    return {**spent, "samples": im.samples, "allocated": im.allocated, "stored": im.stored, "signed": im.signed, "photometric": photometric, "planar": im.planar, "slope": im.slope, "intercept": im.intercept, "center": im.center, "width": im.width}


def transcode(frames: DataFrame, target: str, fallback: str = "passthrough", registry: codecs.Registry | None = None) -> DataFrame:
    """Frames in another transfer syntax. Without a codec: passthrough (with a concern), skip (dropped) or fail. Frames with other concerns stay."""
    if fallback not in ("passthrough", "skip", "fail"):
        raise ValueError("fallback is passthrough, skip or fail")
    known = registry or codecs.Registry()

    def change(r, im: codecs.Image) -> dict:
        if r.transfer_syntax_uid == target:
            return {}
        if not known.converts(r.transfer_syntax_uid, target):
            if fallback == "fail":
                raise ValueError(f"no codec from {r.transfer_syntax_uid} to {target}")
            return {"concern": f"{codecs.NO_CODEC} from {r.transfer_syntax_uid} to {target}"}
        native = known.decode(r.transfer_syntax_uid, bytes(r.bytes), im)
        if target == codecs.JPEG_BASELINE:
            native, im = codecs.eight_bit(native, im)
        return {"bytes": known.encoders[target](native, im), "transfer_syntax_uid": target, **_facts(im)}

    out = _each(frames, change)
    return out.filter(~F.coalesce(F.startswith("concern", F.lit(codecs.NO_CODEC)), F.lit(False))) if fallback == "skip" else out


def redact_frames(frames: DataFrame, regions: list[dict] | None = None, mode: str = "pixel", action: str = "black", constant: int = 0, detect: bool = False, registry: codecs.Registry | None = None) -> DataFrame:
    """Native frames with regions (given, or detected text) filled in their own depth; the result is native. A frame that cannot be redacted has null bytes and a concern."""
    if action not in ("black", "white", "constant"):
        raise ValueError("action is black, white or constant")
    known = registry or codecs.Registry()

    def change(r, im: codecs.Image) -> dict:
        native = known.decode(r.transfer_syntax_uid, bytes(r.bytes), im)
        found = redact.boxes(regions or [], im.columns, im.rows, mode)
        if detect:
            found += redact.text_regions(codecs.rgba(native, im))
        facts = {"transfer_syntax_uid": _native(r.transfer_syntax_uid), **_facts(im)}
        if found and im.allocated not in (8, 16):
            raise codecs.CodecError(f"samples of {im.allocated} bits cannot be filled")
        if not found:
            return {"bytes": native, **facts}
        dark, light = (-(1 << (im.stored - 1)), (1 << (im.stored - 1)) - 1) if im.signed else (0, (1 << im.stored) - 1)
        value = constant if action == "constant" else (light if (action == "white") != (im.photometric == "MONOCHROME1") else dark)
        if im.samples == 3 and im.photometric.startswith("YBR"):  # grey: no colour difference
            value = (value, 1 << (im.stored - 1), 1 << (im.stored - 1))
        px = codecs.samples_of(native, im)
        px = redact.fill(px, found, value) & ((1 << im.stored) - 1)
        px = px.transpose(2, 0, 1) if im.samples > 1 and im.planar == 1 else px
        return {"bytes": px.astype(f"<u{im.allocated // 8}").tobytes(), **facts}

    return _each(frames, change, hold_back=True)


def redact_images(objects: DataFrame, regions: list[dict] | None = None, mode: str = "pixel", action: str = "black", constant: int = 0, detect: bool = False) -> DataFrame:
    """instance_id, format, content, concern: PNG, TIFF and JPEG files with regions (given, or detected text) filled, in their own format (JPEG pictures are coded anew as baseline ones).

    What cannot be decoded (lossless JPEG, damaged files, null content) has null content and a concern, so no unredacted file passes.
    """
    if action not in ("black", "white", "constant"):
        raise ValueError("action is black, white or constant")
    value = {"black": 0, "white": 255, "constant": constant}[action]
    known = {"png": (codecs.png_decode, codecs.png_encode), "tiff": (codecs.tiff_decode, codecs.tiff_encode), "jpeg": (codecs.jpeg_picture, codecs.jpeg_file)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for r in arrow.rows_of(batches):
            content, concern = None, None
            if r.format not in known:
                concern = f"no codec for {r.format}"
            else:
                decode, encode = known[r.format]
                try:
                    picture = decode(r.content)
                    found = redact.boxes(regions or [], picture.shape[1], picture.shape[0], mode)
                    content = encode(redact.fill(picture, found + (redact.text_regions(picture) if detect else []), value))
                except Exception as e:  # damaged bytes fail in many ways; the object's concern says how
                    concern = f"{type(e).__name__}: {e}"
            yield r.instance_id, r.format, content, concern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow.batches_of(each(batches), arrow.schema_of(_REDACTED))

    return objects.select("instance_id", format_of(F.col("content")).alias("format"), "content").mapInArrow(run, _REDACTED)


_REDACTED = "instance_id string, format string, content binary, concern string"


def _native(uid: str) -> str:
    known = TRANSFER_SYNTAXES.get(uid)
    return "1.2.840.10008.1.2.1" if known is None or known.compressed or not known.little else uid


def picture_of(r, kind: str, registry: codecs.Registry) -> bytes:
    """A frame row as a picture; raises CodecError."""
    im = _image(r)
    return registry.pictures[kind](codecs.rgba(registry.decode(r.transfer_syntax_uid, bytes(r.bytes), im), im))


def pictures(frames: DataFrame, kind: str = "png", registry: codecs.Registry | None = None) -> DataFrame:
    """instance_id, frame_index, kind, content, concern: frames as png, tiff, jpeg or raw RGBA pictures, or of a kind of the registry's own."""
    known = registry or codecs.Registry()
    if kind not in known.pictures:
        raise ValueError(f"kind is one of {tuple(known.pictures)}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for r in arrow.rows_of(batches):
            content, concern = None, r.concern
            try:
                content = picture_of(r, kind, known)
            except (codecs.CodecError, TypeError) as e:
                concern = concern or str(e)
            yield r.instance_id, r.frame_index, kind, content, concern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow.batches_of(each(batches), arrow.schema_of(_PICTURE))

    return frames.mapInArrow(run, _PICTURE)


_PICTURE = "instance_id string, frame_index int, kind string, content binary, concern string"


def stretch(picture: np.ndarray) -> np.ndarray:
    """Grey levels stretched to the full range, unless they are one level or span 192 or more."""
    lo, hi = int(picture.min()), int(picture.max())
    return picture if hi == lo or hi - lo >= 192 else ((picture.astype(np.int64) - lo) * 255 // (hi - lo)).astype(np.uint8)
