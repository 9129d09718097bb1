"""Content kinds by media type, then by magic bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.dicom import mime

# First bytes of the formats (hex) and where they stand.
MAGIC = (("dicom", 129, "4449434D"), ("jpeg", 1, "FFD8FF"), ("png", 1, "89504E470D0A1A0A"), ("tiff", 1, "49492A00"), ("tiff", 1, "4D4D002A"))
MEDIA = {"application/dicom": "dicom", "image/jpeg": "jpeg", "image/jpg": "jpeg", "image/png": "png", "image/tiff": "tiff", "application/json": "json", "application/dicom+json": "dicom-json", "application/xml": "xml", "text/xml": "xml", "application/dicom+xml": "dicom-xml"}
IMAGES = ("jpeg", "png", "tiff")


def format_of(content: Column, content_type: Column | None = None) -> Column:
    out = F.lit("unknown")
    for name, at, magic in reversed(MAGIC):
        out = F.when(F.hex(F.substring(content, at, len(magic) // 2)) == magic, name).otherwise(out)
    if content_type is not None:
        table = F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv))
        out = F.coalesce(F.try_element_at(table, F.coalesce(mime(content_type), F.lit(""))), out)
    return out


def kind_of(fmt: Column) -> Column:
    """dicom, image or unknown."""
    return F.when(fmt.startswith("dicom"), "dicom").when(fmt.isin(*IMAGES), "image").otherwise("unknown")
