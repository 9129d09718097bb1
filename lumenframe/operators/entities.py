"""Classification of objects and their module views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.dictionary import ENTITY_CLASSES, ENTITY_MODALITIES, KEYWORDS
from lumenframe.functions.dicom import clean, ds_values, image_bytes, is_values, last_value, photometric
from lumenframe.operators.objects import value_of
from lumenframe.operators.select import Selection, pivot_first
from lumenframe.sources.rows import object_rows

ENTITIES = (*ENTITY_CLASSES, "WorklistItem", "Image")


def entity_kind(sop_class: Column, modality: Column, worklist: Column) -> Column:
    """The first kind, in order of priority, whose SOP class or modality fits; then worklist items; else images."""
    out = F.when(F.coalesce(worklist, F.lit(False)), "WorklistItem").otherwise("Image")
    for kind in reversed(ENTITY_CLASSES):
        fits = F.coalesce(sop_class.isin(*ENTITY_CLASSES[kind]), F.lit(False)) | F.coalesce(modality.isin(*ENTITY_MODALITIES[kind]), F.lit(False))
        out = F.when(fits, kind).otherwise(out)
    return out


_WORKLIST = ("ScheduledProcedureStepSequence", "RequestedProcedureID")
#: All tags that the classification reads.
NEEDED = frozenset(KEYWORDS[t] for t in ("SOPClassUID", "Modality", *_WORKLIST))


def classify(elements: DataFrame) -> DataFrame:
    """instance_id, entity_kind of element rows; objects with data set elements only."""
    held = elements.filter("depth = 0 and not is_meta")
    slim = held.select("instance_id", "ordinal", F.when(F.col("tag").isin(*NEEDED), F.col("tag")).alias("tag"), "depth", F.when(F.col("tag").isin(*NEEDED), F.col("str")).alias("str"))
    first = slim.groupBy("instance_id", "tag").agg(F.min_by(F.struct("depth", "str"), "ordinal").alias("e"), F.min("ordinal").alias("ordinal"))
    return classify_objects(object_rows(first.select("instance_id", "ordinal", "tag", "e.*")))


def classify_objects(parsed: DataFrame) -> DataFrame:
    """instance_id, entity_kind of whole parsed objects."""
    worklist = F.exists("elements", lambda e: (e["depth"] == 0) & e["tag"].isin(*(KEYWORDS[t] for t in _WORKLIST)))
    first = lambda t: clean(value_of(KEYWORDS[t]))
    return parsed.filter("error_message is null").select("instance_id", entity_kind(first("SOPClassUID"), first("Modality"), worklist).alias("entity_kind"))


# The elements of each module view.
MODULES = {
    "patient": ("PatientName", "PatientID", "IssuerOfPatientID", "PatientBirthDate", "PatientSex", "PatientAge", "PatientSize", "PatientWeight"),
    "general_series": ("Modality", "SeriesInstanceUID", "SeriesNumber", "SeriesDate", "SeriesTime", "SeriesDescription", "BodyPartExamined", "Laterality", "PatientPosition"),
    "image_pixel": ("SamplesPerPixel", "PhotometricInterpretation", "Rows", "Columns", "BitsAllocated", "BitsStored", "HighBit", "PixelRepresentation", "PlanarConfiguration"),
    "image_plane": ("PixelSpacing", "ImageOrientationPatient", "ImagePositionPatient", "SliceThickness", "SliceLocation"),
    "modality_lut": ("RescaleIntercept", "RescaleSlope", "RescaleType"),
    "voi": ("WindowCenter", "WindowWidth"),
    "multi_frame": ("NumberOfFrames", "FrameIncrementPointer", "FrameTime"),
    "structured_report": ("CompletionFlag", "VerificationFlag", "ContentDate", "ContentTime"),
    "presentation_state": ("ContentLabel", "ContentDescription", "ContentCreatorName"),
    "encapsulated_document": ("DocumentTitle", "MIMETypeOfEncapsulatedDocument", "EncapsulatedDocumentLength"),
    "requested_procedure": ("RequestedProcedureID", "RequestedProcedureDescription"),
    "scheduled_procedure_step": ("ScheduledStationAETitle", "ScheduledProcedureStepStartDate", "ScheduledProcedureStepStartTime", "ScheduledPerformingPhysicianName", "ScheduledProcedureStepDescription", "ScheduledProcedureStepID", "ScheduledStationName", "ScheduledProcedureStepLocation"),
}
_INTEGERS = frozenset("SamplesPerPixel Rows Columns BitsAllocated BitsStored HighBit PixelRepresentation PlanarConfiguration NumberOfFrames SeriesNumber EncapsulatedDocumentLength".split())
_DECIMALS = frozenset("RescaleIntercept RescaleSlope WindowCenter WindowWidth SliceThickness SliceLocation FrameTime PatientSize PatientWeight".split())
_LISTS = frozenset("PixelSpacing ImageOrientationPatient ImagePositionPatient".split())


def modules(elements: DataFrame, *names: str) -> DataFrame:
    """instance_id and a struct column per module (all by default), typed: one pass over the elements."""
    names = names or tuple(MODULES)
    tags = tuple(dict.fromkeys(t for n in names for t in MODULES[n]))
    nested = [KEYWORDS[t] for t in MODULES["scheduled_procedure_step"]] if "scheduled_procedure_step" in names else []
    rows = pivot_first(elements.filter((F.col("depth") == 0) | F.col("tag").isin(*nested)), Selection(*tags))

    def typed(t: str) -> Column:
        c = F.col(t)
        if t in _INTEGERS:
            return last_value(is_values(c))
        if t in _DECIMALS:
            return last_value(ds_values(c))
        if t in _LISTS:
            return ds_values(c)
        return photometric(c) if t == "PhotometricInterpretation" else clean(c)

    structs = []
    for n in names:
        fields = [typed(t).alias(t) for t in MODULES[n]]
        if n == "image_pixel":
            fields.append(image_bytes(typed("Rows"), typed("Columns"), F.coalesce(typed("SamplesPerPixel"), F.lit(1)), typed("BitsAllocated")).alias("ImageBytes"))
        structs.append(F.struct(*fields).alias(n))
    return rows.select("instance_id", *structs)


def segments(elements: DataFrame) -> DataFrame:
    """instance_id, number, label, algorithm_type, algorithm_name of each segment item."""
    return _items(elements, "SegmentSequence", {"number": "SegmentNumber", "label": "SegmentLabel", "algorithm_type": "SegmentAlgorithmType", "algorithm_name": "SegmentAlgorithmName"})


def waveform_groups(elements: DataFrame) -> DataFrame:
    """instance_id, channels, samples, frequency, data_length of each multiplex group."""
    return _items(elements, "WaveformSequence", {"channels": "NumberOfWaveformChannels", "samples": "NumberOfWaveformSamples", "frequency": "SamplingFrequency"}, {"data_length": "WaveformData"})


def evidence(elements: DataFrame) -> DataFrame:
    """instance_id, study_uid, series_uid, sop_class, sop_instance of each object that a key object selection names."""
    ref = KEYWORDS["CurrentRequestedProcedureEvidenceSequence"]
    inside = elements.filter((F.col("depth") > 0) & (F.get("path", F.lit(0))["tag"] == ref))
    level = lambda n: F.array_join(F.transform(F.slice("path", 1, n), lambda p: F.concat(p["tag"], F.lit("["), p["item"].cast("string"), F.lit("]/"))), "")
    at = lambda keyword, depth, name: inside.filter((F.col("tag") == KEYWORDS[keyword]) & (F.col("depth") == depth)).select("instance_id", level(depth).alias(f"_p{depth}"), F.col("str").alias(name))
    sops = inside.filter(F.col("depth") == 3).groupBy("instance_id", level(1).alias("_p1"), level(2).alias("_p2"), level(3).alias("_p3")).agg(
        F.max(F.when(F.col("tag") == KEYWORDS["ReferencedSOPClassUID"], F.col("str"))).alias("sop_class"), F.max(F.when(F.col("tag") == KEYWORDS["ReferencedSOPInstanceUID"], F.col("str"))).alias("sop_instance")
    )
    return sops.join(at("SeriesInstanceUID", 2, "series_uid"), ["instance_id", "_p2"], "left").join(at("StudyInstanceUID", 1, "study_uid"), ["instance_id", "_p1"], "left").select("instance_id", "study_uid", "series_uid", "sop_class", "sop_instance")


def _items(elements: DataFrame, sequence: str, fields: dict[str, str], lengths: dict[str, str] | None = None) -> DataFrame:
    inside = elements.filter((F.col("depth") == 1) & (F.get("path", F.lit(0))["tag"] == KEYWORDS[sequence]))
    picked = [F.min_by("str", F.when(F.col("tag") == KEYWORDS[t], F.col("ordinal"))).alias(n) for n, t in fields.items()]
    picked += [F.min_by("value_length", F.when(F.col("tag") == KEYWORDS[t], F.col("ordinal"))).alias(n) for n, t in (lengths or {}).items()]
    return inside.groupBy("instance_id", F.get("path", F.lit(0))["item"].alias("item")).agg(*picked)
