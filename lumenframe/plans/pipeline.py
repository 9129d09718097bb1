"""A fluent builder whose stages compile to one lazy DataFrame plan.

Filters run in a fixed order whatever the order of the calls: validation on what
was read, then de-identification, then pixels, then the target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import assets, deid, entities, fhir, frames, normalize, validate
from lumenframe.operators.mapping import Mapping
from lumenframe.operators.select import Selection, select_elements
from lumenframe.pixels.codecs import Registry
from lumenframe.plans import outputs
from lumenframe.schema import ELEMENT_NAMES
from lumenframe.sinks import packages
from lumenframe.sinks import part10 as writer
from lumenframe.sources import metadata, objects, part10
from lumenframe.sources.rows import custom_objects, element_rows, object_rows

ELEMENT_FORMATS = ("dicom", "dicom-json", "dicom-xml", "custom")
FORMATS = (*ELEMENT_FORMATS, "bytes", "image", "imaging", "json", "xml")


class BuildError(ValueError):
    """A pipeline whose stages do not fit together; code says what is wrong, for programs."""

    def __init__(self, message: str, code: str = "InvalidBuildState"):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Pipeline:
    """Immutable; each call gives a new pipeline, `build` the plan."""

    spark: SparkSession
    source: Callable[[], DataFrame] | None = None
    format: str | None = None
    parser: Callable[[str, bytes], Iterable[dict]] | None = None
    options: part10.Options = part10.Options()
    goal: str | None = None
    mask: deid.Mask | None = None
    consistent_uids: bool = False
    pixels: tuple[Callable[[DataFrame, Registry | None], DataFrame], ...] = ()
    normalization: dict[str, Any] | None = None
    handlers: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    codecs: Registry | None = None
    progress: Observation | None = None
    target: str | None = None
    argument: Any = None

    # sources
    def from_folder(self, path: str, **options: Any) -> Pipeline:
        return replace(self, source=lambda: objects.read_folder(self.spark, path, **options))

    def from_file(self, path: str) -> Pipeline:
        return replace(self, source=lambda: objects.read_folder(self.spark, path, recursive=False, hidden=True))

    def from_folder_watch(self, path: str, **options: Any) -> Pipeline:
        return replace(self, source=lambda: objects.watch_folder(self.spark, path, **options))

    def from_bytes(self, items: list[tuple[str, bytes]], content_type: str | None = None) -> Pipeline:
        return replace(self, source=lambda: objects.from_bytes(self.spark, items, content_type))

    def from_parts(self, items: list[tuple[str, bytes]], content_type: str) -> Pipeline:
        return replace(self, source=lambda: objects.demux(objects.from_bytes(self.spark, items, content_type)))

    def from_http(self, urls: list[str], **options: Any) -> Pipeline:
        return replace(self, source=lambda: objects.demux(objects.read_http(self.spark, urls, **options)))

    def from_dicomweb(self, base: str, mode: str = "qido-search", timeout: float = 30.0, each: Sequence[dict] = ({},), **query: Any) -> Pipeline:
        """each: a request for every dict of UIDs, level or query, besides what they all share."""
        return self.from_http([objects.dicomweb_url(base, mode, **query, **one) for one in each], accept=objects.ACCEPT[mode], timeout=timeout)

    def from_reader(self, read: Callable[[SparkSession], DataFrame]) -> Pipeline:
        return replace(self, source=lambda: read(self.spark))

    # formats
    def of(self, fmt: str, options: part10.Options | None = None) -> Pipeline:
        if fmt not in FORMATS or fmt == "custom":
            raise BuildError(f"unknown format {fmt!r}", "InvalidParser")
        return replace(self, format=fmt, options=options or self.options)

    def of_parser(self, parse: Callable[[str, bytes], Iterable[dict]]) -> Pipeline:
        """A format of the user's own: a function of (instance, bytes) that gives its elements."""
        return replace(self, format="custom", parser=parse)

    # transforms
    def with_bulk_policy(self, policy: str) -> Pipeline:
        if policy not in ("materialize", "auto", "stream"):
            raise BuildError(f"unknown bulk policy {policy!r}")
        return replace(self, options=replace(self.options, bulk=policy))

    def with_validation(self, goal: str = "permissive") -> Pipeline:
        if goal not in ("permissive", "strict"):
            raise BuildError(f"unknown validation goal {goal!r}")
        return replace(self, goal=goal)

    def with_deidentification(self, mask: deid.Mask | None = None, consistent_uids: bool = False) -> Pipeline:
        return replace(self, mask=mask or deid.Mask.default(), consistent_uids=consistent_uids)

    def with_codecs(self, registry: Registry) -> Pipeline:
        """The codecs of all pixel filters and pictures, wherever in the chain this is called."""
        return replace(self, codecs=registry)

    def with_transcoding(self, target: str, fallback: str = "passthrough") -> Pipeline:
        return replace(self, pixels=(*self.pixels, lambda df, known: frames.transcode(df, target, fallback, known)))

    def with_burned_in_redaction(self, **options: Any) -> Pipeline:
        return replace(self, pixels=(*self.pixels, lambda df, known: frames.redact_frames(df, **options, registry=known)))

    def with_normalization(self, mode: str = "frames", unknown: str = "fail", stretched: bool = False) -> Pipeline:
        if mode not in ("frames", "dicom") or unknown not in ("fail", "passthrough"):
            raise BuildError("mode is frames or dicom, unknown is fail or passthrough")
        return replace(self, normalization={"mode": mode, "unknown": unknown, "stretched": stretched})

    def with_progress(self, progress: Observation) -> Pipeline:
        """Counters of what is read, known to the observation after the first action: objects, failed, elements, value_bytes."""
        return replace(self, progress=progress)

    def with_handler(self, handler: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return replace(self, handlers=(*self.handlers, handler))

    # targets
    def _to(self, target: str, argument: Any = None) -> Pipeline:
        if self.target is not None:
            raise BuildError(f"the target is {self.target} already")
        return replace(self, target=target, argument=argument)

    def to_elements(self) -> Pipeline:
        return self._to("elements")

    def to_instances(self) -> Pipeline:
        return self._to("instances")

    def to_entities(self) -> Pipeline:
        return self._to("entities")

    def to_selection(self, selection: Selection) -> Pipeline:
        return self._to("selection", selection)

    def to_mapping(self, mapping: Mapping) -> Pipeline:
        return self._to("mapping", mapping)

    def to_imaging_study(self, profile: str = "full", subject: str | dict = "contained", endpoints: dict | None = None, templates: dict | None = None) -> Pipeline:
        return self._to("imaging_study", (profile, subject, endpoints, templates))

    def to_dicom(self, syntax: str | None = None) -> Pipeline:
        return self._to("dicom", syntax)

    def to_frames(self, selector: Any = "all") -> Pipeline:
        return self._to("frames", selector)

    def to_pictures(self, kind: str = "png", selector: Any = "all") -> Pipeline:
        return self._to("pictures", (kind, selector))

    def to_documents(self) -> Pipeline:
        return self._to("documents")

    def to_wrapped_documents(self, mime_type: str | None = None, title: str | None = None) -> Pipeline:
        """Objects of documents (the bytes and json formats): mime_type and title, where the source does not tell."""
        return self._to("wrapped", (mime_type, title))

    def to_assets(self, mapping: Mapping | None = None, selector: Any = "all", encode: str = "png") -> Pipeline:
        return self._to("assets", (mapping, selector, encode))

    def to_asset_archive(self, mapping: Mapping | None = None, selector: Any = "all", encode: str = "png", manifest: bool = True) -> Pipeline:
        return self._to("archive", (mapping, selector, encode, manifest))

    def to_structured_value(self) -> Pipeline:
        return self._to("structured")

    def to_objects(self) -> Pipeline:
        return self._to("objects")

    # outputs
    def _into(self, sink: Callable[[DataFrame], DataFrame]) -> outputs.Output:
        return outputs.Output(self.build(), sink)

    def into_byte_buffer(self) -> outputs.Output:
        """instance_id, file_name, content of every payload."""
        return self._into(lambda df: outputs.payloads(df, self.target))

    def into_part_buffer(self, content_type: str = "application/dicom", boundary: str = "lumenframe-part", per_body: int = 1000) -> outputs.Output:
        """Multipart bodies of the payloads."""
        return self._into(lambda df: outputs.to_parts(df, self.target, content_type, boundary, per_body))

    def into_files(self, folder: str) -> outputs.Output:
        """A file for every payload."""
        return self._into(lambda df: outputs.to_files(df, folder, self.target))

    def into_table(self, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> outputs.Output:
        """The target's rows as a table; the answer is its row count."""

        def write(df: DataFrame) -> DataFrame:
            df.write.format(fmt).mode(mode).save(path)
            return self.spark.read.format(fmt).load(path).agg(F.count(F.lit(1)).alias("n"))

        return self._into(write)

    def into_http(self, url: str, method: str = "POST", content_type: str = "application/dicom", per_body: int = 1000, **options: Any) -> outputs.Output:
        """Multipart bodies sent to a store; status and answer of each."""
        return self._into(lambda df: packages.send_http(outputs.to_parts(df, self.target, content_type, "lumenframe-part", per_body), url, method, **options))

    def into_writer(self, write: Callable) -> outputs.Output:
        """A writer of (file name, bytes) pairs on the executors, called for each partition."""
        return self._into(lambda df: outputs.to_writer(df, write, self.target))

    def check(self) -> None:
        """Raises BuildError unless source, format, filters and target fit."""
        if self.source is None:
            raise BuildError("no source", "InvalidReader")
        if self.format is None:
            raise BuildError("no format", "MissingParser")
        if self.target is None:
            raise BuildError("no target", "MissingHandler")
        elementwise = self.format in ELEMENT_FORMATS
        if self.target == "structured" and self.format not in ("json", "xml"):
            raise BuildError("structured values need json or xml", "IncompatibleParserAndHandler")
        if self.normalization:
            if self.format != "imaging":
                raise BuildError("normalisation needs the imaging format", "IncompatibleNormalizationAndParser")
            if self.target not in (("frames", "pictures") if self.normalization["mode"] == "frames" else ("objects",)):
                raise BuildError("normalisation gives frames or pictures, or with mode dicom objects")
        elif self.target == "wrapped":
            if self.format not in ("bytes", "json"):
                raise BuildError("documents to wrap are bytes or json", "IncompatibleParserAndHandler")
        elif self.target not in ("objects", "structured") and not elementwise:
            raise BuildError(f"{self.target} needs a format of elements, not {self.format}", "IncompatibleParserAndHandler")
        if (self.goal or self.mask) and not elementwise:
            raise BuildError("validation and de-identification need elements", "IncompatibleDeIdentificationAndParser" if self.mask else "IncompatibleValidationAndParser")
        if (self.pixels or self.target in ("frames", "pictures", "dicom", "assets", "archive")) and self.format != "dicom" and not self.normalization:
            raise BuildError("frames and binary objects need the dicom format", "IncompatibleTranscodingAndParser" if self.pixels else "IncompatibleParserAndHandler")
        if self.pixels and self.target not in ("frames", "pictures"):
            raise BuildError("pixel filters need frames or pictures as the target", "IncompatibleTranscodingAndParser")

    def _wanted(self) -> frozenset[str] | None:
        """The tags that the target reads (None: all). Objects are walked to their end all the same, as one that is cut off fails."""
        return None if self.goal or self.handlers else self._used()

    def _used(self) -> frozenset[str] | None:
        """The tags that the target itself reads (None: all)."""
        if self.target == "selection":  # also of elements inside later sequences
            return frozenset(self.argument.tags)
        if self.target == "mapping":
            return frozenset(self.argument.needed_tags())
        if self.target in ("assets", "archive"):
            return assets.needed(self.argument[0])
        return {"imaging_study": fhir.NEEDED, "entities": entities.NEEDED, "documents": packages.DOCUMENT_TAGS, "frames": frames.NEEDED, "pictures": frames.NEEDED}.get(self.target)

    def _read(self, source: DataFrame, options: part10.Options) -> DataFrame:
        if self.format == "dicom":
            return part10.read_objects(source, options)
        if self.format == "custom":
            return custom_objects(source, self.parser)
        text = source.withColumn("text", F.col("content").cast("string"))
        return (metadata.read_json_objects if self.format == "dicom-json" else metadata.read_xml_objects)(text, "text")

    def parsed(self) -> DataFrame:
        """Whole objects (schema.PARSED) after validation, de-identification and handlers. Each object is read and parsed once, whatever the target."""
        options = replace(self.options, wanted=self._wanted())
        if options.bulk == "auto" and self.target in ("frames", "pictures", "documents", "dicom", "assets", "archive"):
            options = replace(options, bulk="materialize")  # these targets are made of the bytes
        found = self._read(self.source(), options)
        if self.progress is not None:
            length = F.aggregate("elements", F.lit(0).cast("long"), lambda n, e: n + F.when(e["value_length"].between(0, (1 << 32) - 2), e["value_length"]).otherwise(F.lit(0)))
            found = found.observe(self.progress, F.count(F.lit(1)).alias("objects"), F.count("error_message").alias("failed"), F.sum(F.size("elements")).alias("elements"), F.sum(length).alias("value_bytes"))
        if self.goal == "strict":
            found = validate.strict_objects(validate.object_concerns(found))
        if self.mask is not None:
            found = deid.deidentify_objects(found, self.mask, self.consistent_uids)
        if self.handlers:
            rows = element_rows(found, "seen").filter("ordinal >= 0")
            for handler in self.handlers:
                rows = handler(rows)
            found = object_rows(rows, self._used())  # handlers may read any element, the target not
        return found

    def elements(self) -> DataFrame:
        return element_rows(self.parsed()).filter("ordinal >= 0")

    def concerns(self) -> DataFrame:
        """All validation concerns of what the source gives, in its format."""
        if self.source is None or self.format not in ELEMENT_FORMATS:
            raise BuildError("concerns need a source and a format of elements")
        return validate.concern_rows(validate.object_concerns(self._read(self.source(), self.options)))

    def build(self) -> DataFrame:
        self.check()
        if self.target == "objects":
            return normalize.normalize(self.source(), **self.normalization) if self.normalization else self.source()
        if self.normalization:
            kind, selector = self.argument if self.target == "pictures" else (None, self.argument)
            if selector != "all":
                raise BuildError("normalised objects give all frames")
            out = normalize.normalize(self.source(), **self.normalization)
            for change in self.pixels:
                out = change(out, self.codecs)
            return frames.pictures(out, kind, self.codecs) if kind else out
        if self.target == "structured":
            text = self.source().select("instance_id", F.col("content").cast("string").alias("text"))
            return metadata.structured_values(text, self.format)
        if self.target == "wrapped":
            mime, title = self.argument
            given = F.lit(mime) if mime else F.coalesce("content_type", F.lit("application/json" if self.format == "json" else "application/octet-stream"))
            held = self.source().select("instance_id", given.alias("mime_type"), F.lit(title).cast("string").alias("title"), F.col("content").alias("bytes"))
            return writer.write_objects(packages.wrapped_objects(held))
        if self.target == "elements":
            return self.elements()
        if self.target == "selection":
            return select_elements(self.elements(), self.argument)
        found = self.parsed()
        if self.target == "instances":
            order = ("ordinal", *(c for c in ELEMENT_NAMES if c != "ordinal"))
            return found.filter("error_message is null").select("instance_id", F.transform("elements", lambda e: F.struct(*(e[c].alias(c) for c in order))).alias("elements"))
        if self.target == "entities":
            return entities.classify_objects(found)
        if self.target == "mapping":
            return self.argument.apply_objects(found)
        if self.target == "imaging_study":
            return fhir.imaging_study(fhir.object_records(found), *self.argument)
        if self.target == "dicom":
            return writer.write_objects(found, self.argument)
        if self.target == "documents":
            return packages.unwrap_objects(found)
        if self.target == "assets":
            return assets.assets(found, *self.argument, registry=self.codecs)
        if self.target == "archive":
            return assets.archives(found, *self.argument, registry=self.codecs)
        kind, selector = self.argument if self.target == "pictures" else (None, self.argument)
        out = frames.object_frames(found, selector)
        for change in self.pixels:
            out = change(out, self.codecs)
        return frames.pictures(out, kind, self.codecs) if kind else out
