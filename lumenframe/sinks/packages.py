"""ZIP archives, multipart bodies and wrapped or unwrapped documents."""

from __future__ import annotations

import hashlib
import io
import json
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Collection, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe import arrow
from lumenframe.dictionary import EXPLICIT, KEYWORDS, SECONDARY_CAPTURE
from lumenframe.functions.dicom import deterministic_uid, document_bytes, mime_extension, mime_sop_class, safe_name
from lumenframe.operators.objects import value_of
from lumenframe.schema import ELEMENT_NAMES, ELEMENT_STRUCT, PATH
from lumenframe.sources.rows import object_rows, source_bytes

#: Bytes of source files whose objects a partition makes, where three partitions a core are too few.
PARTITION_BYTES = 4 << 20


def zip_by(objects: DataFrame, key: str, manifest: bool = True) -> DataFrame:
    """One archive per group of objects(key, instance_id, content[, content_type]): entries by name, with a manifest. A group has to fit in a task."""
    named = objects.withColumn("_name", F.concat(safe_name(F.col("instance_id")), F.lit("."), mime_extension(F.col("content_type"))) if "content_type" in objects.columns else F.concat(safe_name(F.col("instance_id")), F.lit(".dcm")))

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        pdf = pdf.sort_values(["_name", "instance_id"])
        entries = []
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            seen: dict[str, int] = {}
            for name, content, instance in zip(pdf["_name"], pdf["content"], pdf["instance_id"], strict=True):
                seen[name] = seen.get(name, 0) + 1
                entry = name if seen[name] == 1 else f"{seen[name]}_{name}"
                z.writestr(zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0)), bytes(content))
                entries.append({"name": entry, "instance_id": instance, "bytes": len(content)})
            if manifest:
                z.writestr(zipfile.ZipInfo("manifest.json", (1980, 1, 1, 0, 0, 0)), json.dumps({"entries": entries}))
        return pd.DataFrame({key: [k[0]], "archive": [out.getvalue()], "n_entries": [len(entries)]})

    return named.select(key, "instance_id", "_name", "content").groupBy(key).applyInPandas(run, f"{key} string, archive binary, n_entries long")


def _part_head(boundary: str, content_type: str) -> bytes:
    return f"--{boundary}\r\nContent-Type: {content_type}\r\n\r\n".encode()


def multipart_body(objects: DataFrame, boundary: str = "lumenframe-part", content_type: str = "application/dicom") -> DataFrame:
    """One multipart/related body of all objects of a batch_id, in order of instance_id; without Python. A body has to fit in a row; `multipart_pieces` and `multipart_digests` have no such limit."""
    crlf = "\r\n"
    head = F.concat(F.lit(_part_head(boundary, content_type)), F.col("content"), F.lit(crlf).cast("binary"))
    parts = F.array_sort(F.collect_list(F.struct("instance_id", head.alias("part"))))
    body = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["part"])), ""))  # one pass; appending would copy the body for each part
    return objects.groupBy("batch_id").agg(F.concat(body, F.lit(f"--{boundary}--{crlf}").cast("binary")).alias("body"), F.lit(f'multipart/related; boundary={boundary}; type="{content_type}"').alias("content_type"))


def _streamed(objects: DataFrame, boundary: str, content_type: str, over: Callable[[Iterator[tuple]], Iterator[Sequence]], schema: str) -> DataFrame:
    """over((batch_id, bytes, whether they end the body)) of the bodies of `multipart_body`, each streamed through one task in order: sorted on disk where it is large, and never held."""
    head, end = _part_head(boundary, content_type), f"--{boundary}--\r\n".encode()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        open_, batch_id = False, None
        for r in arrow.rows_of(batches):
            if open_ and r.batch_id != batch_id:
                yield batch_id, end, True
            open_, batch_id = True, r.batch_id
            if r.content is not None:
                yield batch_id, b"".join((head, r.content, b"\r\n")), False
        if open_:
            yield batch_id, end, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow.batches_of(over(stream(batches)), arrow.schema_of(schema))

    held = objects.select(F.col("batch_id").cast("string").alias("batch_id"), "instance_id", "content").repartition("batch_id")
    return held.sortWithinPartitions("batch_id", "instance_id", "content").select("batch_id", "content").mapInArrow(run, schema)


def multipart_pieces(objects: DataFrame, boundary: str = "lumenframe-part", content_type: str = "application/dicom", piece_bytes: int = 4 << 20) -> DataFrame:
    """batch_id, piece_no, piece: the bodies of `multipart_body` in order, cut into pieces of about piece_bytes, so that a body may be of any size."""

    def over(stream: Iterator[tuple]) -> Iterator[tuple]:
        held, size, n = [], 0, 0
        for batch_id, body, last in stream:
            held.append(body)
            size += len(body)
            if last or size >= piece_bytes:
                yield batch_id, n, b"".join(held)
                held, size, n = [], 0, 0 if last else n + 1

    return _streamed(objects, boundary, content_type, over, "batch_id string, piece_no long, piece binary")


def multipart_digests(objects: DataFrame, boundary: str = "lumenframe-part", content_type: str = "application/dicom") -> DataFrame:
    """batch_id, n_bytes, sha256 of the bodies of `multipart_body`, which may be of any size."""

    def over(stream: Iterator[tuple]) -> Iterator[tuple]:
        digest, size = hashlib.sha256(), 0
        for batch_id, body, last in stream:
            digest.update(body)
            size += len(body)
            if last:
                yield batch_id, size, digest.hexdigest()
                digest, size = hashlib.sha256(), 0

    return _streamed(objects, boundary, content_type, over, "batch_id string, n_bytes long, sha256 string")


def _plan_structs(plan: list[tuple]) -> Column:
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(m).alias("is_meta"), F.lit(KEYWORDS[k]).alias("tag"), F.lit(vr).alias("vr"), s.cast("string").alias("str"), b.cast("binary").alias("bin")) for i, (m, k, vr, s, b) in enumerate(plan)))
    path = F.array().cast(PATH)

    def whole(e: Column) -> Column:
        given = {n: e[n] for n in ("ordinal", "is_meta", "tag", "vr", "str", "bin")}
        given |= {"path": path, "path_text": F.lit(""), "depth": F.lit(0), "value_length": F.coalesce(F.length(e["bin"]), F.octet_length(e["str"]), F.lit(0)).cast("long"), "is_complete": F.lit(True), "strs": F.when(e["str"].isNotNull(), F.array(e["str"])), "is_bulk": F.lit(False)}
        return F.struct(*(given.get(n, F.lit(None)).alias(n) for n in ELEMENT_NAMES)).cast(ELEMENT_STRUCT)

    return F.transform(rows, whole)


def element_rows(objects: DataFrame, plan: list[tuple]) -> DataFrame:
    """Element rows of each object from (is_meta, keyword, VR, text column, bytes column), in data set order."""
    return objects.select("instance_id", F.explode(_plan_structs(plan)).alias("e")).select("instance_id", "e.*")


def planned_objects(objects: DataFrame, plan: list[tuple], *keep: str) -> DataFrame:
    """Whole objects (schema.PARSED) of the same plan, each made of its own row without putting elements together by a shuffle; keep: further columns.

    The rows are dealt to all cores by instance_id first: making objects of them takes much longer than a table's few row groups,
    or what adaptive execution makes of few bytes, allow for. There are more partitions for larger sources, so that what a task gets,
    and the Arrow batches that its Python steps hold, do not grow with the input.
    """
    none, cores = F.lit(None).cast("string"), objects.sparkSession.sparkContext.defaultParallelism
    dealt = objects.repartition(max(3 * cores, min(source_bytes(objects) // PARTITION_BYTES, 64 * cores)), "instance_id")
    return dealt.select("instance_id", F.col("instance_id").alias("seen"), none.alias("transfer_syntax_uid"), none.alias("error_message"), _plan_structs(plan).alias("elements"), *keep)


def _document_plan() -> list[tuple]:
    uid = lambda name: deterministic_uid(F.concat(F.lit(name + "|"), F.col("instance_id")))
    sop = F.coalesce(mime_sop_class(F.col("mime_type")), F.lit(SECONDARY_CAPTURE))
    none, sop_uid = F.lit(None), uid("SOPInstanceUID")
    return [
        (True, "FileMetaInformationVersion", "OB", none, F.lit(b"\x00\x01")), (True, "MediaStorageSOPClassUID", "UI", sop, none), (True, "MediaStorageSOPInstanceUID", "UI", sop_uid, none), (True, "TransferSyntaxUID", "UI", F.lit(EXPLICIT), none),
        (False, "SpecificCharacterSet", "CS", F.lit("ISO_IR 192"), none), (False, "SOPClassUID", "UI", sop, none), (False, "SOPInstanceUID", "UI", sop_uid, none), (False, "Modality", "CS", F.lit("DOC"), none), (False, "ConversionType", "CS", F.lit("WSD"), none),
        (False, "StudyInstanceUID", "UI", uid("StudyInstanceUID"), none), (False, "SeriesInstanceUID", "UI", uid("SeriesInstanceUID"), none), (False, "SeriesNumber", "IS", F.lit("1"), none), (False, "InstanceNumber", "IS", F.lit("1"), none), (False, "BurnedInAnnotation", "CS", F.lit("YES"), none),
        (False, "DocumentTitle", "ST", F.coalesce("title", F.lit("")), none), (False, "EncapsulatedDocument", "OB", none, F.col("bytes")), (False, "MIMETypeOfEncapsulatedDocument", "LO", F.col("mime_type"), none), (False, "EncapsulatedDocumentLength", "UL", F.length("bytes").cast("string"), none),
    ]


def wrap_documents(documents: DataFrame) -> DataFrame:
    """Element rows of an encapsulated-document object for each of documents(instance_id, mime_type, title, bytes); a text that is no known document becomes a secondary capture's comment-free copy of bytes."""
    return element_rows(documents, _document_plan())


def wrapped_objects(documents: DataFrame) -> DataFrame:
    """Whole objects of `wrap_documents`, one a row of documents."""
    return planned_objects(documents, _document_plan())


_DOCUMENT = ("EncapsulatedDocument", "MIMETypeOfEncapsulatedDocument", "DocumentTitle", "EncapsulatedDocumentLength")
#: All tags that an encapsulated document is made of.
DOCUMENT_TAGS = frozenset(KEYWORDS[t] for t in _DOCUMENT)


def unwrap_documents(elements: DataFrame) -> DataFrame:
    """Documents of element rows, which are first put together as objects."""
    return unwrap_objects(object_rows(elements.filter((F.col("depth") == 0) & F.col("tag").isin(*DOCUMENT_TAGS))))


def unwrap_objects(parsed: DataFrame) -> DataFrame:
    """instance_id, mime_type, title, file_name, content of every encapsulated document, cut to its declared length."""
    fields = zip(_DOCUMENT, ("bin", "str", "str", "str"), ("raw", "mime_type", "title", "declared"), strict=True)
    rows = parsed.select("instance_id", *(value_of(KEYWORDS[t], field).alias(name) for t, field, name in fields))
    name = F.concat(safe_name(F.coalesce(F.nullif("title", F.lit("")), "instance_id")), F.lit("."), mime_extension(F.col("mime_type")))
    return rows.filter("raw is not null").select("instance_id", "mime_type", "title", name.alias("file_name"), document_bytes(F.col("raw"), F.col("declared").try_cast("long")).alias("content"))


def send_http(bodies: DataFrame, url: str, method: str = "POST", accepted: Collection[int] = (200, 201, 202, 204), headers: dict[str, str] | None = None, timeout: float = 30.0) -> DataFrame:
    """batch_id, status, response, concern of each sent row of (batch_id, body, content_type), such as `multipart_body` gives.

    Sending happens when the result is evaluated, at least once a row: a task that runs again sends again,
    which stores keyed by instance UID accept. A status that is not accepted, or no answer, is a concern.
    """
    own, good = dict(headers or {}), frozenset(accepted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                status, answer, concern = None, None, None
                request = urllib.request.Request(url, data=bytes(r.body or b""), method=method, headers={**own, "Content-Type": r.content_type})
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as response:
                        status, answer = response.status, response.read()
                except urllib.error.HTTPError as e:
                    status, answer = e.code, e.read()
                except OSError as e:
                    concern = f"{type(e).__name__}: {e}"
                if status is not None and status not in good:
                    concern = f"status {status}"
                out.append((r.batch_id, status, answer, concern))
            yield pd.DataFrame(out, columns=["batch_id", "status", "response", "concern"]).astype({"status": "Int32"})

    kind = bodies.schema["batch_id"].dataType.simpleString()
    return bodies.select("batch_id", "body", "content_type").mapInPandas(run, f"batch_id {kind}, status int, response binary, concern string")
