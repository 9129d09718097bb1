"""Sources of objects: folders, files, byte rows, multipart bodies and web requests, in batch or as a stream."""

from __future__ import annotations

import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenframe import arrow
from lumenframe.schema import OBJECTS

BINARY = "path string, modificationTime timestamp, length long, content binary"


def _objects(files: DataFrame) -> DataFrame:
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    types = {"dcm": "application/dicom", "dicom": "application/dicom", "json": "application/json", "xml": "application/xml", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff"}
    content_type = F.lit(None).cast("string")
    for k, v in types.items():
        content_type = F.when(extension == k, v).otherwise(content_type)
    return files.select(F.sha2(F.col("path").cast("binary"), 256).alias("instance_id"), F.col("path").alias("source_uri"), F.lit(0).alias("part_no"), content_type.alias("content_type"), "content")


def read_folder(spark: SparkSession, path: str, recursive: bool = True, hidden: bool = False, extensions: Sequence[str] = (), max_files: int | None = None, sort: str = "name") -> DataFrame:
    """Files as objects. max_files keeps the first by name, by time (sort='mtime') or any (sort='none'); hidden files are left out by default."""
    if sort not in ("name", "mtime", "none"):
        raise ValueError("sort is name, mtime or none")
    files = spark.read.format("binaryFile").schema(BINARY).option("recursiveFileLookup", str(recursive).lower()).load(path)
    if not hidden:
        files = files.filter(~F.col("path").rlike(r"/\.[^/]*$"))
    if extensions:
        files = files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*(e.lower().lstrip(".") for e in extensions)))
    if max_files is not None:
        named = files.select("path", "modificationTime")
        chosen = (named if sort == "none" else named.orderBy(*(["modificationTime", "path"] if sort == "mtime" else ["path"]))).limit(max_files).select("path")
        files = files.join(chosen, "path", "left_semi")
    return _objects(files)


def watch_folder(spark: SparkSession, path: str, max_files_per_trigger: int = 1000, latest_first: bool = False) -> DataFrame:
    """An endless stream of new files; writers should write elsewhere and rename, so that a file is whole when it is seen."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files_per_trigger).option("latestFirst", str(latest_first).lower()).load(path)
    return _objects(files)


def from_bytes(spark: SparkSession, items: Sequence[tuple[str, bytes]], content_type: str | None = None) -> DataFrame:
    return spark.createDataFrame([(k, k, 0, content_type, bytearray(v)) for k, v in items], OBJECTS)


def split_multipart(body: bytes, content_type: str) -> list[tuple[dict[str, str], bytes]]:
    """(headers, body) of every part; raises ValueError on a malformed body."""
    boundary = None
    for p in content_type.split(";")[1:]:
        k, _, v = p.strip().partition("=")
        if k.strip().lower() == "boundary":
            boundary = v.strip().strip('"')
    if not boundary:
        raise ValueError("multipart content type without a boundary")
    mark = b"--" + boundary.encode()
    at = 0 if body.startswith(mark) else body.find(b"\r\n" + mark)
    if at < 0:
        raise ValueError("multipart body without its boundary")
    at += len(mark) + (0 if body.startswith(mark) and at == 0 else 2)
    out = []
    while True:
        tail = body[at : at + 2]
        if tail == b"--":
            return out
        if tail != b"\r\n":
            raise ValueError("truncated boundary marker")
        at += 2
        head_end = body.find(b"\r\n\r\n", at - 2)
        if head_end < 0:
            raise ValueError("part without the end of its headers")
        lines = body[at:head_end].decode("latin-1").split("\r\n") if head_end > at else []
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}
        start = head_end + 4
        end = body.find(b"\r\n" + mark, start)
        if end < 0:
            raise ValueError("multipart body without its closing boundary")
        out.append((headers, body[start:end]))
        at = end + 2 + len(mark)


def demux(objects: DataFrame) -> DataFrame:
    """One row per part of multipart objects, other objects as they are; a malformed body gives one row of content type `error`, its message in source_uri's place of part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for r in arrow.rows_of(batches):
            if not (r.content_type or "").lower().startswith("multipart/"):
                yield (*r, None)
                continue
            try:
                for i, (headers, body) in enumerate(split_multipart(r.content or b"", r.content_type)):
                    yield f"{r.instance_id}#{i}", r.source_uri, i, headers.get("content-type"), body, None
            except ValueError as e:
                yield r.instance_id, r.source_uri, -1, "error", None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow.batches_of(each(batches), arrow.schema_of(_PARTS))

    return objects.select(*arrow.schema_of(OBJECTS).names).mapInArrow(run, _PARTS)


_PARTS = OBJECTS + ", error_message string"


def dicomweb_url(base: str, mode: str = "qido-search", level: str = "study", study: str | None = None, series: str | None = None, instance: str | None = None, query: dict[str, str | Sequence[str]] | None = None) -> str:
    """The URL of a search (qido-search) or of metadata or an instance (wado-metadata, wado-instance); repeated keys for lists."""
    if mode not in ("qido-search", "wado-metadata", "wado-instance") or level not in ("study", "series", "instance"):
        raise ValueError(f"unknown mode or level: {mode}, {level}")
    part = lambda name, uid: f"/{name}/{urllib.parse.quote(uid, safe='')}" if uid else ""
    if mode == "qido-search":
        names = {"study": "studies", "series": "series", "instance": "instances"}
        path = (part("studies", study) if level != "study" else "") + (part("series", series) if level == "instance" else "") + f"/{names[level]}"
    else:
        need = {"study": (study,), "series": (study, series), "instance": (study, series, instance)}[level if mode == "wado-metadata" else "instance"]
        if not all(need):
            raise ValueError("retrieval needs the UIDs down to its level")
        path = "".join(part(n, u) for n, u in zip(("studies", "series", "instances"), need, strict=False)) + ("/metadata" if mode == "wado-metadata" else "")
    pairs = [(k, x) for k, v in (query or {}).items() for x in ([v] if isinstance(v, str) else v)]
    return base.rstrip("/") + path + ("?" + urllib.parse.urlencode(pairs) if pairs else "")


ACCEPT = {"qido-search": "application/dicom+json", "wado-metadata": "application/dicom+json", "wado-instance": 'multipart/related; type="application/dicom"'}


class _UrlPartition(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _UrlReader(DataSourceReader):
    def __init__(self, urls: list[str], accept: str, timeout: float):
        self.urls, self.accept, self.timeout = urls, accept, timeout

    def partitions(self) -> list[InputPartition]:
        return [_UrlPartition(u) for u in self.urls]

    def read(self, partition):
        request = urllib.request.Request(partition.url, headers={"Accept": self.accept})
        with urllib.request.urlopen(request, timeout=self.timeout) as response:  # a status that is no success raises
            yield (partition.url, partition.url, 0, response.headers.get("Content-Type"), response.read())


class HttpObjects(DataSource):
    """format("http_objects"): one partition per URL. Options: urls (by line), accept, timeout."""

    @classmethod
    def name(cls) -> str:
        return "http_objects"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> DataSourceReader:
        return _UrlReader(self.options["urls"].split("\n"), self.options.get("accept", "*/*"), float(self.options.get("timeout", "30")))


def read_http(spark: SparkSession, urls: Sequence[str], accept: str = "*/*", timeout: float = 30.0) -> DataFrame:
    spark.dataSource.register(HttpObjects)
    return spark.read.format("http_objects").option("urls", "\n".join(urls)).option("accept", accept).option("timeout", str(timeout)).load()
