"""Output stage of pipelines: where a target's rows go. A run gives what the sink answers, as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.dicom import safe_name
from lumenframe.sinks import packages

_ENDINGS = {"dicom": "dcm", "archive": "zip", "elements": "json", "frames": "bin"}


def payloads(df: DataFrame, target: str) -> DataFrame:
    """instance_id, file_name, content of a target's rows: their own bytes, or each row as JSON."""
    have = set(df.columns)
    raw = next((c for c in ("content", "bytes") if c in have), None)
    key = F.col("instance_id") if "instance_id" in have else F.col("study_uid") if "study_uid" in have else F.sha2(F.to_json(F.struct("*")), 256)
    if raw is None:
        content = (F.col("resource") if "resource" in have else F.to_json(F.struct("*"))).cast("binary")
        ending: Column = F.lit("json")
    else:
        content = F.col(raw)
        ending = F.col("kind") if target == "pictures" else F.lit(_ENDINGS.get(target, "bin"))
    number = next((F.concat(F.lit("-"), F.lpad((F.col(c) + 1).cast("string"), 6, "0")) for c in ("frame_index", "ordinal") if c in have), F.lit(""))
    name = F.col("file_name") if "file_name" in have else F.concat(safe_name(key), number, F.lit("."), ending)
    return df.select(key.alias("instance_id"), name.alias("file_name"), content.alias("content")).filter("content is not null")


@dataclass(frozen=True)
class Output:
    """A pipeline's rows and the sink that takes them."""

    rows: DataFrame
    sink: Callable[[DataFrame], DataFrame]

    def plan(self) -> DataFrame:
        return self.sink(self.rows)

    def run(self) -> list:
        """Everything is written once; the sink's answers."""
        return self.plan().collect()


def to_files(rows: DataFrame, folder: str, target: str) -> DataFrame:
    """path, bytes of each payload, written as a file of its own in a folder that all executors see: beside first, then renamed, so that a task that runs again leaves whole files."""
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, sizes = [], []
            for i in range(batch.num_rows):
                name, content = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                temporary = os.path.join(folder, f".{name}.{os.getpid()}.tmp")
                with open(temporary, "wb") as f:
                    f.write(content)
                os.replace(temporary, os.path.join(folder, name))
                paths.append(os.path.join(folder, name))
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return payloads(rows, target).mapInArrow(run, "path string, bytes long")


def to_parts(rows: DataFrame, target: str, content_type: str, boundary: str, per_body: int) -> DataFrame:
    """batch_id, body, content_type: multipart bodies of up to about per_body payloads each, dealt by name."""
    held = payloads(rows, target)
    n = max(1, -(-held.count() // per_body)) if per_body else 1
    return packages.multipart_body(held.withColumn("batch_id", F.pmod(F.xxhash64("file_name"), F.lit(n))), boundary, content_type)


def to_writer(rows: DataFrame, write: Callable[[Iterator[tuple[str, bytes]]], int], target: str) -> DataFrame:
    """n: what a writer of (file name, bytes) pairs answers for each partition; it may be called again for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((b.column(1)[i].as_py(), b.column(2)[i].as_py()) for b in batches for i in range(b.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array([write(pairs)], pa.int64())], ["n"])

    return payloads(rows, target).mapInArrow(run, "n long")
