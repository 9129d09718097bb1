"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents, and further ones that docs has, whatever their names.

Defined cases: a null or empty text has no letter and goes in the first stage;
rows of one doc_id go together where a stage rejects that doc_id; rows without
doc_id cannot be named, so the first three stages keep them; equal texts are
near copies, of which the smallest doc_id stays; personal data is replaced in
every row; the last stage counts repeated rows as documents of their own. Empty
tables and tables of one row pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import centroid_langid, chosen_path, cube_sampling, spaced_seed, weak_pii
from lumenframe.llm.staging import Stages, small


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of the given doc_ids."""
    name = "_dropped"
    while name in docs.columns:
        name += "_"
    dropped = Stages(docs.sparkSession, "dropped").write(ids.select(F.col("doc_id").cast("long").alias(name)).filter(F.col(name).isNotNull()).distinct())
    return docs.join(small(dropped), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest language centroid is too far, or without any letter, go."""
    model = centroid_langid.fit_on(docs)
    return without(docs, centroid_langid.identify(docs, model).filter("rejected"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: its smallest doc_id."""
    return without(docs, chosen_path.near_duplicates(docs).filter("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return without(docs, spaced_seed.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    found = weak_pii.redact(docs, weak_pii.fit_on(docs))
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return cube_sampling.mix_sources(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact_pii", redact_pii), ("mix", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = Stages(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stages.write(docs)
    return docs
