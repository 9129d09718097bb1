"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import centroid_langid, chosen_path, cube_sampling, hmm_lm, oracles, patience_license, rule_quality, spaced_seed, style_tree, weak_pii, winnowing
from lumenframe.llm.staging import Stages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_sampling.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op6_patience_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patience_license.scan(table(spark, sf_dir, "documents"))


def op7_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = Stages(spark, "pii").write(weak_pii.spans_of(table(spark, sf_dir, "documents")))
    model = weak_pii.fit(staged.select(F.explode("extra").alias("s")).select("s.*"))
    spans = weak_pii.chosen(F.col("base"), F.col("extra"), model)
    counts = [weak_pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in weak_pii.BASE_KINDS]
    digest = F.sha2(weak_pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return staged.select("doc_id", *counts, digest, weak_pii.joined(spans).alias("spans"))


def op8_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_texts(table(spark, sf_dir, "documents"))


def op9_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_langid.predict_languages(table(spark, sf_dir, "documents"))


def op10_spaced_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_cube_mix, op2_winnowing, op3_rule_quality, op4_chosen_path, op5_style_tree, op6_patience_license, op7_weak_pii, op8_hmm_lm, op9_centroid_langid, op10_spaced_seed)}



def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1_cube_mix."""
    return op1_cube_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def llm_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_winnowing."""
    return op2_winnowing(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def llm_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7_weak_pii."""
    return op7_weak_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def llm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8_hmm_lm."""
    return op8_hmm_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


QUERIES |= {f.__name__: f for f in (llm_mix_targets, llm_edited_texts, llm_base_spans, llm_base_scores)}

#: What cannot be said in SQL is held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {"op4_chosen_path": oracles.NEAR_DUPLICATES, "llm_mix_targets": oracles.MIX_TARGETS, "llm_edited_texts": oracles.EDITED_TEXTS, "llm_base_spans": oracles.BASE_SPANS, "llm_base_scores": oracles.BASE_SCORES}
