"""Language identification by nearest centroid.

Texts are vectors of hashed letter trigrams, weighted by log count and inverse
document frequency and normalised. Each language has several centroids, found by
spherical k-means over a bounded sample of its labelled texts, drawn language by
language so that rare ones are learned however large the table is; document
frequencies are counted over all training texts. A text gets the language of its
nearest centroid by cosine; one that is farther from it than nearly all training
texts of that language is rejected.

Defined cases: null texts and texts without a letter are `und` with score 0 and
rejected; without any training text all are `und`; null languages are never
learned; ties go to the language first in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import textvec
from lumenframe.llm.rule_quality import held_out
from lumenframe.llm.staging import small

DIMS = 4096
CENTROIDS = 4
#: Training texts that centroids are fitted on at most (about: drawn by a hash of doc_id), and those of a language that are taken in any case.
FIT_ROWS = 3000
LEAST_ROWS = 32
HASHES = 10**15
REJECT_SHARE = 0.5
#: Trigrams from which the full distance counts; shorter texts, whose vectors are noisy, are rejected less readily.
FULL_TRIGRAMS = 400
UNKNOWN = "und"

_LETTER = textvec.LOWER.copy()
_LETTER[:128][~np.isin(np.arange(128), [*range(65, 91), *range(97, 123)])] = 32


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed counts (rows x DIMS) of byte trigrams; whatever is no letter counts as a space, and a space stands before and after each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    body = np.full(len(data) + n + 2, 32, np.uint32)
    rows = np.repeat(np.arange(n), size)
    body[np.arange(len(data)) + rows + 1] = _LETTER[data]
    at = np.arange(len(data)) + rows
    code = (body[at] << np.uint32(16)) | (body[at + 1] << np.uint32(8)) | body[at + 2]
    blank = code == 0x202020
    dim = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    return np.bincount((rows * DIMS + dim)[~blank], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for first, last, data, offsets in textvec.chunks(batch.column(0), rows=256):
            total += (trigram_counts(data, offsets) > 0).sum(axis=0)
            docs += last - first
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMS), -1)), pa.array(np.append(total, docs))], ["dim", "n"])


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in textvec.chunks(batch.column(2), rows=256):
            counts = np.log1p(trigram_counts(data, offsets)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array([r.tobytes() for r in counts], pa.binary())], ["doc_id", "lang", "v"])


@dataclass(frozen=True)
class Centroids:
    idf: np.ndarray
    langs: tuple[str, ...]  # the language of each centroid, in code point order
    vectors: np.ndarray
    least: np.ndarray  # the cosine below which each centroid rejects

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid, its cosine, and whether it is too far."""
        cosines = _weigh(counts, self.idf) @ self.vectors.T
        at = cosines.argmax(axis=1)
        cosine = cosines[np.arange(len(at)), at]
        return at, cosine, cosine < self.least[at] * np.sqrt(np.minimum(1.0, counts.sum(axis=1) / FULL_TRIGRAMS))


def cluster(v: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means: up to k unit centroids."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = min(k, len(v))
    centres = v[rng.permutation(len(v))[:k]]
    for _ in range(rounds):
        near = (v @ centres.T).argmax(axis=1)
        sums = np.stack([v[near == j].sum(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def quota(counts: list[int], fit_rows: int) -> int:
    """Texts to draw of a language at most: LEAST_ROWS, or more if all languages together then give no more than fit_rows."""
    left = fit_rows
    for i, n in enumerate(sorted(counts)):
        share = left // (len(counts) - i)
        if n > share:
            return max(share, LEAST_ROWS)
        left -= n
    return max([LEAST_ROWS, *counts])


def fit_on(docs: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Centroids | None:
    """Centroids of docs(doc_id, text, lang): all of them count for document frequency, about fit_rows are clustered, of each language alike."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    counted = train.select("text").mapInArrow(_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows
    if not counted:
        return None
    found = {r["dim"]: r["n"] for r in counted}
    n = found.pop(-1)
    df = np.zeros(DIMS)
    df[list(found)] = list(found.values())
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)
    rows = [(r["lang"], r["n"]) for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row a language
    most = quota([n for _, n in rows], fit_rows)
    shares = docs.sparkSession.createDataFrame([(lang, HASHES if n <= most else most * HASHES // n) for lang, n in rows], "lang string, share long")
    drawn = train.join(small(shares, len(rows)), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HASHES)) < F.col("share"))
    got = drawn.select("doc_id", "lang", "text").mapInArrow(_sampled, "doc_id long, lang string, v binary").toArrow().sort_by([("doc_id", "ascending"), ("v", "ascending")])
    langs = np.array(got.column("lang").to_pylist())
    v = np.stack([np.frombuffer(x, np.float16) for x in got.column("v").to_pylist()]).astype(np.float32) * idf if len(langs) else np.zeros((0, DIMS), np.float32)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    names, vectors, least = [], [], []
    for i, lang in enumerate(sorted(set(langs))):
        own = v[langs == lang]
        centres = cluster(own, centroids, 100 + i)
        near = (own @ centres.T).max(axis=1)
        names += [str(lang)] * len(centres)
        vectors.append(centres)
        least += [float(np.quantile(near, 0.01)) * REJECT_SHARE] * len(centres)
    return Centroids(idf, tuple(names), np.concatenate(vectors), np.array(least)) if names else None


def _identify(model: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textvec.chunks(batch.column(1), rows=256):
                at, cosine, far = model.nearest(trigram_counts(data, offsets))
                none = np.diff(offsets) == 0
                lang = pa.array([UNKNOWN if x else model.langs[i] for i, x in zip(at, none, strict=True)], pa.string())
                score = np.where(none, 0.0, np.clip(cosine, 0, 1)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lang, pa.array(score), pa.array(none | far)], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs(doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    unknown = lambda df: df.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if model is None:
        return unknown(base)
    marked = base.select("doc_id", F.when(letter, F.col("text")).otherwise("").alias("text"))  # empty: without a letter
    return marked.mapInArrow(_identify(model), "doc_id long, lang_pred string, score double, rejected boolean")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from documents whose crc32 mod 4 is not 2."""
    out = held_out(F.col("doc_id").cast("long"), 4, 2)
    model = fit_on(docs.filter(~out))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
