"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted trees over statistics of labelled texts give conjunctive rules (every
path from a root); a lasso logistic regression keeps few of them; the kept rules
are compiled into a Spark column expression over the statistics.

Defined cases: null and empty texts have all statistics 0 and get a score like
any other; without labels of both classes the score is the share of label 1 (or
0.5 without any); labels of null quality are ignored; of repeated labels of a
document each counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import textvec
from lumenframe.llm.staging import small

STATS = ("log_bytes", "log_words", "word_length", "long_words", "short_words", "alpha", "high", "digit", "upper", "symbol", "stop", "pipe", "lines", "distinct_words", "distinct_lines", "distinct_grams", "top_word", "symbol_words", "upper_words")
#: Labelled rows that the classifier is fitted on at most (about: they are drawn by a hash of doc_id).
FIT_ROWS = 12_000
TREES = 60
DEPTH = 3
LASSO = 0.002
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 stop mark, 6 symbol, 7 high byte
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?!'\"-()"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6


def _share_distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values / values and the largest count / values of each row; 0 for a row without any."""
    total = np.bincount(rows, minlength=n)
    both = textvec.mix(hashes ^ textvec.mix(rows.astype(np.uint64)))
    order = np.argsort(both, kind="stable")
    s, r = both[order], rows[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(s)))
    owner = r[begin] if len(begin) else np.zeros(0, np.int64)
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    safe = np.maximum(total, 1)
    return distinct / safe, top / safe


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATS)))
    size = np.diff(offsets)
    rows = np.repeat(np.arange(n), size)
    kinds = _CLASS[data]
    counts = np.bincount(rows * 8 + kinds, minlength=n * 8).reshape(n, 8).astype(float)
    safe = np.maximum(size, 1)
    starts, ends, wrow = textvec.word_bounds(data, offsets)
    hashes = textvec.span_hashes(textvec.LOWER[data], starts, ends)
    words = np.bincount(wrow, minlength=n)
    wsafe = np.maximum(words, 1)
    length = ends - starts
    for i, column in enumerate(
        (
            np.log1p(size),
            np.log1p(words),
            np.bincount(wrow, length, n) / wsafe,
            np.bincount(wrow, length > 15, n) / wsafe,
            np.bincount(wrow, length <= 2, n) / wsafe,
            counts[:, 1] / safe,
            counts[:, 7] / safe,
            counts[:, 3] / safe,
            counts[:, 2] / safe,
            counts[:, 6] / safe,
            counts[:, 5] / safe,
            np.bincount(rows, data == 124, n) / safe,
        )
    ):
        out[:, i] = column
    breaks = np.flatnonzero(data == 10)
    lstart = np.concatenate([offsets[:-1][size > 0], breaks + 1])
    lstart = np.unique(lstart[lstart < len(data)])
    lend = np.append(lstart[1:], len(data)) if len(lstart) else lstart
    lrow = np.searchsorted(offsets, lstart, "right") - 1
    out[:, 12] = np.bincount(lrow, minlength=n) / wsafe
    out[:, 13], out[:, 16] = _share_distinct(hashes, wrow, n)
    out[:, 14], _ = _share_distinct(textvec.span_hashes(data, lstart, lend), lrow, n)
    grams, grow = textvec.shingles(hashes, wrow, 3)
    out[:, 15], _ = _share_distinct(grams, grow, n)
    out[:, 17] = np.bincount(wrow, np.isin(kinds[ends - 1], (0, 6)) if len(ends) else None, n) / wsafe
    both_upper = (kinds[starts] == 2) & (kinds[np.minimum(starts + 1, ends - 1)] == 2) & (length > 1) if len(starts) else None
    out[:, 18] = np.bincount(wrow, both_upper, n) / wsafe
    return np.round(out, 9)


def _with_statistics(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textvec.chunks(batch.column(keep)):
                stats = statistics(data, offsets)
                kept = [batch.column(i).slice(first, last - first) for i in range(keep)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(stats[:, i]) for i in range(len(STATS)))], [*batch.schema.names[:keep], *STATS])

    return run


def with_statistics(df: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns of df and STATS of its text."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), *(f"`{s}` double" for s in STATS)])
    return df.select(*carried, F.col("text").cast("string").alias("text")).mapInArrow(_with_statistics(len(carried)), schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether it is above, threshold) with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, cut in self.terms:
            out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
        return out


def _tree(codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """The paths of one regression tree on binned statistics, and its value for each row."""
    paths: list[tuple] = []
    value = np.zeros(len(grad))

    def grow(at: np.ndarray, path: tuple, left: int) -> None:
        g, h = grad[at].sum(), hess[at].sum()
        if path:
            paths.append(path)
        best = (1e-6, -1, -1)
        if left and len(at) >= 2 * least:
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                c = codes[at, f]
                gs = np.cumsum(np.bincount(c, grad[at], len(edges) + 1))[:-1]
                hs = np.cumsum(np.bincount(c, hess[at], len(edges) + 1))[:-1]
                ns = np.cumsum(np.bincount(c, minlength=len(edges) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(at) - ns < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] < 0:
            value[at] = -g / (h + 1)
            return
        _, f, k = best
        low = codes[at, f] <= k
        grow(at[low], (*path, (f, False, float(cuts[f][k]))), left - 1)
        grow(at[~low], (*path, (f, True, float(cuts[f][k]))), left - 1)

    grow(np.arange(len(grad)), (), depth)
    return paths, value


def simplified(path: tuple) -> tuple:
    """The tightest bound of each statistic and side, in order."""
    tight: dict[tuple[int, bool], float] = {}
    for f, above, cut in path:
        tight[f, above] = (max if above else min)(cut, tight.get((f, above), cut))
    return tuple(sorted((f, a, c) for (f, a), c in tight.items()))


def rules_of(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """Distinct conjunctions on the paths of boosted trees, each tree grown on half of the rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    score, found = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}
    least = max(5, len(y) // 200)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        part = rng.permutation(len(y))[: max(2 * least, len(y) // 2)]
        paths, _ = _tree(codes[part], cuts, (p - y)[part], (p * (1 - p))[part], depth, least)
        leaves = [simplified(q) for q in paths]
        for q in leaves:
            found.setdefault(q, len(found))
        for q in leaves:
            at = Rule(q).holds(x)
            score[at] += 0.1 * -(p - y)[at].sum() / ((p * (1 - p))[at].sum() + 1)
    return [Rule(q) for q in found]


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient."""
    n, m = z.shape
    w, b = np.zeros(m), math.log(y.mean() / (1 - y.mean()))
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / max(1e-9, np.linalg.norm(np.hstack([z, np.ones((n, 1))]).T @ np.hstack([z, np.ones((n, 1))]) / n, 2))
    for _ in range(rounds):
        d = (1 / (1 + np.exp(-(z @ v + c))) - y) / n
        w1 = v - step * (z.T @ d)
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        b1 = c - step * d.sum()
        t1 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, stats: dict[str, Column] | None = None) -> Column:
        """The compiled expression: the logistic of the summed weights of the rules that hold."""
        col = (lambda f: F.col(STATS[f])) if stats is None else (lambda f: stats[STATS[f]])
        total = F.lit(float(self.bias))
        for r in self.rules:
            held = F.lit(True)
            for f, above, cut in r.terms:
                held = held & ((col(f) > F.lit(cut)) if above else (col(f) <= F.lit(cut)))
            total = total + F.when(held, F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for r in self.rules:
            total += np.where(r.holds(x), r.weight, 0.0)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = LASSO) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(math.log(p / (1 - p))), ())
    rules = rules_of(x, y)
    if not rules:
        return RuleEnsemble(float(math.log(y.mean() / (1 - y.mean()))), ())
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    w, b = lasso_logistic(z, y, penalty)
    return RuleEnsemble(float(b), tuple(Rule(r.terms, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4))


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    """The ensemble of about fit_rows of the labelled documents, drawn by a hash of doc_id."""
    labels = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    n = labels.count()
    share = 1_000_000 if n <= fit_rows else fit_rows * 1_000_000 // n
    drawn = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(drawn, min(n, fit_rows)), "doc_id")
    got = with_statistics(rows, ["doc_id", "quality"]).toArrow().to_pandas().sort_values(["doc_id", *STATS]).reset_index(drop=True)
    return fit(got[list(STATS)].to_numpy(float), got["quality"].to_numpy(float))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, model: RuleEnsemble | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; fitted on labels of documents whose crc32 mod 5 is not 0."""
    key = F.col("doc_id").cast("long")
    model = model or fit_on(docs, labels.filter(~held_out(key, 5, 0)))
    scored = with_statistics(docs.select(key.alias("doc_id"), "text"), ["doc_id"]).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
