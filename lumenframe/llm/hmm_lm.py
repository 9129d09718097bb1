"""A hidden Markov language model.

Tokens are words (A-Z lowered) and one end per text. The most frequent tokens
are symbols of their own; every other token is written as one of a fixed number
of classes (by its last bytes), inside which it has an add-one probability. An
HMM over these symbols is trained by Baum-Welch: each round every partition adds
up its expected transition and emission counts, which are summed over
partitions. Scoring runs the scaled forward recursion, which gives the exact
likelihood of a text's tokens under the model.

Defined cases: null and empty texts are the one token end; an unseen token has
count 0 and its class's add-one probability; without training texts N and V are
0 and the model is uniform; repeated rows are scored and counted separately.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import textvec
from lumenframe.llm.rule_quality import held_out
from lumenframe.llm.staging import Stages

STATES = 8
#: Tokens with a symbol of their own, and classes of the others.
SYMBOLS = 4096
CLASSES = 128
#: Tokens whose counts are sent to every task (16 bytes each); the counts of the others are joined.
KNOWN = 131_072
ROUNDS = 3
#: Texts of the start that the driver fits before the rounds over all texts (about: drawn by a hash of doc_id).
START_DOCS = 400
START_ROUNDS = 12
GROUP_TOKENS = 400_000
END = 0x5E5E5E5E5E5E5E5E


def text_tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, token hashes as int64, token classes, row ends): every text's words, then its end."""
    for first, last, data, offsets in textvec.chunks(column):
        low = textvec.LOWER[data]
        starts, ends, rows = textvec.word_bounds(data, offsets)
        hashes = textvec.span_hashes(low, starts, ends)
        tail = low[ends - 1].astype(np.uint64) * np.uint64(257) + np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        kind = (textvec.mix(tail) % np.uint64(CLASSES)).astype(np.int64)
        n = last - first
        many = np.bincount(rows, minlength=n) + 1
        stop = np.cumsum(many)
        tokens, classes = np.empty(stop[-1], np.uint64), np.zeros(stop[-1], np.int64)
        at = np.arange(len(hashes)) + rows
        tokens[at], classes[at] = hashes, kind
        tokens[stop - 1] = END
        yield first, last, tokens.view(np.int64), classes, stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, tokens, classes, _ in text_tokens(batch.column(0)):
            token, begin, count = np.unique(tokens, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(classes[begin]), pa.array(count)], ["token", "class", "n"])


@dataclass(frozen=True)
class Vocabulary:
    """Counts known everywhere, sorted by token, with the symbol of each (-1: its class's)."""

    tokens: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    n_symbols: int
    total: int
    size: int
    class_total: np.ndarray
    class_size: np.ndarray

    def look_up(self, tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, counts (0 if not known here) and whether known here."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), max(0, len(self.tokens) - 1))
        known = self.tokens[at] == tokens if len(self.tokens) else np.zeros(len(tokens), bool)
        own = np.where(known, self.symbols[at], -1) if len(self.tokens) else np.full(len(tokens), -1)
        return np.where(own >= 0, own, self.n_symbols + classes), np.where(known, self.counts[at], 0) if len(self.tokens) else np.zeros(len(tokens), np.int64), known

    @property
    def width(self) -> int:
        return self.n_symbols + CLASSES

    def class_cost(self) -> np.ndarray:
        """log10 of what (count + 1) is divided by within each class."""
        return np.log10(self.class_total + self.class_size + 1.0)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Sums over all counts, and the KNOWN most frequent tokens."""
    total, size = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = counts.orderBy(F.col("n").desc(), "token").limit(KNOWN).toArrow()
    token, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    rank = np.lexsort((token, -n))
    symbols = np.full(len(token), -1, np.int64)
    n_symbols = min(SYMBOLS, len(token))
    symbols[rank[:n_symbols]] = np.arange(n_symbols)
    kinds = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    class_total, class_size = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in kinds:
        class_total[r["class"]], class_size[r["class"]] = r["n"], r["v"]
    classes = top.column("class").to_numpy()
    own = symbols >= 0
    np.subtract.at(class_total, classes[own], n[own])
    np.subtract.at(class_size, classes[own], 1)
    order = np.argsort(token)
    return Vocabulary(token[order], n[order], symbols[order], n_symbols, int(total or 0), int(size or 0), class_total, class_size)


def _encode(vocab: Vocabulary):
    cost = vocab.class_cost()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, tokens, classes, stop in text_tokens(batch.column(2)):
                symbols, counts, known = vocab.look_up(tokens, classes)
                logs = np.log10(counts + 1.0)
                inner = np.where(symbols >= vocab.n_symbols, logs - cost[classes], 0.0)
                begin = np.append(0, stop[:-1])
                wide = symbols.astype(np.uint16)
                rare = ~known
                out = []
                for lo, hi in zip(begin, stop, strict=True):
                    token, n = np.unique(tokens[lo:hi][rare[lo:hi]], return_counts=True)
                    out.append((wide[lo:hi].tobytes(), token, n))
                ends = np.append(0, np.cumsum([len(t) for _, t, _ in out])).astype(np.int32)
                flat = lambda i, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[i] for x in out]).astype(kind)))  # noqa: E731,B023
                arrays = [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array([x[0] for x in out], pa.binary()), pa.array((stop - begin).astype(np.int64)), pa.array(np.add.reduceat(known & (counts > 0), begin).astype(np.int64)), pa.array(np.add.reduceat(logs, begin)), pa.array(np.add.reduceat(inner, begin)), flat(1, np.int64), flat(2, np.int64)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "symbols", "n_tokens", "n_known", "logs", "inner", "rare", "times"])

    return run


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K

    @staticmethod
    def random(width: int, frequency: np.ndarray, states: int = STATES, seed: int = 11) -> Hmm:
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = (frequency[:, None] + 1e-3) * rng.uniform(0.5, 1.5, (width, states))
        move = rng.uniform(0.5, 1.5, (states, states)) + np.eye(states)
        return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def groups(sequences: list[np.ndarray], tokens: int = GROUP_TOKENS) -> Iterator[list[int]]:
    """Indexes by falling length, so many at a time that a group holds about so many tokens."""
    order = sorted(range(len(sequences)), key=lambda i: (-len(sequences[i]), i))
    part, held = [], 0
    for i in order:
        if part and held + len(sequences[i]) > tokens:
            yield part
            part, held = [], 0
        part.append(i)
        held += len(sequences[i])
    if part:
        yield part


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols time by time (sequences of falling length), and how many sequences have each time."""
    lengths = np.array([len(s) for s in sequences])
    flat = np.concatenate(sequences).astype(np.int64)
    time = np.concatenate([np.arange(n) for n in lengths])
    who = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(time * len(lengths) + who, kind="stable")
    return flat[order], np.bincount(time)


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each sequence; they have falling lengths."""
    out = np.zeros(len(sequences))
    if not sequences:
        return out
    symbols, active = _by_time(sequences)
    at, alpha = 0, None
    for t, n in enumerate(active):
        e = model.emit[symbols[at : at + n]]
        alpha = e * model.start if t == 0 else (alpha[:n] @ model.move) * e
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        out[:n] += np.log(scale)
        at += n
    return out


def expected(model: Hmm, sequences: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Adds the expected start, transition and emission counts of sequences (of falling lengths); returns their log likelihood."""
    start, move, emit = counts
    symbols, active = _by_time(sequences)
    cuts = np.append(0, np.cumsum(active))
    e = model.emit[symbols]
    alpha, scale = np.empty_like(e), np.empty(len(symbols))
    for t, n in enumerate(active):
        lo, hi = cuts[t], cuts[t] + n
        a = e[lo:hi] * model.start if t == 0 else (alpha[cuts[t - 1] : cuts[t - 1] + n] @ model.move) * e[lo:hi]
        scale[lo:hi] = a.sum(1)
        alpha[lo:hi] = a / scale[lo:hi, None]
    beta = np.ones_like(e)
    moved = np.zeros_like(model.move)
    back = model.move.T.copy()
    for t in range(len(active) - 1, 0, -1):
        n, lo, prev = active[t], cuts[t], cuts[t - 1]
        w = e[lo : lo + n] * beta[lo : lo + n] / scale[lo : lo + n, None]
        moved += alpha[prev : prev + n].T @ w
        beta[prev : prev + n] = w @ back
    gamma = alpha * beta
    move += moved * model.move
    start += gamma[: active[0]].sum(0)
    for k in range(gamma.shape[1]):
        emit[:, k] += np.bincount(symbols, gamma[:, k], len(emit))
    return float(np.log(scale).sum())


def _zero(width: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(states), np.zeros((states, states)), np.zeros((width, states))


def maximised(counts: tuple[np.ndarray, np.ndarray, np.ndarray], frequency: np.ndarray) -> Hmm:
    """The model of expected counts; a small share of the overall symbol frequencies keeps every emission above 0."""
    start, move, emit = counts
    start, move = start + 0.1, move + 0.1
    emit = emit + 10.0 * frequency[:, None]
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _accumulate(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = _zero(*model.emit.shape), False
        for batch in batches:
            sequences = [np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()]
            for part in groups(sequences):
                expected(model, [sequences[i] for i in part], counts)
                seen = True
        if seen:
            table = np.vstack([counts[2], counts[1], counts[0][None, :]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table))), *(pa.array(table[:, k]) for k in range(table.shape[1]))], ["row", *(f"s{k}" for k in range(table.shape[1]))])

    return run


def train(encoded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, states: int = STATES) -> Hmm:
    """Baum-Welch over all rows of encoded(doc_id, symbols); the start is fitted on a bounded sample."""
    frequency = np.full(vocab.width, 1.0)
    own = vocab.symbols >= 0
    frequency[vocab.symbols[own]] += vocab.counts[own]
    frequency[vocab.n_symbols :] += vocab.class_total
    frequency /= frequency.sum()
    model = Hmm.random(vocab.width, frequency, states)
    n = encoded.count()
    if not n:
        return model
    share = 1_000_000 if n <= START_DOCS else max(1, START_DOCS * 1_000_000 // n)
    drawn = encoded.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < share).select("doc_id", "symbols").toArrow().sort_by([("doc_id", "ascending"), ("symbols", "ascending")])
    sample = [np.frombuffer(x, np.uint16) for x in drawn.column("symbols").to_pylist()]
    for _ in range(START_ROUNDS if sample else 0):
        counts = _zero(vocab.width, states)
        for part in groups(sample):
            expected(model, [sample[i] for i in part], counts)
        model = maximised(counts, frequency)
    names = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        sums = encoded.select("symbols").mapInArrow(_accumulate(model), "row long, " + ", ".join(f"{s} double" for s in names)).groupBy("row").agg(*(F.sum(s).alias(s) for s in names)).toArrow().sort_by("row")
        table = np.stack([sums.column(s).to_numpy() for s in names], axis=1)
        model = maximised((table[-1], table[-1 - states : -1], table[: vocab.width]), frequency)
    return model


def _score(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()]
            out = np.zeros(len(sequences))
            for part in groups(sequences):
                out[part] = forward(model, [sequences[i] for i in part])
            kept = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out / math.log(10))], [*batch.schema.names[1:], "path"])

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from documents whose crc32 mod 7 is not 2."""
    stages = Stages(docs.sparkSession, "hmm")
    key = F.col("doc_id").cast("long")
    base = docs.select(key.alias("doc_id"), held_out(key, 7, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    counted = base.filter(~F.col("held_out")).select("text").mapInArrow(_count, "token long, class long, n long")
    counts = stages.write(counted.groupBy("token").agg(F.sum("n").alias("n"), F.first("class").alias("class")))
    vocab = vocabulary(counts)
    encoded = base.mapInArrow(_encode(vocab), "doc_id long, held_out boolean, symbols binary, n_tokens long, n_known long, logs double, inner double, rare array<long>, times array<long>")
    encoded = stages.write(encoded.withColumn("row", F.monotonically_increasing_id()))
    model = train(encoded.filter(~F.col("held_out")), vocab)
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("token"), F.col("t.times").alias("times"))
    found = rare.join(counts.select("token", "n"), "token").groupBy("row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_logs"))
    scored = encoded.select("symbols", "row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "inner").mapInArrow(_score(model), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, inner double, path double")
    out = scored.join(found, "row", "left")
    more = F.coalesce("_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(math.log10(vocab.total + vocab.size + 1))).alias("base_score"),
        (F.col("path") + F.col("inner") + more).alias("score"),
    )
