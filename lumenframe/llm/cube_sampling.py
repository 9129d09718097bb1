"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target number of words. A document of a source with
expectation e = target / size of the source is taken floor(e) times for sure and
once more with inclusion probability e - floor(e). The flight phase of the cube
method moves these probabilities through the null space of the two balancing
constraints (document total and word total of the source) until each is 0 or 1,
but for two at most a block; the leftovers of all blocks fly again together,
until one block a source is left, whose last two documents are landed by the
choice that comes nearest to both totals.

Defined cases: a null text has size 0; a null source is a source of its own and
comes last; documents of size 0 are drawn like others of their source and add no
words, however often; an empty table gives an empty result; repeated rows are
separate documents, also those of one doc_id or of none, which are dealt to
blocks by their texts. Targets are found in one task, over a row a source.
"""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.staging import Stages, small

#: Documents of a source that fly in one task.
BLOCK_DOCS = 2048
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs) with target: shares by weight of all words, none above cap times its source.

    The excess of capped sources is shared again by weight: with the sources
    ordered by cap size / weight, those below the water level are full.
    """
    whole = Window.partitionBy()
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    level = Window.orderBy("_fill", F.col("source").isNull(), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    out = (
        sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(named) - 1) % len(weights) + 1).cast("double"))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_fill", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(whole).cast("double"))
        .withColumn("_rate", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_rate", F.min(F.when(F.col("_fill") > F.col("_rate"), F.struct("_fill", "_rate"))).over(whole)["_rate"])
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_rate") * F.col("_w")), F.col("_cap")))
    )
    return out.select("source", "source_size", "n_docs", "target")


def fly(sizes: list[int], pis: list[float], rng: random.Random) -> list[float]:
    """The flight phase over one block, by windows of three documents; two fractional probabilities are left at most."""
    out = [0.0 if p <= _EPS else 1.0 if p >= 1 - _EPS else p for p in pis]
    open_ = [i for i, p in enumerate(out) if 0.0 < p < 1.0]
    active: list[int] = []
    queue = iter(open_)
    while True:
        while len(active) < 3 and (i := next(queue, None)) is not None:
            active.append(i)
        if len(active) < 3:
            break
        a, b, c = active
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(u):
            u = (1, -1, 0)
        up = down = float("inf")
        for i, x in zip(active, u, strict=True):
            p = out[i]
            if x > 0:
                up, down = min(up, (1 - p) / x), min(down, p / x)
            elif x < 0:
                up, down = min(up, p / -x), min(down, (1 - p) / -x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, u, strict=True):
            out[i] += step * x
            if out[i] < _EPS:
                out[i] = 0.0
            elif out[i] > 1 - _EPS:
                out[i] = 1.0
        active = [i for i in active if 0.0 < out[i] < 1.0]
    return out


def land(sizes: list[int], pis: list[float]) -> list[float]:
    """The landing: of all roundings of the fractional rest, the one nearest in words, then in documents."""
    out = [0.0 if p <= _EPS else 1.0 if p >= 1 - _EPS else p for p in pis]
    rest = [i for i, p in enumerate(out) if 0.0 < p < 1.0]

    def off(take: tuple[int, ...]) -> tuple:
        return abs(sum((t - out[i]) * sizes[i] for t, i in zip(take, rest, strict=True))), abs(sum(t - out[i] for t, i in zip(take, rest, strict=True))), take

    if rest:
        for t, i in zip(min(itertools.product((0, 1), repeat=len(rest)), key=off), rest, strict=True):
            out[i] = float(t)
    return out


def _flight(seed: int, last: bool):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("tie", "ascending")])
        cols = block.to_pydict()
        rng = random.Random(f"{seed}|{cols['source'][0]}|{cols['_block'][0]}|{last}")
        pis = fly(cols["size"], cols["pi"], rng)
        if last or cols["_blocks"][0] == 1:
            pis = land(cols["size"], pis)
        return block.select(["doc_id", "source", "size", "tie"]).append_column("pi", pa.array(pis, pa.float64()))

    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, block_docs: int = BLOCK_DOCS, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs(doc_id, text, source).

    Blocks bound what a task holds, so a source with a third of all rows is
    spread over many tasks. Reruns agree: blocks and draws follow from doc_id.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "cube")
    sized = stages.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    sources = stages.write(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, cap))
    n_sources, most = sources.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(e + F.lit(_EPS)).cast("long")
    wanted = sources.select(F.col("source").alias("_s"), "source_size", "target", "n_docs", whole.alias("_whole"), F.greatest(e - whole, F.lit(0.0)).alias("pi"))
    planned = sized.join(small(wanted, n_sources), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def blocks(df: DataFrame, n: Column) -> DataFrame:
        n = F.greatest(F.lit(1), F.ceil(n / F.lit(block_docs))).cast("long")
        return df.withColumn("_blocks", n).withColumn("_block", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), n))

    schema = "doc_id long, source string, size long, tie long, pi double"
    flown = stages.write(blocks(planned, F.col("n_docs")).select("doc_id", "source", "size", "tie", "pi", "_blocks", "_block").groupBy("source", "_block").applyInArrow(_flight(seed, False), schema))
    done, rest_n = [flown.filter("pi = 0 or pi = 1")], 2 * -(-(most or 0) // block_docs)
    rest = flown.filter("pi > 0 and pi < 1")
    while rest_n > 2:
        n_blocks = -(-rest_n // block_docs)
        fly_again = rest.withColumn("_blocks", F.lit(n_blocks).cast("long")).withColumn("_block", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.lit(n_blocks).cast("long")))
        landed = stages.write(fly_again.groupBy("source", "_block").applyInArrow(_flight(seed, n_blocks == 1), schema))
        done.append(landed.filter("pi = 0 or pi = 1"))
        if n_blocks == 1:
            break
        rest, rest_n = landed.filter("pi > 0 and pi < 1"), 2 * n_blocks
    chosen = done[0]
    for df in done[1:]:
        chosen = chosen.unionByName(df)
    copies = (F.col("_whole") + F.col("_pi").cast("long")).alias("copies")
    chosen = chosen.withColumnRenamed("pi", "_pi")
    return chosen.join(small(wanted, n_sources).drop("pi", "n_docs"), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))
