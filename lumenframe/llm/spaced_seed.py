"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks pick word positions and ignore those between, so a seed survives a
substituted word at an ignored place. Seeds of all different benchmark items are
joined with the seeds at every position of every document; each hit gives a
diagonal (document position minus item position), along which the words around
it are compared. A document leaks an item if half of the item's words (6 at
least) agree on one diagonal or on diagonals at most 8 apart (words inserted or
deleted), or if a part of it does densely: 25 words within 50 of the item, or 13
within 16 of one diagonal (an excerpt, with substitutions). Parts and
neighbouring diagonals count words in dense places only, three of five agreeing,
so that frequent words which agree here and there on a long diagonal add
nothing, and no word of the item or the document counts twice.

Defined cases: null and empty texts have no words and leak nothing; items of
five to seven words are matched as a whole only, and shorter ones match nothing;
equal items are all reported; repeated documents are all reported; rows of one
doc_id count as one document, and rows without doc_id are not reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.staging import Stages, small
from lumenframe.llm.wordgrams import word_hashes

#: Word offsets that a seed looks at. The first fits every item and survives each third to sixth word substituted, whatever the phase; all four
#: together survive any five substitutions in 15 words.
MASKS = ((0, 1, 3, 4), (0, 1, 5, 7), (0, 2, 9, 10), (0, 3, 5, 6))
LEAST_WORDS = 5
#: Words from which an item leaks by a part of it.
PART_WORDS = 8
COVERAGE = 0.5
#: Agreeing words of half an item at least: two more than a seed has by itself.
LEAST_MATCHED = 6
#: Dense agreeing words, and the words of the item within which they are a long part of it.
LONG_PART, LONG_SPAN = 25, 50
#: Words of all items (8 bytes each) that may be broadcast.
BROADCAST_WORDS = 4_000_000
#: Agreeing words, and the consecutive words of a diagonal in which they are an excerpt.
EXCERPT, EXCERPT_SPAN = 13, 16
#: How far apart diagonals may be whose agreeing words are taken together.
BAND = 8


def seeds(hashes: Column, mask: tuple[int, ...], tag: int) -> Column:
    """A hash for every position at which the mask fits."""
    last = F.size(hashes) - (mask[-1] + 1)
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(tag), *(F.get(hashes, i + o) for o in mask)))


def _hits(df: DataFrame, key: str, masks: tuple[tuple[int, ...], ...], pos: str) -> DataFrame:
    out = df.select(key, F.explode(F.array(*(F.struct(seeds(F.col("h"), m, t).alias("s")) for t, m in enumerate(masks)))).alias("_m"))
    return out.select(key, F.posexplode("_m.s").alias(pos, "seed"))


def crowded(at: Column, n: int, span: int) -> Column:
    """Whether n of the ascending positions lie within span."""
    last = F.size(at) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda j: F.get(at, j + (n - 1)) - F.get(at, j) < span)


def dense(at: Column) -> Column:
    """The ascending positions that have two others at most two places away."""
    near = lambda j, a, b: F.coalesce((F.abs(F.get(at, j + a) - F.get(at, j)) <= 2) & (F.abs(F.get(at, j + b) - F.get(at, j)) <= 2), F.lit(False))
    return F.filter(at, lambda x, j: near(j, -2, -1) | near(j, -1, 1) | near(j, 1, 2))


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, coverage: float = COVERAGE, long_part: int = LONG_PART) -> DataFrame:
    """doc_id, item_id, doc_start (word), n_matched, n_words, coverage: the best diagonal of every leaked item of a document, with its neighbours where they add words."""
    stages = Stages(docs.sparkSession, "seeds")
    listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("h")).filter((F.size("h") >= LEAST_WORDS) & F.col("item_id").isNotNull())
    same = stages.write(listed.groupBy("h").agg(F.min("item_id").alias("one"), F.collect_set("item_id").alias("ids")))
    items = same.select(F.col("one").alias("item_id"), "h")
    n_words = items.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
    marks = stages.write(_hits(items, "item_id", masks, "item_pos").withColumnRenamed("seed", "mark"))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("h")).filter("doc_id is not null")
    found = _hits(words, "doc_id", masks, "pos").join(small(marks), F.col("seed") == F.col("mark"))
    diagonals = stages.write(found.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct())
    n_diagonals = diagonals.count()
    ids = diagonals.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(ids, n_diagonals), "doc_id")
    near = texts.select("doc_id", word_hashes(F.col("text")).alias("h")).join(small(diagonals, n_diagonals), "doc_id")
    near = near.join(small(items.withColumnRenamed("h", "item_h"), n_words, BROADCAST_WORDS), "item_id")
    skip = F.greatest(-F.col("diagonal"), F.lit(0))
    begin = F.greatest(F.col("diagonal"), F.lit(0))
    length = F.greatest(F.least(F.size("item_h") - skip, F.size("h") - begin), F.lit(0))
    agree = F.zip_with(F.slice("h", begin + 1, length), F.slice("item_h", skip + 1, length), lambda a, b: a == b)
    at = F.filter(F.transform(agree, lambda x, i: F.when(x, i + skip)), lambda i: i.isNotNull())
    near = near.select("doc_id", "item_id", "diagonal", F.size("item_h").cast("long").alias("n_words"), at.alias("at"))
    all_ = F.size("at").cast("long")
    spots = F.when(all_ < F.col("n_words"), dense(F.col("at"))).otherwise(F.array().cast("array<int>"))  # a whole copy gains nothing from its neighbours
    near = near.select("doc_id", "item_id", "n_words", F.struct("diagonal", all_.alias("all"), crowded(F.col("at"), EXCERPT, EXCERPT_SPAN).alias("excerpt"), spots.alias("at")).alias("d"))
    near = near.groupBy("doc_id", "item_id", "n_words").agg(F.array_sort(F.collect_set("d")).alias("ds"))
    # diagonals are distinct, so those up to BAND further are among the next BAND
    with_next = F.transform("ds", lambda d, k: F.struct(d["diagonal"].alias("diagonal"), d["all"].alias("all"), d["excerpt"].alias("excerpt"), F.filter(F.slice(F.col("ds"), k + 1, BAND + 1), lambda x: x["diagonal"] <= d["diagonal"] + BAND).alias("next")))
    near = near.select("doc_id", "item_id", "n_words", F.explode(with_next).alias("d")).select("doc_id", "item_id", "n_words", "d.*")
    in_item = F.array_sort(F.array_distinct(F.flatten("next.at")))
    in_doc = F.size(F.array_distinct(F.flatten(F.transform("next", lambda x: F.transform(x["at"], lambda i: i + x["diagonal"])))))
    near = near.withColumn("spots", in_item).withColumn("in_doc", in_doc)
    half = F.col("all") >= coverage * F.col("n_words")
    band = F.least(F.size("spots"), F.col("in_doc")).cast("long")
    near = near.select("doc_id", "item_id", "diagonal", "n_words", "all", "excerpt", ((F.col("in_doc") >= long_part) & crowded(F.col("spots"), long_part, LONG_SPAN)).alias("long"), F.greatest(F.when(half, F.col("all")).otherwise(F.lit(0)), band).alias("n_matched"))
    enough = (F.col("n_matched") >= coverage * F.col("n_words")) & (F.col("n_matched") >= LEAST_MATCHED)
    part = (F.col("n_words") >= PART_WORDS) & (enough | F.col("long") | F.col("excerpt"))
    near = near.filter(part | (F.col("all") == F.col("n_words")))
    best = near.groupBy("doc_id", "item_id", "n_words").agg(F.max(F.struct("n_matched", "all", (-F.col("diagonal")).alias("_d"))).alias("_b"))
    best = best.join(small(same.select(F.col("one").alias("item_id"), "ids"), n_words, BROADCAST_WORDS), "item_id").withColumn("item_id", F.explode("ids"))
    return best.select("doc_id", "item_id", F.greatest(-F.col("_b._d"), F.lit(0)).cast("long").alias("doc_start"), "_b.n_matched", "n_words", (F.col("_b.n_matched") / F.col("n_words")).alias("coverage"))
