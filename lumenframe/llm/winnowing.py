"""Document fingerprints by winnowing, in DataFrame functions only.

Words (A-Z lowered) are hashed; hashes of k = 5 words roll over the text by
combining the hashes of its halves; of every window of 16 of them the least is
kept, the rightmost of equals. Any run of k + window - 1 = 20 words that two
texts share gives them a common fingerprint; positions are kept.

Defined cases: a null text is the empty text, whose fingerprint is the empty
string; a text of one to four words has one hash of all its words at position 0;
a text with fewer than 16 word groups has one window; two empty fingerprints
have likeness 1, an empty and a full one 0; rows of equal doc_id follow each
other by a hash of the text; a null doc_id comes after all others; any 64-bit
doc_id may occur; rows equal in doc_id and text share a block. Positions count words and are exact up to 2**26 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.staging import Stages
from lumenframe.llm.wordgrams import shifted, word_hashes

K = 5
WINDOW = 16
_POS_BITS = 26
#: Documents of a neighbourhood block (about), the most blocks, and the keys sampled for each of their bounds: 34 MB at most.
BLOCK_DOCS = 512
MOST_BLOCKS = 1 << 16
BOUND_SAMPLES = 16
#: Characters of text that a task of neighbours should hold.
TASK_CHARS = 8_000_000


def with_winnow(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: array<long>, per kept hash its 37 high bits and below them the position counted from above."""
    g, n = f"_g_{out}", f"_n_{out}"
    df = df.withColumn(g, word_hashes(F.col(text)))
    df = df.withColumn(n, F.size(g))
    whole = F.array(F.aggregate(g, F.lit(0).cast("long"), lambda a, h: F.xxhash64(a, h)))
    df = df.withColumn(out, F.zip_with(g, shifted(F.col(g), 1), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(out, F.zip_with(out, shifted(F.col(out), 2), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(out, F.zip_with(out, shifted(F.col(g), 4), lambda a, b: F.xxhash64(a, b)))
    grams = F.when(F.col(n) >= K, F.slice(out, 1, F.greatest(F.col(n) - (K - 1), F.lit(0)))).when(F.col(n) > 0, whole).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(g, grams)
    top = (1 << _POS_BITS) - 1
    df = df.withColumn(out, F.transform(g, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, _POS_BITS + 1), _POS_BITS).bitwiseOR(F.lit(top).cast("long") - i)))
    step = 1
    while step < WINDOW:
        df = df.withColumn(out, F.zip_with(out, shifted(F.col(out), step), lambda a, b: F.least(a, b)))
        step *= 2
    windows = F.when(F.size(g) > 0, F.greatest(F.size(g) - (WINDOW - 1), F.lit(1))).otherwise(0)
    return df.withColumn(out, F.array_distinct(F.slice(out, 1, windows))).drop(g, n)


def fingerprint_text(kept: Column) -> Column:
    """hash:position, comma-joined in order of position."""
    top = (1 << _POS_BITS) - 1
    return F.array_join(F.transform(kept, lambda v: F.concat(F.hex(F.shiftright(v, _POS_BITS)), F.lit(":"), F.lit(top) - v.bitwiseAND(F.lit(top).cast("long")))), ",")


def hash_set(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: F.shiftright(v, _POS_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def order_key(doc_id: Column, text: Column) -> Column:
    """A string whose order is that of descending doc_id, nulls last, then of a hash of the text."""
    down = F.bitwise_not(doc_id).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.coalesce(F.lpad(F.hex(down), 16, "0"), F.lit("G")), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def block_of(key: Column, bounds: list[str]) -> Column:
    """How many of the ascending bounds are not above the key, by binary search."""
    if not bounds:
        return F.lit(0)
    listed, n = F.split(F.lit(",".join(bounds)), ","), len(bounds)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(listed, F.least(at + step, F.lit(n)) - 1) <= key), at + step).otherwise(at))


def with_next(df: DataFrame, carried: list[str], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """df(doc_id long, text, ...) with next_<c> for c in carried, of the next row by descending doc_id (after the last: of the first).

    Rows are dealt into blocks by bounds taken from a sample of the order keys,
    so blocks are even for any spread of ids and split rows of one id; a block's
    first row also goes, marked as a copy, to the block before it, where it is
    the neighbour of the last row. The sample decides about the blocks only.
    """
    stages = Stages(df.sparkSession, "winnow")
    key = order_key(F.col("doc_id"), F.col("text"))
    n, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_blocks = max(1, min(MOST_BLOCKS, -(-n // block_docs)))
    tasks = max(1, min(n_blocks, -(-chars // TASK_CHARS)))
    scale = 1 << 30
    share = min(scale, -(-scale * BOUND_SAMPLES * n_blocks // max(n, 1)))
    seen = df.select(key.alias("k")).filter(F.pmod(F.xxhash64("k"), F.lit(scale)) < share)
    picks = F.transform(F.sequence(F.lit(1), F.lit(n_blocks)), lambda i: F.get("ks", (i * F.size("ks") / F.lit(n_blocks)).cast("int")))
    bounds = seen.agg(F.array_sort(F.collect_set("k")).alias("ks")).select(F.array_distinct(F.array_compact(picks)).alias("b")).first()["b"]
    df = df.withColumn("_key", key).withColumn("_b", block_of(F.col("_key"), bounds))
    heads = df.groupBy("_b").agg(F.min("_key").alias("_head"))
    heads = heads.withColumn("_to", F.coalesce(F.lag("_b").over(Window.orderBy("_b")), F.max("_b").over(Window.partitionBy())))
    heads = stages.write(heads.select("_head", "_to"))
    own = F.array(F.struct(F.col("_b"), F.lit(False).alias("_copy")))
    both = F.array(F.struct(F.col("_b"), F.lit(False).alias("_copy")), F.struct(F.col("_to").alias("_b"), F.lit(True).alias("_copy")))
    dealt = (
        df.join(F.broadcast(heads), F.col("_key") == F.col("_head"), "left")
        .withColumn("_at", F.explode(F.when(F.col("_to").isNull(), own).otherwise(both)))
        .drop("_b", "_head", "_to")
        .select("*", "_at._b", "_at._copy")
        .drop("_at")
        .repartition(tasks, "_b")
    )
    order = Window.partitionBy("_b").orderBy("_copy", "_key")
    for c in carried:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.filter(~F.col("_copy")).drop("_b", "_copy", "_key")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every text and its edited text (second half replaced by the start of the next document) with fingerprints and likenesses."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = with_winnow(base, "text", "kept")
    df = with_next(base, ["text", "kept"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("n_chars", n.cast("long"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))).drop("text", "next_text")
    df = with_winnow(df, "edited", "edited_kept")
    df = df.withColumn("_s", hash_set(F.col("kept"))).withColumn("_e", hash_set(F.col("edited_kept"))).withColumn("_x", hash_set(F.col("next_kept")))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("kept")).alias("fingerprint"),
        fingerprint_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("_s"), F.col("_e")).alias("near_edited"),
        likeness(F.col("_s"), F.col("_x")).alias("near_next"),
    )
