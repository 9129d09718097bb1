"""Near duplicates by chosen-path set similarity join over minhash tokens.

A document's set holds its distinct 5-word shingles. Equal sets are one class,
stood for by its smallest doc_id. Every class has 64 minwise tokens. In each of
12 independent trees the classes branch by such a token: those that agree on it
share a node. Two classes of similarity 0.75 miss each other in all trees with
probability 0.25**12.

Links are found in two passes. Hubs: in every node the smallest doc_id leads,
and pairs of leader and follower that meet in three trees or more are confirmed
on full sets; this is linear in a node's size and joins groups of near copies of
any size. Nodes: those whose classes still lie in different components branch on,
by two tokens of the node's choice, then by one and one, until they are small
(256) and are compared exhaustively on the 64 tokens; what three levels do not
divide is compared in blocks. Classes that agree on half of the tokens or more
with one that is not connected to them yet are compared on full sets within
their node, which gives as few links as join its components. Two classes of
similarity 0.75 part on all paths of a tree that branches at all three levels
with probability 0.5, and in all trees, if all are that large, with 0.5**12.

Defined cases: null, empty and blank texts have an empty set and link with
nothing; texts of one to four words have one shingle; doc_id is a key, and
repeated rows of one doc_id are each returned with its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import textvec
from lumenframe.llm.staging import Stages, small

TOKENS = 64
TREES = 12
#: Tokens that a large node of each level branches by at once.
BRANCHES = (2, 1, 1)
NODE = 256
LEAST_AGREE = 32
HUB_TREES = 3
_HUB_FAN = 64

_rng = np.random.Generator(np.random.PCG64(20240501))
_MULT = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def minwise(items: np.ndarray) -> np.ndarray:
    """64 minwise tokens (uint32) of a set of hashes."""
    best = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(items), 4096):
        part = items[at : at + 4096, None] * _MULT + _ADD
        best = np.minimum(best, (part >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return best


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for first, last, data, offsets in textvec.chunks(column):
        grams, rows = textvec.shingles(*textvec.words(data, offsets))
        ends = np.searchsorted(rows, np.arange(last - first + 1))
        for i in range(last - first):
            yield np.unique(grams[ends[i] : ends[i + 1]])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, tokens = [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            tokens.append(minwise(s).view(np.int32) if len(s) else np.zeros(TOKENS, np.int32))
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TOKENS, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "tokens"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, 64 minwise tokens."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, tokens array<int>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leader = None, None
        for batch in batches:
            out_a, out_b = [], []
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for (a, part, b), s in zip(keys, shingle_sets(batch.column(3)), strict=True):
                if b == -1:
                    held, leader = (a, part), s
                elif held == (a, part) and similar(leader, s, percent):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def confirm(docs: DataFrame, pairs: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """The pairs (a, b) of doc_ids, -1 < both, that are similar on full sets.

    Each a's text is sent once for every 64 of its partners, which follow it in
    the same sorted partition.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / _HUB_FAN).cast("long").alias("parts"))
    dealt = stages.write(pairs.join(fan, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b"))
    wanted = dealt.select(F.col("b").alias("id"), "a", "part", "b").unionByName(dealt.select("a", "part").distinct().select(F.col("a").alias("id"), "a", "part", F.lit(-1).cast("long").alias("b")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    n = dealt.count()
    rows = texts.join(small(wanted, n), "id").select("a", "part", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "b")
    out = stages.write(rows.mapInArrow(_confirm(percent), "a long, b long"))
    stages.drop(dealt)
    return out


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """doc_id, component: the least doc_id reachable, for every end of an edge (a, b). Labels are cut to shorter ones until none changes."""
    both = stages.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stages.write(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["doc_id"] == near["a"]).select("doc_id", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        step = step.join(labels.select(F.col("doc_id").alias("_l"), F.col("component").alias("_far")), F.col("component") == F.col("_l"), "left")
        step = step.select("doc_id", F.coalesce("_far", "component").alias("component"), (F.col("moved") | (F.coalesce("_far", "component") < F.col("component"))).alias("moved"))
        after = stages.write(step)
        stages.drop(labels)
        labels = after.select("doc_id", "component")
        labels._stage_path = after._stage_path
        if not after.filter("moved").limit(1).count():
            return labels


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The parts of each node of sorted batches (the node is the first column), one node at a time."""
    held: list[pa.RecordBatch] = []
    node = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[lo] != node:
                yield held
                held = []
            node = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def _column(parts: list[pa.RecordBatch], i: int) -> np.ndarray:
    return np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts])


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (node, side, doc, component, tokens) those that agree on enough tokens with a row of another component in their node. A row of side 1 is compared with side 0 only."""
    for parts in _nodes(batches):
        side, comp = _column(parts, 1), _column(parts, 3)
        if comp.min() == comp.max():
            continue
        tok = np.concatenate([p.column(4).flatten().to_numpy(zero_copy_only=False) for p in parts]).reshape(-1, TOKENS)
        left = np.flatnonzero(side == 0)
        crossed = bool((side == 1).any())
        right = np.flatnonzero(side == 1) if crossed else left
        near = np.zeros(len(side), bool)
        for i in left:
            other = right[comp[right] != comp[i]]
            good = other[(tok[other] == tok[i]).sum(axis=1) >= LEAST_AGREE]
            if len(good):
                near[i] = True
                near[good] = True
        for p, lo in zip(parts, np.cumsum([0, *(p.num_rows for p in parts[:-1])]), strict=True):
            kept = p.select([0, 1, 2, 3]).filter(pa.array(near[lo : lo + p.num_rows]))
            if kept.num_rows:
                yield kept


_CELLS = 4_000_000


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over blocks of the items."""
    item, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, _CELLS // len(sets))
    for lo in range(0, len(item), width):
        i, j = np.searchsorted(at, (lo, lo + width))
        m = np.zeros((len(sets), min(width, len(item) - lo)), np.float32)
        m[owner[i:j], at[i:j] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _links(percent: int):
    """Of sorted rows (node, side, doc, component, text): links of full sets that join the components of a node, as few as do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _nodes(batches):
            side, doc, comp = (_column(parts, i) for i in (1, 2, 3))
            sets = [s for p in parts for s in shingle_sets(p.column(4))]
            size = np.array([len(s) for s in sets])
            both = intersections(sets)
            good = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            good &= (comp[:, None] != comp[None, :]) & (side[:, None] == 0) & (side[None, :] == (1 if (side == 1).any() else 0))
            up = {c: c for c in comp.tolist()}

            def top(c: int, up: dict = up) -> int:
                while up[c] != c:
                    up[c] = c = up[up[c]]
                return c

            out_a, out_b = [], []
            for i, j in zip(*np.nonzero(good), strict=True):
                x, y = top(int(comp[i])), top(int(comp[j]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out_a.append(min(int(doc[i]), int(doc[j])))
                    out_b.append(max(int(doc[i]), int(doc[j])))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    stages = Stages(spark, "paths")
    sigs = stages.write(signatures(docs))
    full = sigs.filter("n_shingles > 0")
    reps = stages.write(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    classes = stages.write(full.join(reps.select("digest", "rep"), "digest").filter("doc_id = rep").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("doc"), "tokens"))
    key = lambda t: F.shiftleft(F.lit(t).cast("long"), 32) + F.get("tokens", F.lit(t)).cast("long")
    members = classes.select("doc", F.explode(F.array(*map(key, range(TREES)))).alias("node"))
    nodes = stages.write(members.groupBy("node").agg(F.min("doc").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = stages.write(members.join(nodes, "node"))
    hubs = met.filter("doc <> a").groupBy("a", F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("trees")).filter(F.col("trees") >= HUB_TREES).select("a", "b")
    links = confirm(docs, hubs, percent, stages)
    labels = components(links, stages)

    known = stages.write(met.select("node", "doc").join(labels.select(F.col("doc_id").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc")))

    def mixed(df: DataFrame) -> DataFrame:
        """node, n of the nodes with more than one component. A table of its own, so that a large node's rows can be split in the join."""
        return stages.write(df.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("node", "n"))

    open_ = stages.write(known.join(mixed(known), "node").join(classes, "doc").select("node", "doc", "component", "tokens", "n"))
    stages.drop(nodes, met, known, classes)
    ready = [open_.filter(F.col("n") <= NODE).drop("n").withColumn("side", F.lit(0))]
    large = open_.filter(F.col("n") > NODE)
    for level in range(1, len(BRANCHES) + 1):
        if not large.limit(1).count():
            break
        # The node chooses which tokens it branches by, so paths differ between nodes and levels.
        fan = BRANCHES[level - 1]
        first = TREES + fan * F.pmod(F.xxhash64("node", F.lit(level)), F.lit((TOKENS - TREES) // fan)).cast("int")
        paths = F.array(*(F.xxhash64("node", F.lit(b), F.get("tokens", first + b)) for b in range(fan)))
        deeper = large.withColumn("node", F.explode(paths)).drop("n")
        deeper = stages.write(deeper.join(mixed(deeper), "node"))
        ready.append(deeper.filter(F.col("n") <= NODE).select("node", "doc", "component", "tokens").withColumn("side", F.lit(0)))
        large = deeper.filter(F.col("n") > NODE)
    # What no level divides is compared block against block.
    blocks = F.ceil(F.col("n") / NODE).cast("long")
    large = large.withColumn("_k", blocks).withColumn("_own", F.pmod(F.xxhash64("doc"), "_k"))
    crossed = large.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    ready.append(crossed.select(F.xxhash64("node", lo, hi).alias("node"), "doc", "component", "tokens", F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1).alias("side")))
    rows = ready[0]
    for df in ready[1:]:
        rows = rows.unionByName(df)
    rows = rows.select("node", "side", "doc", "component", "tokens").repartition("node").sortWithinPartitions("node", "side")
    near = stages.write(rows.mapInArrow(_partners, "node long, side int, doc long, component long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    full = texts.join(small(near), "doc").select("node", "side", "doc", "component", "text")
    more = stages.write(full.repartition("node").sortWithinPartitions("node", "side", "doc").mapInArrow(_links(percent), "a long, b long"))
    labels = components(links.unionByName(more), stages)
    stages.drop(open_, near, more, links)
    out = sigs.select("doc_id", "n_shingles", "digest").join(reps, "digest", "left").join(labels.select(F.col("doc_id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
