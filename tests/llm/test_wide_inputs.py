"""Ids of any width, very many spans, frequent words, clashing columns: against plain Python."""

import hashlib
import re
import time
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import queries, scans, spaced_seed, weak_pii, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


# Neighbours by descending doc_id


def after(rows):
    """The ids (of what a row may be followed by) for each id: equal ids may follow each other in any order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return {(a[0], a[1]): b for a, b in zip(order, [*order[1:], order[0]], strict=True)}


@pytest.mark.parametrize("ids", [[-9 * 10**18, 9 * 10**18], [-(2**63), 2**63 - 1, 0, -1, 1], [*range(300), 2**60], [*(i * 7919**4 - 5 * 10**18 for i in range(1, 900))], [5], [None, 3, 1]])
def test_neighbours_of_any_ids(spark, ids):
    rows = [(i, f"text of {i}") for i in ids]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(4)
    got = winnowing.with_next(df, ["text", "doc_id"], block_docs=4).collect()
    want = after(rows)
    assert len(got) == len(rows)
    assert all((r.next_doc_id, r.next_text) == want[r.doc_id, r.text] for r in got)


def test_rows_of_one_id_are_split_and_followed_once(spark):
    rows = [(7, f"t{i}") for i in range(200)] + [(i, "same") for i in range(5)] + [(3, "same")] * 3
    got = winnowing.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"], block_docs=8).collect()
    assert len(got) == len(rows)
    seen = defaultdict(int)
    for r in got:
        seen[r.next_doc_id, r.next_text] += 1
    want = defaultdict(int)
    for r in rows:
        want[r] += 1
    assert seen == want, "every row follows exactly one"
    assert sum(r.doc_id == 7 and r.next_doc_id != 7 for r in got) == 1


def test_an_outlier_does_not_fill_one_block(spark):
    rows = [(i, f"t{i}") for i in range(4000)] + [(2**60, "far"), (None, "none")]
    key = winnowing.order_key(F.col("doc_id"), F.col("text"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bounds = sorted(r[0] for r in df.select(key).sample(0.2, 3).collect())[::20]
    sizes = [r["count"] for r in df.groupBy(winnowing.block_of(key, bounds).alias("b")).count().collect()]
    assert len(sizes) >= len(bounds) and max(sizes) < 800
    keys = sorted(r[0] for r in df.select(key).collect())
    for r in df.select(key.alias("k"), winnowing.block_of(key, bounds).alias("b")).collect():
        assert r.b == sum(x <= r.k for x in bounds)
    assert [r.doc_id for r in df.withColumn("k", key).orderBy("k").collect()] == [2**60, *reversed(range(4000)), None] and len(set(keys)) == len(rows)


# Spans


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1024, 1025, 5000])
def test_running_totals(spark, n):
    x = np.random.default_rng(n).integers(-50, 50, n).tolist()
    df = spark.createDataFrame([(x,)], "x array<int>")
    r = df.select(scans.running_sum(F.col("x")).alias("s"), scans.running_max(F.col("x")).alias("m")).first()
    assert r.s == [0, *accumulate(x)]
    assert r.m == list(accumulate(x, max, initial=-1))


def cut_out(text, spans):
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{weak_pii.KINDS[kind].upper()}]"]
            at = end
        at = max(at, end)
    return "".join(out) + text[at:]


def kept(base, extra):
    return sorted(base + [e for e in extra if not any(b[0] < e[2] and e[0] < b[2] for b in base)])


def test_redaction_and_choice_of_random_spans(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        n = int(rng.integers(0, 3000 if i % 9 == 0 else 80))
        text = "".join(rng.choice(list("aé𝔘 \n9"), n).tolist())
        spans = lambda k: sorted((int(a), int(rng.integers(k, k + 4)), int(min(n, a + rng.integers(1, 30)))) for a in rng.integers(0, n, n // 25)) if n else []  # noqa: E731,B023
        extra, at = [], 0
        for s in spans(4):  # candidates do not overlap each other
            if s[0] >= at:
                extra.append(s)
                at = s[2]
        rows.append((i, text, spans(0), extra))
    df = spark.createDataFrame(rows, "doc_id long, text string, base array<struct<start:int,kind:int,end:int>>, extra array<struct<start:int,kind:int,end:int>>")
    model = weak_pii.SpanModel(bias=9.0)
    out = df.withColumn("spans", weak_pii.chosen(F.col("base"), F.col("extra"), model)).withColumn("cut", weak_pii.redacted(F.col("text"), F.col("spans"))).collect()
    for r, (_, text, base, extra) in zip(sorted(out, key=lambda r: r.doc_id), rows, strict=True):
        want = kept(base, extra)
        assert [tuple(s) for s in r.spans] == want
        assert r.cut == cut_out(text, want)


def test_a_text_of_a_hundred_thousand_spans(spark, tmp_path):
    one = "é a1@b.example token=abc123def456ghi 8.8.8.8\n"
    many = one * 33_000
    path = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, many), (2, one)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    queries.op7_weak_pii(spark, path).filter("doc_id = 2").collect()
    at = time.time()
    got = {r.doc_id: r for r in queries.op7_weak_pii(spark, path).collect()}
    assert time.time() - at < 60
    assert (got[1].n_email, got[1].n_ip) == (33_000, 33_000)
    want = [f"{k}:{i * len(one) + m.start()}:{i * len(one) + m.end()}" for i in range(33_000) for k, m in (("email", re.search(r"a1@b\.example", one)), ("ip", re.search(r"8\.8\.8\.8", one)))]
    assert got[1].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    at = time.time()
    out = weak_pii.redact(spark.read.parquet(f"{path}/documents.parquet"), weak_pii.SpanModel(bias=9.0)).collect()
    assert time.time() - at < 60
    texts = {r.doc_id: r.text for r in out}
    assert texts[2] == "é [EMAIL] [SECRET] [IP]\n" and texts[1] == texts[2] * 33_000


# Decontamination


def dense(at):
    near = lambda j, a, b: 0 <= j + a < len(at) and 0 <= j + b < len(at) and abs(at[j + a] - at[j]) <= 2 and abs(at[j + b] - at[j]) <= 2
    return [x for j, x in enumerate(at) if near(j, -2, -1) or near(j, -1, 1) or near(j, 1, 2)]


def crowded(at, n, span):
    return any(at[j + n - 1] - at[j] < span for j in range(len(at) - n + 1))


def brute_leak(doc, item):
    """Whether all diagonals of a document and an item, without seeds, show a leak."""
    n = len(item)
    if n < 5:
        return False
    where = defaultdict(list)
    for i, w in enumerate(item):
        where[w].append(i)
    by = defaultdict(list)
    for p, w in enumerate(doc):
        for i in where.get(w, ()):
            by[p - i].append(i)
    by = {d: sorted(at) for d, at in by.items()}
    if any(len(at) == n for at in by.values()):
        return True
    if n < 8:
        return False
    for d in by:
        if len(by[d]) >= max(6, n / 2) or crowded(by[d], 13, 16):
            return True
        near = [(e, dense(by[e])) for e in range(d, d + 9) if e in by]
        items = sorted({i for _, at in near for i in at})
        docs = {i + e for e, at in near for i in at}
        matched = min(len(items), len(docs))
        if matched >= max(6, n / 2) or (len(docs) >= 25 and crowded(items, 25, 50)):
            return True
    return False


def test_leaks_are_those_of_all_diagonals(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: words(r.text) for r in queries.table(spark, sf, "documents").collect()}
    items = {r.item_id: words(r.text) for r in queries.table(spark, sf, "benchmark").limit(60).collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op10_spaced_seed(spark, sf).collect() if r.item_id in items}
    grams = {i: set(zip(w, w[1:], w[2:], strict=False)) for i, w in items.items()}
    want = set()
    for d, doc in docs.items():
        own = set(zip(doc, doc[1:], doc[2:], strict=False))
        for i, item in items.items():
            if len(own & grams[i]) >= 2 and brute_leak(doc, item):  # a leak without two equal runs of three words is not planted here
                want.add((d, i))
    assert got >= want and all(brute_leak(docs[d], items[i]) for d, i in got)


def test_frequent_words_and_a_stock_phrase_are_no_leak(spark):
    rng = np.random.default_rng(8)
    vocab, p = [f"w{i}" for i in range(2000)], 1 / np.arange(1, 2001)
    draw = lambda n: rng.choice(vocab, n, p=p / p.sum()).tolist()
    phrase = [f"s{i}" for i in range(9)]
    item = draw(350) + phrase + draw(350)
    rows = [(i, " ".join(draw(700) + phrase + draw(800))) for i in range(40)]
    rows += [(100, " ".join(draw(700) + item[300:400] + draw(800))), (101, " ".join(draw(500) + [w if i % 4 else "other" for i, w in enumerate(item)]))]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = {(r.doc_id, r.item_id) for r in spaced_seed.leaks(frame(rows, "doc_id"), frame([(1, " ".join(item)), (2, " ".join(item)), (None, "a b c d e")], "item_id")).collect()}
    assert got == {(d, i) for d in (100, 101) for i in (1, 2)}


def test_items_beyond_the_broadcast_bound_are_joined_by_shuffles(spark, monkeypatch):
    item = " ".join(f"t{i}" for i in range(30))
    monkeypatch.setattr(spaced_seed, "BROADCAST_WORDS", 0)
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = spaced_seed.leaks(frame([(1, "x " + item), (None, item), (2, None)], "doc_id"), frame([(5, item)], "item_id")).collect()
    assert [(r.doc_id, r.item_id, r.doc_start) for r in got] == [(1, 5, 1)]


# The pipeline


CLASH = "doc_id long, text string, lang string, source string, n_chars long, base string, extra string, spans string, seed string, _dropped long, h long, component string"


def test_stages_keep_clashing_columns_nulls_and_ties(spark):
    prose = [r for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect() if r.text and r.lang and len(r.text) > 400][:60]
    more = lambda i: (f"b{i}", "e", "s", "x", i, -i, "c")
    rows = [(r.doc_id, r.text, r.lang, r.source, len(r.text), *more(i)) for i, r in enumerate(prose)]
    rows += [(10**9 + i, prose[0].text, "en", None, 1, *more(i)) for i in range(3)]
    rows += [(10**9 + 9, None, None, None, 0, *more(1)), (10**9 + 10, "", "en", "a", 0, *more(1)), (None, prose[1].text, None, None, None, *more(2)), (None, None, None, None, None, *more(2))]
    mixed_up = " ".join(np.random.default_rng(1).permutation([w for r in prose if r.lang == "en" for w in words(r.text) if w.isalpha()]).tolist())
    rows += [(10**9 + 11, f"write to me@x.org {mixed_up}", "en", "a", 1, *more(3))]
    docs = spark.createDataFrame(rows, CLASH)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.Stages(spark, "t").write(stage(spark, kept, "/root/testdata/sf0.001"))
        assert kept.dtypes == docs.dtypes, name
    by = {r[0]: r for r in rows if r[0] is not None}
    out = kept.collect()
    for r in out:
        if r.doc_id in by:
            assert tuple(r)[5:] == by[r.doc_id][5:], "extra columns are untouched"
    ids = [r.doc_id for r in out]
    assert 10**9 not in ids and 10**9 + 9 not in ids and 10**9 + 10 not in ids and ids.count(None) == 2
    long = next(r for r in out if r.doc_id == 10**9 + 11)
    assert long.text.startswith("write to [EMAIL] ") and long.n_chars == len(long.text)
    assert next(r for r in out if r.doc_id is None and r.text is None).n_chars is None
    mixed = corpus_pipeline.mix(spark, kept, "")
    assert mixed.count() == len(out)


def test_redaction_is_that_of_plain_python_for_base_spans(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    out = {r.doc_id: r.text for r in corpus_pipeline.redact_pii(spark, docs, "/root/testdata/sf0.01").collect()}
    changed = 0
    for r in docs.collect():
        t = r.text
        if t is None or not re.search(r"[0-9=:@+]", t):
            assert out[r.doc_id] == t
            continue
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
            assert m[0] not in out[r.doc_id]
            changed += 1
        rest = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|SECRET|SSN|IBAN|LOCAL_PHONE)\]", out[r.doc_id])
        at = 0
        for piece in rest:  # what is left stands in the text in its order
            at = t.index(piece, at) + len(piece)
    assert changed > 10
