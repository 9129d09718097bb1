import re

import pytest

import corpus_pipeline
from lumenframe.llm.staging import Stages


@pytest.fixture(scope="module")
def kept(spark):
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = Stages(spark, "test").write(stage(spark, docs, sf))
        out[name] = docs
    return out


def test_stages_keep_the_columns_of_documents(spark, kept):
    want = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dtypes
    assert all(kept[name].dtypes == want for name, _ in corpus_pipeline.STAGES[:-1])


def test_decisions_take_effect(kept):
    counts = [kept[name].count() for name, _ in corpus_pipeline.STAGES]
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    texts = [r.text for r in kept["redact_pii"].collect()]
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "") for t in texts)
    assert any("[EMAIL]" in (t or "") for t in texts)
    assert all(r.n_chars == len(r.text) for r in kept["redact_pii"].collect())


def test_mix_is_near_its_targets(kept):
    by = {}
    for r in kept["mix"].collect():
        taken, most, _ = by.get(r.source, (0, 0, 0))
        by[r.source] = (taken + r.taken, max(most, r["size"]), r.target)
    assert all(abs(taken - target) <= most for taken, most, target in by.values())


def test_empty_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def plain_identify(model, text):
    """(language, rejected) by dictionaries of trigrams."""
    import math
    from collections import Counter

    if text is None or not any(c.isalpha() for c in text):
        return "und", True
    letters = bytes(b if b >= 128 else b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in text.encode())
    body = b" " + letters + b" "
    counts = Counter(((int.from_bytes(body[i : i + 3], "big") * 2654435761) % 2**32) >> 20 for i in range(len(body) - 2) if body[i : i + 3] != b"   ")
    v = {d: math.log1p(n) * float(model.idf[d]) for d, n in counts.items()}
    size = math.sqrt(sum(x * x for x in v.values())) or 1.0
    cosines = [sum(x * float(c[d]) for d, x in v.items()) / size for c in model.vectors]
    k = max(range(len(cosines)), key=lambda i: cosines[i])
    return model.langs[k], cosines[k] < model.least[k] * math.sqrt(min(1.0, sum(counts.values()) / 400))


def test_language_stage_against_plain_python(spark):
    from lumenframe.llm import centroid_langid

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = centroid_langid.fit_on(docs)
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in centroid_langid.identify(docs, model).collect()}
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf).collect()}
    for r in docs.collect():
        want = plain_identify(model, r.text)
        assert got[r.doc_id] == want and (r.doc_id in kept) == (not want[1]), r.doc_id
