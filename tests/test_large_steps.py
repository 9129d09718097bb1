"""Steps that many queries share: what they hold does not grow with a table, and nothing is put together or made twice."""

import hashlib
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe import arrow
from lumenframe.operators import deid, entities, validate
from lumenframe.operators.select import references, references_within
from lumenframe.pixels import codecs
from lumenframe.plans import object_queries as q
from lumenframe.plans.pipeline import Pipeline
from lumenframe.plans.queries import QUERIES
from lumenframe.sinks import packages
from lumenframe.sinks import part10 as writer
from lumenframe.sources import part10
from lumenframe.sources.rows import element_rows, object_rows, source_bytes


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_are_small_and_whole():
    batch = pa.record_batch({"k": list(range(1000)), "b": [b"x" * (100_000 if k % 100 == 0 else 10) for k in range(1000)]})
    cut = list(arrow.pieces([batch], 256, 100_000))
    assert max(p.num_rows for p in cut) <= 256 and sum((p.column(0).to_pylist() for p in cut), []) == list(range(1000))
    rows = list(arrow.rows_of([batch, batch]))
    assert len(rows) == 2000 and rows[100].k == 100 and len(rows[100].b) == 100_000
    out = list(arrow.batches_of(((r.k, r.b) for r in rows), arrow.schema_of("k long, b binary")))
    assert sum(b.num_rows for b in out) == 2000 and len(out) <= 12 and max(b.num_rows for b in out) <= arrow.ROWS


def test_objects_of_equal_names_stay_apart(spark):
    docs = spark.createDataFrame([("1", "application/pdf", "t", bytearray(b"ab")), ("1", "application/pdf", "t", bytearray(b"cdef"))], "instance_id string, mime_type string, title string, bytes binary")
    made = q._objects(writer.write_objects(packages.wrapped_objects(docs)))
    assert sorted(bytes(r.content) for r in packages.unwrap_objects(part10.read_objects(made)).collect()) == [b"ab", b"cdef"]
    assert "collect_list" not in plan_of(made)


def test_planned_objects_are_those_of_their_element_rows(spark):
    docs = spark.createDataFrame([(str(i), "application/pdf", None if i % 3 else "t", bytearray(b"x" * i)) for i in range(40)], "instance_id string, mime_type string, title string, bytes binary")
    by_rows = {r.instance_id: bytes(r.content) for r in writer.write_bytes(packages.wrap_documents(docs)).collect()}
    assert {r.instance_id: bytes(r.content) for r in writer.write_objects(packages.wrapped_objects(docs)).collect()} == by_rows


@pytest.mark.parametrize("nested", [False, True])
def test_orders_are_written_without_putting_elements_together(spark, sf_dir, nested):
    assert "collect_list" not in plan_of(q.order_objects(spark, sf_dir, nested=nested))


# F1


def parts(spark):
    rows = [(str(k % 3) if k % 7 else None, f"{k % 50:03d}", None if k % 11 == 0 else bytearray(bytes([k % 256]) * (k * 37 % 5000))) for k in range(200)]
    return spark.createDataFrame(rows, "batch_id string, instance_id string, content binary").repartition(5)


def test_bodies_in_pieces_are_the_whole_bodies(spark):
    whole = {r.batch_id: bytes(r.body) for r in packages.multipart_body(parts(spark), "x", "text/plain").collect()}
    held: dict = {}
    for r in packages.multipart_pieces(parts(spark), "x", "text/plain", 10_000).orderBy("batch_id", "piece_no").collect():
        assert len(held.setdefault(r.batch_id, [])) == r.piece_no and len(r.piece) < 16_000
        held[r.batch_id].append(bytes(r.piece))
    assert {k: b"".join(v) for k, v in held.items()} == whole
    digests = {r.batch_id: (r.n_bytes, r.sha256) for r in packages.multipart_digests(parts(spark), "x", "text/plain").collect()}
    assert digests == {k: (len(b), hashlib.sha256(b).hexdigest()) for k, b in whole.items()}
    assert packages.multipart_digests(parts(spark).limit(0)).count() == 0


def test_a_body_is_never_in_a_row(spark, sf_dir):
    assert "collect_list" not in plan_of(QUERIES["q_multipart_body"](spark, sf_dir))


# F2


def test_picture_files_are_not_made_again_for_their_format(spark, sf_dir):
    plan = plan_of(QUERIES["q_picture_files"](spark, sf_dir))
    assert "Join" not in plan
    assert plan.count("Relation [") == 2  # each format's pictures are made and read once, not once for each kind of object


# F3


def test_rle_of_long_runs_and_literals():
    im = codecs.Image(1, 1200)
    for plane in (b"\n" * 1200, bytes(range(256)) * 4 + b"a" * 176, (b"ab" * 64 + b"c" * 129) * 4 + b"d" * 172, (b"aab" * 400)):
        coded = codecs.rle_encode(plane, im)
        assert codecs.rle_decode(coded, im) == plane and len(coded) % 2 == 0


# F7


def test_an_action_is_resolved_once_an_element(spark, sf_dir):
    parsed = part10.read_objects(q.order_objects(spark, sf_dir))
    masked = deid.deidentify_objects(parsed)
    assert plan_of(masked).lower().count("regexp_replace(") < 20  # 161 when each field resolved it again
    rows = {(r.instance_id, r.ordinal): (r.str, r.bin, r.ints) for r in deid.deidentify(element_rows(parsed)).collect()}
    assert {(r.instance_id, r.ordinal): (r.str, r.bin, r.ints) for r in element_rows(masked).collect()} == rows


# F8, F9, F11


@pytest.mark.parametrize("name", ["q_part10_syntaxes", "q_references", "q_skip_and_jump"])
def test_only_elements_that_are_used_are_decoded(spark, sf_dir, monkeypatch, name):
    seen = []
    read = part10.read_objects
    monkeypatch.setattr(part10, "read_objects", lambda objects, options=part10.Options(): seen.append(options) or read(objects, options))
    QUERIES[name](spark, sf_dir)
    assert seen and all(o.wanted and len(o.wanted) <= 3 for o in seen)


def test_heads_of_unknown_and_cut_elements():
    part10._HEADS.clear()
    known = b"\x10\x00\x20\x00LO\x02\x00AB"
    for _ in range(2):
        assert [r[6:11] for r in part10.parse("1", known)[0]] == [("00100020", "LO", 2, True, "AB")]
        with pytest.raises(part10.ParseError, match="unknown VR"):
            part10._Reader("1", b"\x10\x00\x20\x00??\x02\x00AB", part10.Options(strict=True)).header(0, "<", True)
        with pytest.raises(part10.ParseError, match="truncated element header"):
            part10._Reader("1", b"\x10\x00\x20\x00OB\x00\x00", part10.Options()).header(0, "<", True)
    for i in range(1000):  # lengths of implicit elements are no part of what is kept
        part10._Reader("1", b"\x10\x00\x20\x00" + i.to_bytes(4, "little"), part10.Options()).header(0, "<", False)
    assert len(part10._HEADS) < 10


@pytest.mark.parametrize("name", ["q_references", "q_skip_and_jump"])
def test_objects_are_made_and_read_once(spark, sf_dir, name):
    assert plan_of(QUERIES[name](spark, sf_dir)).count("Relation [") == 2  # orders and their lines, each 2 when read for both sides of a join


def test_references_within_are_references(spark):
    rows = [(str(i % 7) if i % 11 else None, "00081155" if i % 3 else "0020000E", i % 2 if i % 13 else None, None if i % 17 == 0 else f"1.{i % 19}") for i in range(300)]
    e = spark.createDataFrame(rows, "instance_id string, tag string, depth int, str string")
    there = F.col("str").rlike("[05]$")
    want = sorted(references(e, e.filter(there).select(F.col("str").alias("sop_instance_uid"))).collect(), key=repr)
    assert sorted(references_within(e, there).collect(), key=repr) == want and {r.resolved for r in want} == {True, False}


def test_written_elements_are_listed_as_arrow_lists_them():
    path = pa.list_(pa.struct([("tag", pa.string()), ("item", pa.int32())]))
    columns = [pa.array(["a", None, "ö"]), pa.array([b"a", None, b""]), pa.array([True, None, False]), pa.array([1, None, 1 << 62]), pa.array([1, 2, 3]), pa.array([[], [{"tag": "a", "item": 1}, {"tag": "b", "item": 0}], None], path), pa.array([None, []], path), pa.array([], path)]
    for c in columns:
        for part in (c, c.slice(1)):
            got = writer._listed(part)
            assert [list(x) if isinstance(x, tuple) else x for x in got] == ([x or [] for x in part.to_pylist()] if part.type == path else part.to_pylist())
            assert all(type(x) in (str, bytes, bool, int, list, tuple, type(None)) for x in got)


# F14


def test_validation_deals_large_inputs_to_more_partitions(spark, sf_dir, monkeypatch):
    e = q.broken_elements(spark, sf_dir)
    small = sorted(validate.validate(e).collect(), key=repr)
    monkeypatch.setattr(validate, "PARTITION_BYTES", 1 << 8)
    dealt = validate.validate(e)
    plan = plan_of(dealt)
    assert plan.count("RepartitionByExpression [instance_id") == 4 and "collect_set" not in plan and "Join" not in plan
    assert sorted(dealt.collect(), key=repr) == small and len(small) == e.select("instance_id").distinct().count()


def test_items_without_their_sequence(spark):
    one = lambda tag, vr, path: ("1", False, tag, vr, "".join(f"{t}[{i}]/" for t, i in path), len(path), path, 1)
    rows = [one("00081115", "SQ", []), one("0020000E", "UI", [("00081115", 0)]), one("00081199", "SQ", [("00081115", 0)]), one("00081150", "UI", [("00081115", 0), ("00081199", 1)]), one("00081155", "UI", [("00081199", 0)])]
    e = spark.createDataFrame(rows, "instance_id string, is_meta boolean, tag string, vr string, path_text string, depth int, path array<struct<tag:string,item:int>>, ordinal long")
    e = e.unionByName(e.withColumn("instance_id", F.lit("2")).filter("vr <> 'SQ'"))
    got = [(r.instance_id, r.tag, r.path_text) for r in validate.sequence_mismatches(e).collect()]
    assert sorted(got) == [("1", "00081155", "00081199[0]/"), ("2", "00081150", "00081115[0]/00081199[1]/"), ("2", "00081155", "00081199[0]/"), ("2", "0020000E", "00081115[0]/")]


# F15, F18


def test_a_subject_is_found_without_reading_again(spark, sf_dir):
    plan = plan_of(QUERIES["q_fhir_summary"](spark, sf_dir))
    assert plan.count("Relation [") == 1 and "Join" not in plan


def test_studies_are_sorted_without_a_comparator(spark, sf_dir):
    assert "array_sort(" not in plan_of(QUERIES["q_study_full"](spark, sf_dir))


# F20


def test_after_handlers_only_what_the_target_reads_is_put_together(spark, sf_dir):
    p = Pipeline(spark).from_reader(lambda _: q.order_objects(spark, sf_dir)).of("dicom").with_handler(lambda e: e).to_entities()
    assert {x.tag for r in p.parsed().collect() for x in r.elements} <= entities.NEEDED
    none = object_rows(element_rows(part10.read_objects(q.order_objects(spark, sf_dir))), ["00000000"]).collect()
    assert none and all(r.elements == [] and r.error_message is None for r in none)


# F10, F21


@pytest.mark.parametrize("name", ["q_wrap_unwrap", "q_parser_concerns", "q_nested_selection"])
def test_larger_sources_are_dealt_to_more_partitions(spark, sf_dir, monkeypatch, name):
    small = QUERIES[name](spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism
    assert small.rdd.getNumPartitions() == 3 * cores
    monkeypatch.setattr(packages, "PARTITION_BYTES", source_bytes(small) // (5 * cores))
    dealt = QUERIES[name](spark, sf_dir)
    assert dealt.rdd.getNumPartitions() == 5 * cores
    assert sorted(dealt.collect(), key=repr) == sorted(small.collect(), key=repr)
    monkeypatch.setattr(packages, "PARTITION_BYTES", 1)
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == 64 * cores


def test_sources_tell_their_bytes(spark, sf_dir):
    o, d = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "documents"))
    sizes = [os.path.getsize(f"{sf_dir}/{n}.parquet") for n in ("orders", "documents")]
    assert source_bytes(o.join(d, o["o_orderkey"] == d["doc_id"], "left")) == sum(sizes)  # a join is not the product of its sides
    assert source_bytes(spark.readStream.format("rate").load()) == 0 and source_bytes(spark.sparkContext.parallelize([(1,)]).toDF(["a"])) == 0
