"""Whole objects: one parse for every target, outputs, assets, codecs of users, order and losses."""

import datetime
import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.dictionary import EXPLICIT, KEYWORDS, RLE
from lumenframe.operators import deid, fhir, frames, validate
from lumenframe.operators.mapping import Mapping
from lumenframe.operators.select import Selection
from lumenframe.pixels import codecs, jpeg, jpeg2000, jpegls
from lumenframe.plans.pipeline import BuildError, Pipeline
from lumenframe.sources import objects, part10
from lumenframe.sources.rows import element_rows, object_rows
from lumenframe.streaming import streams
from test_imaging import PIXELS, element, part10_bytes

LS_VECTOR = bytes.fromhex("ffd8fff7000b080004000401011100ffda0008010100000000c000006c80208e01c00000574000006ee6000001bc18000005d800009160ffd9")


def parts(*items):
    body = b"".join(b"--b\r\nContent-Type: application/dicom\r\n\r\n" + x + b"\r\n" for x in items)
    return body + b"--b--"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_selection_finds_nested_tags_after_the_selected_one(spark):
    p = Pipeline(spark).from_bytes([("a", part10_bytes())]).of("dicom")
    for q in (p, p.with_validation()):
        rows = q.to_selection(Selection("00081155")).build().collect()
        assert sorted((r.path_text, r.str) for r in rows) == [("00082112[0]/", "1.2.4"), ("00082112[1]/", "1.2.5")]


def test_wanted_tags_keep_their_ordinals(spark):
    whole = {r.ordinal: (r.tag, r.str) for r in part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes())])).collect()}
    some = part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes())]), part10.Options(wanted=frozenset({"00100010", "00081155"}))).collect()
    assert len(some) == 4 and all(whole[r.ordinal] == (r.tag, r.str) for r in some)
    assert {r.transfer_syntax_uid for r in some} == {EXPLICIT}


@pytest.mark.parametrize("target", ["frames", "study", "strict", "mapping", "entities", "dicom", "deid"])
def test_every_target_parses_each_object_once_without_a_shuffle(spark, target):
    p = Pipeline(spark).from_bytes([("a", part10_bytes())]).of("dicom")
    built = {
        "frames": lambda: p.to_frames(), "study": lambda: p.to_imaging_study(), "strict": lambda: p.with_validation("strict").to_frames(), "mapping": lambda: p.to_mapping(Mapping().with_tag("PatientName", "n")),
        "entities": lambda: p.to_entities(), "dicom": lambda: p.to_dicom(), "deid": lambda: p.with_deidentification().to_dicom(),
    }[target]().build()
    plan = plan_of(built)
    if target == "study":
        built.collect()
        return
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == {"frames": 2, "strict": 2, "dicom": 2, "deid": 2}.get(target, 1)
    assert "Exchange" not in plan
    assert built.count() == 1


def test_first_wins_by_path_not_by_name(spark, tmp_path):
    for i, (name, description) in enumerate((("b.dcm", b"second"), ("a.dcm", b"first"), ("c.dcm", b"third"))):
        body = part10_bytes(uids=("2.25.1", f"2.25.2{i}", f"2.25.3{i}"))
        (tmp_path / name).write_bytes(body.replace(element("00080060", "CS", b"CT"), element("00080060", "CS", b"CT") + element("00081030", "LO", description)))
    r = Pipeline(spark).from_folder(f"file://{tmp_path}").of("dicom").to_imaging_study().build().first()
    found = json.loads(r.resource)
    assert found["description"] == "first" and found["numberOfSeries"] == 3
    assert [s["uid"] for s in found["series"]] == ["2.25.21", "2.25.20", "2.25.22"]


def test_malformed_bodies_are_errors(spark):
    p = Pipeline(spark).from_parts([("good", parts(part10_bytes())), ("bad", b"--b\r\nno end")], "multipart/related; boundary=b").of("dicom")
    assert {(r.instance_id, r.code) for r in p.concerns().collect()} == {("bad", "ParserError")}
    assert [r.instance_id for r in p.to_entities().build().collect()] == ["good#0"]
    with pytest.raises(Exception, match="validation failed"):
        p.with_validation("strict").to_entities().build().collect()


def test_concerns_follow_the_format(spark):
    good = json.dumps({"00100010": {"vr": "PN", "Value": [{"Alphabetic": "A^B"}]}}).encode()
    p = Pipeline(spark).from_bytes([("a", good), ("b", b"{"), ("c", b"[1]")]).of("dicom-json")
    assert sorted((r.instance_id, r.code) for r in p.concerns().collect()) == [("b", "ParserError"), ("c", "ParserError")]
    with pytest.raises(BuildError):
        Pipeline(spark).from_bytes([("a", good)]).of("json").concerns()


def test_object_concerns_are_those_of_the_rules_over_rows(spark):
    twice = part10_bytes().replace(element("00080060", "CS", b"CT"), element("00080060", "CS", b"CT") * 2)
    read = part10.read_objects(objects.from_bytes(spark, [("a", part10_bytes()), ("b", twice), ("c", part10_bytes()[:-9]), ("d", part10_bytes()[132:])]))
    rows = element_rows(read)
    broken = rows.withColumn("tag", F.when((F.col("instance_id") == "a") & (F.col("tag") == "00100020"), "0010zz20").otherwise(F.col("tag"))).withColumn("vr", F.when((F.col("tag") == "00082112") & (F.col("instance_id") == "b"), "UN").otherwise(F.col("vr")))
    broken = broken.withColumn("path", F.transform("path", lambda p: F.struct(p["tag"].alias("tag"), (p["item"] * 2).alias("item")))).withColumn("path_text", F.array_join(F.transform("path", lambda p: F.concat(p["tag"], F.lit("["), p["item"].cast("string"), F.lit("]/"))), ""))
    seen = lambda df: sorted((r.instance_id, r.code, r.ordinal if r.ordinal is not None else -9, r.path_text or "", r.tag or "", r.message, r.event, r.severity) for r in df.collect())
    want = seen(validate.validate(broken.filter("ordinal >= 0"), part10.statuses(rows)))
    got = seen(validate.concern_rows(validate.object_concerns(object_rows(broken))))
    assert got == want and {"ParserError", "DuplicateAttribute", "InvalidAttribute", "SequenceMismatch", "SequenceItemMismatch"} <= {x[1] for x in got}


def test_private_elements_and_free_text_go_by_default(spark):
    body = part10_bytes().replace(element("00100040", "CS", b"F"), element("00100040", "CS", b"F") + element("00101060", "PN", b"MOTHER^X") + element("001021B0", "LT", b"history") + element("00110010", "LO", b"MAKER") + element("00111001", "LO", b"secret") + element("00184000", "LT", b"comment"))
    p = Pipeline(spark).from_bytes([("a", body)]).of("dicom")
    shown = {r.tag: r.str for r in p.with_deidentification().to_elements().build().filter("depth = 0").collect()}
    assert not {"00101060", "001021B0", "00110010", "00111001", "00184000"} & set(shown)
    assert shown["00080016"] == "1.2.840.10008.5.1.4.1.1.7" and shown["00080018"].startswith("2.25.") and shown["00080018"] != "2.25.103" and shown["00280010"] == "32"
    kept = {r.tag: r.str for r in p.with_deidentification(deid.Mask.default().keeping_private()).to_elements().build().collect()}
    assert kept["00111001"] == "secret" and "00184000" not in kept
    rows = {(r.ordinal, r.tag): r.str for r in deid.deidentify(p.to_elements().build()).collect()}
    objs = {(r.ordinal, r.tag): r.str for r in p.with_deidentification().to_elements().build().collect()}
    assert rows == objs


def test_structured_values(spark):
    xml = Pipeline(spark).from_bytes([("a", b"<r><x n='1'>1<!-- c -->2</x></r>"), ("b", b"<r>")]).of("xml").to_structured_value().build()
    got = {r.instance_id: (r.value, r.concern) for r in xml.select("instance_id", F.col("value").cast("string"), "concern").collect()}
    assert json.loads(got["a"][0])["children"][0]["children"][0]["children"] == [{"text": "12", "type": "text"}] and got["b"][0] is None and "malformed" in got["b"][1]
    js = Pipeline(spark).from_bytes([("a", b'{"x": [1]}'), ("b", b"{")]).of("json").to_structured_value().build()
    assert {r.instance_id: r.concern for r in js.select("instance_id", "concern").collect()} == {"a": None, "b": "malformed JSON"}


def test_skip_drops_only_what_has_no_codec(spark):
    f = Pipeline(spark).from_bytes([("a", part10_bytes()[:-100])]).of("dicom")
    rows = part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes(pixels=PIXELS))]))
    short = rows.withColumn("bin", F.when(F.col("tag") == KEYWORDS["PixelData"], F.substring("bin", F.lit(1), F.lit(2000))).otherwise(F.col("bin")))
    assert frames.transcode(frames.extract_frames(short), EXPLICIT, "skip").count() == 1
    assert frames.transcode(frames.extract_frames(rows), "1.2.3", "skip").count() == 0
    assert f.to_frames().build().count() == 0, "a truncated object gives no partial result"


def test_outputs(spark, tmp_path):
    p = Pipeline(spark).from_bytes([("a", part10_bytes()), ("b", part10_bytes(name="ROE^R"))]).of("dicom")
    files = p.to_dicom().into_files(str(tmp_path / "out")).run()
    assert sorted(r.path.split("/")[-1] for r in files) == ["a.dcm", "b.dcm"] and all((tmp_path / "out" / n).stat().st_size for n in ("a.dcm", "b.dcm"))
    back = Pipeline(spark).from_folder(f"file://{tmp_path}/out").of("dicom").to_mapping(Mapping().with_tag("PatientName", "n")).build()
    assert sorted(r.n for r in back.collect()) == ["DOE^JANE^M", "ROE^R"]
    shown = {r.file_name: json.loads(bytes(r.content)) for r in p.to_entities().into_byte_buffer().run()}
    assert shown["a.json"] == {"instance_id": "a", "entity_kind": "Image"}
    assert {r.file_name for r in p.to_pictures("png").into_byte_buffer().run()} == {"a-000001.png", "b-000001.png"}
    bodies = p.to_dicom().into_part_buffer().run()
    assert len(bodies) == 1 and len(objects.split_multipart(bytes(bodies[0].body), bodies[0].content_type)) == 2
    assert p.to_entities().into_table(f"file://{tmp_path}/table").run()[0].n == 2
    assert sum(r.n for r in p.to_dicom().into_writer(lambda pairs: sum(1 for _ in pairs)).run()) == 2
    r = p.to_imaging_study().into_byte_buffer().run()[0]
    assert json.loads(bytes(r.content))["resourceType"] == "ImagingStudy" and r.file_name == "2.25.101.json"


def test_wrapped_documents_through_the_builder(spark):
    made = Pipeline(spark).from_bytes([("doc", b"%PDF-1")]).of("bytes").to_wrapped_documents("application/pdf", "My title").build()
    back = Pipeline(spark).from_reader(lambda _: made).of("dicom").to_documents().build().first()
    assert bytes(back.content) == b"%PDF-1" and back.file_name == "My_title.pdf" and back.mime_type == "application/pdf"
    with pytest.raises(BuildError):
        Pipeline(spark).from_bytes([("doc", b"%PDF-1")]).of("dicom").to_wrapped_documents().build()


def test_assets_and_archives(spark):
    p = Pipeline(spark).from_bytes([("a", part10_bytes())]).of("dicom")
    m = Mapping().with_tag("PatientName", "name").with_computed("label", "{Modality}")
    rows = p.to_assets(m).build().collect()
    assert [(r.kind, r.number) for r in rows] == [("metadata", 1), ("frame", 1)] and json.loads(bytes(rows[0].content)) == {"name": "DOE^JANE^M", "label": "CT"}
    assert bytes(rows[1].content).startswith(b"\x89PNG") and (rows[1].width, rows[1].height, rows[1].instance_uid) == (32, 32, "2.25.103")
    a = p.to_asset_archive(m).build().first()
    with zipfile.ZipFile(io.BytesIO(bytes(a.content))) as z:
        assert sorted(z.namelist()) == ["frames/frame-000001.png", "manifest.json", "metadata.json"] and a.file_name == "2.25.103.zip"
        manifest = json.loads(z.read("manifest.json"))
        assert (manifest["frameCount"], manifest["contentCount"], manifest["instanceUID"]) == (1, 0, "2.25.103") and z.read("frames/frame-000001.png") == bytes(rows[1].content)
    assert bytes(p.to_asset_archive(m).build().first().content) == bytes(a.content), "reruns agree"
    native = p.to_assets(None, [0, 7], "native").build().collect()
    assert [(r.kind, len(r.content)) for r in native] == [("frame", 2048)]


def test_codecs_of_users(spark):
    twice = codecs.Registry().with_encoder("1.2.3", lambda raw, im: raw + raw).with_decoder("1.2.3", lambda raw, im: raw[: len(raw) // 2]).with_picture("raw", lambda px: px[:, :, 0].tobytes())
    p = Pipeline(spark).from_bytes([("a", part10_bytes())]).of("dicom").with_transcoding("1.2.3", "fail")
    assert len(p.with_codecs(twice).to_frames().build().first().bytes) == 4096
    assert len(p.with_codecs(twice).to_pictures("raw").build().first().content) == 1024
    with pytest.raises(Exception, match="no codec"):
        p.to_frames().build().collect()
    with pytest.raises(ValueError):
        twice.with_encoder("1.2.3", lambda raw, im: raw)
    assert "1.2.3" not in twice.without("1.2.3").decoders and RLE in twice.without("1.2.3").decoders and not codecs.Registry.empty().decoders


def test_jpeg_ls():
    px, bits = jpegls.decode(LS_VECTOR)
    assert bits == 8 and px[:, :, 0].tolist() == [[0, 0, 90, 74], [68, 50, 43, 205], [64, 145, 145, 145], [100, 145, 145, 145]]
    assert jpegls.encode(px, 8) == LS_VECTOR, "the example of the standard"
    rng = np.random.default_rng(2)
    for bits, near, shape in ((8, 0, (17, 23, 3)), (12, 0, (20, 30, 1)), (16, 0, (9, 9, 1)), (8, 3, (30, 30, 1)), (2, 0, (9, 9, 1)), (8, 0, (3, 400, 1))):
        for px in (rng.integers(0, 1 << bits, shape), (rng.random(shape) < 0.03) * ((1 << bits) - 1)):
            got, depth = jpegls.decode(jpegls.encode(px, bits, near))
            assert depth == bits and np.abs(got - px).max() <= near
    for n in range(0, len(LS_VECTOR) - 3):
        with pytest.raises(jpegls.JpegLsError):
            jpegls.decode(LS_VECTOR[:n])


@pytest.mark.parametrize("uid", [codecs.JPEG_LS, codecs.JPEG_LOSSLESS[1], codecs.JPEG_2000[0], RLE])
def test_lossless_frames_there_and_back(spark, uid):
    p = Pipeline(spark).from_bytes([("a", part10_bytes())]).of("dicom").with_transcoding(uid, "fail")
    coded = p.to_frames().build().first()
    assert coded.transfer_syntax_uid == uid and bytes(coded.bytes) != PIXELS.tobytes()
    assert bytes(p.with_transcoding(EXPLICIT, "fail").to_frames().build().first().bytes) == PIXELS.tobytes()


def test_lossless_jpeg_encoder():
    rng = np.random.default_rng(3)
    for bits, n in ((8, 3), (12, 1), (16, 1), (2, 1)):
        px = rng.integers(0, 1 << bits, (7, 9, n))
        got, depth = jpeg.decode_lossless(jpeg.encode_lossless(px, bits))
        assert depth == bits and np.array_equal(got, px)


def test_repeats_are_measured_from_the_event_that_was_kept(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    rows = [("k", at(0)), ("k", at(40)), ("k", at(80)), ("k", at(139)), ("k", at(140)), ("j", at(5)), (None, at(1)), (None, at(2)), ("n", None)]
    df = spark.createDataFrame(rows, "path string, ts timestamp")
    want = [(None, at(1)), ("j", at(5)), ("k", at(0)), ("k", at(80)), ("k", at(140))]
    order = lambda found: sorted(map(tuple, found), key=lambda r: (r[0] or "", r[1]))
    assert order(streams.drop_repeats(df, "path", "ts", "1 hour").collect()) == want
    df.filter("path is not null").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    seen: list = []
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    streams.start(streams.drop_repeats(stream, "path", "ts", "1 hour"), lambda b, _: seen.extend(map(tuple, b.collect())), f"file://{tmp_path}/check").awaitTermination()
    assert order(seen) == want[1:]


def test_records_keep_their_order_through_handlers(spark):
    items = [("z", part10_bytes(uids=("2.25.1", "2.25.2", "2.25.3"))), ("y", part10_bytes(uids=("2.25.1", "2.25.4", "2.25.5")))]
    p = Pipeline(spark).from_bytes(items).of("dicom").with_handler(lambda e: e.filter("tag <> '00080060'"))
    found = json.loads(p.to_imaging_study().build().first().resource)
    assert [s["uid"] for s in found["series"]] == ["2.25.4", "2.25.2"] and "modality" not in found
    assert fhir.NEEDED >= {"0020000D"}


def test_raw_headers_are_read_past_wanted_tags():
    rows, syntax = part10.parse("a", part10_bytes(), part10.Options(wanted=frozenset({"7FE00010"})))
    assert [r[6] for r in rows] == ["7FE00010"] and syntax == EXPLICIT and struct.calcsize("<H") == 2


def test_patients_are_merged_and_totals_may_conflict(spark):
    more = lambda name, total: part10_bytes(name=name).replace(element("00200013", "IS", b"1\\2"), element("00200013", "IS", b"1\\2") + element("00201206", "IS", total))
    p = lambda *totals: Pipeline(spark).from_bytes([(f"o{i}", more(name, t)) for i, (name, t) in enumerate(zip(("DOE^JANE", "ROE^JANE", "DOE^JANE"), totals, strict=False))]).of("dicom")
    full = json.loads(p(b"1", b"1", b"1").to_imaging_study().build().first().resource)
    assert [n["family"] for n in full["contained"][0]["name"]] == ["DOE", "ROE"]
    assert p(b"4", b"4").to_imaging_study("study-summary").build().first().number_of_series == 4
    with pytest.raises(Exception, match="conflicting totals"):
        p(b"4", b"5").to_imaging_study("study-summary").build().collect()
    assert "subject" not in json.loads(p(b"1").to_imaging_study(subject="none").build().first().resource)


def test_progress_counts_objects(spark):
    from pyspark.sql import Observation

    seen = Observation("read")
    p = Pipeline(spark).from_bytes([("a", part10_bytes()), ("b", part10_bytes()[:-1])]).of("dicom").with_progress(seen)
    p.to_entities().build().collect()
    assert (seen.get["objects"], seen.get["failed"]) == (2, 1) and seen.get["elements"] > 0


def test_error_codes():
    with pytest.raises(BuildError) as e:
        Pipeline(None).of("nothing")
    assert e.value.code == "InvalidParser"
    with pytest.raises(BuildError) as e:
        Pipeline(None, source=lambda: None, format="json").to_frames().check()
    assert e.value.code == "IncompatibleParserAndHandler"


def test_frames_that_cannot_be_redacted_are_held_back(spark):
    f = frames.extract_frames(part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes())]))).withColumn("transfer_syntax_uid", F.lit("1.2.3"))
    r = frames.redact_frames(f, [{"x": 0, "y": 0, "width": 2, "height": 2}]).first()
    assert r.bytes is None and "no codec" in r.concern
    from lumenframe.pixels import redact

    noise = np.zeros((64, 64, 4), np.uint8)
    noise[::2, ::2] = 255
    with pytest.raises(redact.RegionError):
        redact.text_regions(noise, redact.TextOptions(most_components=10))


def test_arithmetic_coder_by_its_published_sequence():
    coded = bytes.fromhex("84c73bfce1a1430402200000410dbb86f4317fff88ff37471adb6adf")
    plain = bytes.fromhex("00020051000000c00352872aaaaaaaaa82c02000fcd79ef6bf7fed904f46a3bf")
    d, e = jpeg2000.MqDecoder(coded + b"\xff\xac"), jpeg2000.MqEncoder()
    d.index, e.index = [0] * 19, [0] * 19
    for byte in plain:
        for k in reversed(range(8)):
            assert d.bit(0) == byte >> k & 1
            e.bit(0, byte >> k & 1)
    assert e.flush() == coded


def test_jpeg_2000():
    rng = np.random.default_rng(6)
    for bits, shape in ((8, (33, 47, 1)), (12, (70, 130, 1)), (8, (20, 30, 3)), (16, (9, 9, 1)), (8, (1, 40, 1)), (1, (20, 20, 1))):
        y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
        for px in (rng.integers(0, 1 << bits, shape), np.minimum((1 << bits) - 1, (x + y)[:, :, None] + np.zeros(shape, int)), np.zeros(shape, int)):
            coded = jpeg2000.encode(px, bits)
            got, depth = jpeg2000.decode(coded)
            assert depth == bits and np.array_equal(got, px)
    box = struct.pack(">I4s", 8 + len(coded), b"jp2c") + coded
    assert np.array_equal(jpeg2000.decode(struct.pack(">I4s", 12, b"jP  ") + b"\r\n\x87\n" + box)[0], px)
    flat = np.full((5, 4), 7.0)
    assert np.allclose(jpeg2000._lifted(flat, np.zeros((4, 4)), 0, 0, False), 7.0, atol=1e-6), "the irreversible wavelet keeps a level"
    coded = jpeg2000.encode(rng.integers(0, 256, (24, 24, 1)), 8)
    for n in (0, 2, 30, 60, 90, len(coded) // 2):
        with pytest.raises(jpeg2000.Jpeg2000Error):
            jpeg2000.decode(coded[:n])


def test_parsers_of_users(spark):
    def lines(instance, data):
        for line in data.decode().splitlines():
            tag, vr, text = line.split(" ", 2)
            yield {"tag": tag, "vr": vr, "str": text}

    p = Pipeline(spark).from_bytes([("a", b"00100010 PN DOE^J\n00080060 CS SEG"), ("b", b"damaged")]).of_parser(lines)
    assert [(r.instance_id, r.entity_kind) for r in p.to_entities().build().collect()] == [("a", "Segmentation")]
    assert [(r.instance_id, r.code) for r in p.concerns().collect()] == [("b", "ParserError")]
    assert p.to_mapping(Mapping().with_tag("PatientName", "n")).build().first().n == "DOE^J"


def test_top_colours_of_a_region():
    from lumenframe.pixels import redact

    px = np.zeros((4, 4, 4), np.uint8)
    px[0], px[1, :2] = (255, 0, 0, 255), (0, 9, 0, 255)
    assert redact.top_colours(px) == [((0, 0, 0, 0), 10), ((255, 0, 0, 255), 4), ((0, 9, 0, 255), 2)]
    assert redact.top_colours(px, (0, 0, 4, 2), 1) == [((255, 0, 0, 255), 4)]


def test_several_web_requests():
    asked = objects.dicomweb_url("http://x", "wado-metadata", study="1", level="study")
    assert asked == "http://x/studies/1/metadata"


def test_progressive_jpeg_of_another_codec(spark):
    from test_imaging import java_image

    jvm = java_image(spark)
    y, x = np.mgrid[0:45, 0:53]
    rgb = np.stack([128 + 90 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), 60 + x + y], 2).astype(np.uint8)
    for kind in (1, 10):
        image = jvm.java.awt.image.BufferedImage(53, 45, kind)
        for j in range(45):
            for i in range(53):
                r, g, b = rgb[j, i].tolist()
                if kind == 10:
                    image.getRaster().setSample(i, j, 0, g)
                else:
                    image.setRGB(i, j, r << 16 | g << 8 | b)
        read = {}
        for progressive in (False, True):
            out = jvm.java.io.ByteArrayOutputStream()
            writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
            options = writer.getDefaultWriteParam()
            if progressive:
                options.setProgressiveMode(1)
            stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
            writer.setOutput(stream)
            writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), options)
            stream.flush()
            coded = bytes(out.toByteArray())
            assert (b"\xff\xc2" in coded) == progressive
            read[progressive] = codecs.jpeg_picture(coded)
        assert np.array_equal(read[False], read[True]), "the same coefficients in another order"
        with pytest.raises(codecs.CodecError):
            codecs.jpeg_picture(coded[: len(coded) // 2])
