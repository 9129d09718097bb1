"""Binary and metadata formats, filters, frames and the builder, on generated objects with independent expectations."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.dictionary import BIG, EXPLICIT, IMPLICIT, KEYWORDS, RLE, TAGS, TRANSFER_SYNTAXES, tag_of
from lumenframe.functions import dicom
from lumenframe.operators import deid, entities, fhir, frames, validate
from lumenframe.operators.mapping import Mapping
from lumenframe.operators.select import Selection, pivot_first, query, references, skip_below
from lumenframe.pixels import codecs, jpeg, redact
from lumenframe.plans.pipeline import BuildError, Pipeline
from lumenframe.sinks import packages
from lumenframe.sinks import part10 as writer
from lumenframe.sources import kinds, metadata, objects, part10
from lumenframe.streaming import streams

PIXELS = np.arange(32 * 32, dtype=np.uint16).reshape(32, 32)


def element(tag, vr, value, order="<", explicit=True, undefined=False):
    value += (b"\x00" if vr in ("UI", "OB", "OW", "UN") else b" ") * (len(value) % 2)
    n = 0xFFFFFFFF if undefined else len(value)
    head = struct.pack(order + "HH", int(tag[:4], 16), int(tag[4:], 16))
    if not explicit:
        return head + struct.pack(order + "I", n) + value
    if vr in ("OB", "OW", "SQ", "UN", "UT"):
        return head + vr.encode() + b"\0\0" + struct.pack(order + "I", n) + value
    return head + vr.encode() + struct.pack(order + "H", n) + value


def item(body, order="<", undefined=True):
    if undefined:
        return struct.pack(order + "HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + body + struct.pack(order + "HHI", 0xFFFE, 0xE00D, 0)
    return struct.pack(order + "HHI", 0xFFFE, 0xE000, len(body)) + body


def data_set(order="<", explicit=True, pixels=PIXELS, undefined=True, uids=("2.25.101", "2.25.102", "2.25.103"), encapsulated=None, name="DOE^JANE^M"):
    e = lambda tag, vr, v: element(tag, vr, v, order, explicit)
    us = lambda v: struct.pack(order + "H", v)
    inner = e("00080050", "SH", b"INNER") + e("00100010", "PN", b"INNER^NAME")
    nested = element("00400275", "SQ", item(inner, order, undefined) + (struct.pack(order + "HHI", 0xFFFE, 0xE0DD, 0) if undefined else b""), order, explicit, undefined)
    both = item(e("00081150", "UI", b"1.2.3") + e("00081155", "UI", b"1.2.4") + nested, order, undefined) + item(e("00081155", "UI", b"1.2.5"), order, undefined)
    sequence = element("00082112", "SQ", both + (struct.pack(order + "HHI", 0xFFFE, 0xE0DD, 0) if undefined else b""), order, explicit, undefined)
    study, series, sop = (u.encode() for u in uids)
    body = (
        e("00080005", "CS", b"ISO_IR 192") + e("00080008", "CS", b"DERIVED\\SECONDARY") + e("00080016", "UI", b"1.2.840.10008.5.1.4.1.1.7") + e("00080018", "UI", sop) + e("00080020", "DA", b"20260102") + e("00080030", "TM", b"123456")
        + e("00080060", "CS", b"CT") + sequence + e("00100010", "PN", name.encode()) + e("00100020", "LO", b"ID 1") + e("00100040", "CS", b"F") + e("0020000D", "UI", study) + e("0020000E", "UI", series) + e("00200011", "IS", b"7") + e("00200013", "IS", b"1\\2")
        + e("00280002", "US", us(1)) + e("00280004", "CS", b"MONOCHROME2") + e("00280010", "US", us(32)) + e("00280011", "US", us(32)) + e("00280100", "US", us(16)) + e("00280101", "US", us(16)) + e("00280102", "US", us(15)) + e("00280103", "US", us(0)) + e("00281050", "DS", b"512") + e("00281051", "DS", b"1024")
    )
    if encapsulated is not None:
        return body + element("7FE00010", "OB", encapsulated, order, explicit, True)
    return body + element("7FE00010", "OW", pixels.astype(order + "u2").tobytes(), order, explicit)


def part10_bytes(syntax=EXPLICIT, **options):
    known = TRANSFER_SYNTAXES[syntax]
    meta = element("00020001", "OB", b"\0\1") + element("00020002", "UI", b"1.2.840.10008.5.1.4.1.1.7") + element("00020003", "UI", b"2.25.103") + element("00020010", "UI", syntax.encode())
    return b"\0" * 128 + b"DICM" + element("00020000", "UL", struct.pack("<I", len(meta))) + meta + data_set(">" if not known.little else "<", known.explicit, **options)


def facts(rows):
    return [(r[3], r[6], r[7], r[10]) for r in rows if r[6] != "7FE00010"]


def test_all_syntaxes_and_sequence_forms_read_alike():
    want = facts(part10.parse("a", part10_bytes())[0])[5:]
    assert ("00082112[0]/00400275[0]/", "00100010", "PN", "INNER^NAME") in want and ("00082112[1]/", "00081155", "UI", "1.2.5") in want
    for data, syntax in ((part10_bytes(IMPLICIT), IMPLICIT), (part10_bytes(BIG), BIG), (part10_bytes(undefined=False), EXPLICIT)):
        rows, got = part10.parse("a", data)
        assert got == syntax and facts(rows)[5:] == want
    for data, syntax in ((data_set(), EXPLICIT), (data_set(explicit=False), IMPLICIT), (data_set(">"), BIG)):
        rows, got = part10.parse("a", data)
        assert got == syntax and facts(rows) == want


def test_damaged_objects_fail_and_give_no_partial_result(spark):
    good = part10_bytes()
    syntax = element("00020010", "UI", b"1.2.840.10008.1.2.1.99")
    deflated = good[:132] + syntax + zlib.compress(data_set(), 9)[2:-4]
    items = [("good", good), ("cut", good[:-10]), ("header", good[: -len(PIXELS.tobytes()) - 6]), ("empty", b""), ("deflated", deflated)]
    read = part10.read_elements(objects.from_bytes(spark, items))
    status = {r.instance_id: r.status for r in part10.statuses(read).collect()}
    assert status == {"good": "ok", "cut": "error", "header": "error", "deflated": "error"}
    assert read.filter("instance_id = 'cut'").count() == 1
    assert facts(part10.parse("a", deflated, part10.Options(inflate=True))[0])[1:] == facts(part10.parse("a", good)[0])[5:]
    for bad in (b"\xfe\xff\x00\xe0\xff\xff\xff\xff", struct.pack("<HHI", 0xFFFE, 0xE000, 3) + b"abc"):
        with pytest.raises(part10.ParseError):
            part10.parse("a", part10_bytes(encapsulated=bad))


def test_bulk_policies():
    big = np.zeros((1024, 1024), np.uint16)
    for policy, bulk in (("auto", True), ("stream", True), ("materialize", False)):
        row = part10.parse("a", part10_bytes(pixels=big), part10.Options(bulk=policy))[0][-1]
        assert row[16] is bulk and (row[14] is None) is bulk and (row[17] is not None) is bulk
    assert part10.parse("a", part10_bytes(), part10.Options(stop_after="00100010"))[0][-1][6] == "00100010"


@pytest.mark.parametrize("target", [EXPLICIT, IMPLICIT, BIG])
def test_round_trip_through_the_writer(spark, target):
    read = part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes())]))
    out = bytes(writer.write_bytes(read, target).first().content)
    rows, syntax = part10.parse("a", out)
    before = part10.parse("a", part10_bytes())[0]
    assert syntax == target and facts(rows)[5:] == facts(before)[5:]
    order = ">" if target == BIG else "<"
    assert np.array_equal(np.frombuffer(rows[-1][14], order + "u2").reshape(32, 32), PIXELS)


def dicom_json():
    v = lambda vr, *x: {"vr": vr, "Value": list(x)}
    return [{
        "00080005": v("CS", "ISO_IR 192"), "00080008": v("CS", "DERIVED", "SECONDARY"), "00080016": v("UI", "1.2.840.10008.5.1.4.1.1.7"), "00080018": v("UI", "2.25.103"), "00080020": v("DA", "20260102"), "00080030": v("TM", "123456"), "00080060": v("CS", "CT"),
        "00082112": v("SQ", {"00081150": v("UI", "1.2.3"), "00081155": v("UI", "1.2.4"), "00400275": v("SQ", {"00080050": v("SH", "INNER"), "00100010": v("PN", {"Alphabetic": "INNER^NAME"})})}, {"00081155": v("UI", "1.2.5")}),
        "00100010": v("PN", {"Alphabetic": "DOE^JANE^M"}), "00100020": v("LO", "ID 1"), "00100040": v("CS", "F"), "0020000D": v("UI", "2.25.101"), "0020000E": v("UI", "2.25.102"), "00200011": v("IS", 7), "00200013": v("IS", 1, 2),
        "00420011": {"vr": "OB", "InlineBinary": base64.b64encode(b"abc").decode()}, "7FE00010": {"vr": "OW", "BulkDataURI": "http://x/bulk"},
    }]


def dicom_xml():
    def of(obj):
        out = ""
        for tag, e in obj.items():
            inner = ""
            for i, v in enumerate(e.get("Value", []), 1):
                if e["vr"] == "SQ":
                    inner += f'<Item number="{i}">{of(v)}</Item>'
                elif e["vr"] == "PN":
                    family, given, *rest = v["Alphabetic"].split("^")
                    inner += f'<PersonName number="{i}"><Alphabetic><FamilyName>{family}</FamilyName><GivenName>{given}</GivenName>{"".join(f"<MiddleName>{m}</MiddleName>" for m in rest)}</Alphabetic></PersonName>'
                else:
                    inner = f'<Value number="{i}">{v}</Value>' + inner  # order comes from the number
            inner += f"<InlineBinary>{e['InlineBinary']}</InlineBinary>" if "InlineBinary" in e else ""
            inner += f'<BulkData uri="{e["BulkDataURI"]}"/>' if "BulkDataURI" in e else ""
            out += f'<DicomAttribute tag="{tag}" vr="{e["vr"]}">{inner}</DicomAttribute>'
        return out

    return f"<NativeDicomModel>{of(dicom_json()[0])}</NativeDicomModel>"


def test_binary_json_and_xml_agree(spark):
    native = part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes())]))
    by_json = metadata.read_json(spark.createDataFrame([("a", json.dumps(dicom_json())), ("b", "{nope")], "instance_id string, json string"))
    by_xml = metadata.read_xml(spark.createDataFrame([("a", dicom_xml()), ("b", "<x>")], "instance_id string, xml string"))
    assert by_json.filter("instance_id = 'b'").first().ordinal == by_xml.filter("instance_id = 'b'").first().ordinal == -1
    want = None
    for df in (native, by_json, by_xml):
        df = df.filter("instance_id = 'a'")
        shared = df.filter("not is_meta and tag < '00280000'").orderBy("ordinal").select("path_text", "tag", "vr", "str").collect()
        study = fhir.imaging_study(fhir.records(df)).first()
        assert want in (None, (shared, study))
        want = (shared, study)
    assert by_json.filter("tag = '00420011'").first().bin == b"abc" == by_xml.filter("tag = '00420011'").first().bin
    assert by_xml.filter("tag = '7FE00010'").first().bulk_uri == "http://x/bulk"
    resource = json.loads(want[1].resource)
    assert resource["numberOfInstances"] == 1 and resource["series"][0]["instance"][0]["uid"] == "2.25.103" and resource["contained"][0]["name"][0]["text"] == "JANE M DOE" and resource["identifier"][0]["value"] == "urn:oid:2.25.101"
    flat = metadata.studies_of_json(spark.createDataFrame([("a", json.dumps(dicom_json()))], "instance_id string, json string")).first()
    assert (flat.study_uid, flat.n_series, flat.n_instances, flat.modalities) == ("2.25.101", 1, 1, "CT")


def test_selection_query_and_references(spark):
    e = part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes()), ("b", part10_bytes(name="ROE^R"))]))
    wide = {r.instance_id: r for r in pivot_first(e.filter("depth = 0"), Selection("PatientName", "(0008,0060)").include("0020000D", "StudyID")).collect()}
    assert wide["a"].PatientName == "DOE^JANE^M" and wide["b"].Modality == "CT" and wide["a"].StudyID is None
    assert skip_below(e, "00082112[0]/00400275").filter("depth = 2").count() == 0
    instances = spark.createDataFrame([("1.2.4", "DOE^JANE", "20260102"), ("9", "ROE", "20270101")], "sop_instance_uid string, name string, date string")
    assert {(r.referenced_uid, r.resolved) for r in references(e, instances).collect()} == {("1.2.4", True), ("1.2.5", False)}
    ask = lambda k: query(instances, k, {"date": "DA", "sop_instance_uid": "UI"}).count()
    assert [ask({"name": "DOE*"}), ask({"name": "?OE"}), ask({"name": ""}), ask({"date": "20260101-20261231"}), ask({"date": "-20270101"}), ask({"sop_instance_uid": "9\\8"}), ask({"name": "D.E^JANE"})] == [1, 1, 2, 1, 2, 1, 0]
    with pytest.raises(ValueError):
        Selection("NoSuchKeyword")


def test_mapping_templates_and_policies(spark):
    e = part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes())])).filter("depth = 0")
    m = Mapping().with_tag("PatientName", "patient.name").with_tag("Modality", "kind", "<{value}|{key}>").with_computed("label", "{dicom.patientid} {prop.site} {Modality}").with_property("site", "S").with_computed("up", resolve=lambda c: F.upper(c["label"]))
    row = m.apply(e).first()
    assert row["patient.name"] == "DOE^JANE^M" and row.kind == "<CT|00080060>" and row.label == "ID 1 S CT" and row.up == "ID 1 S CT"
    assert set(m.needed_tags()) == {tag_of(x) for x in ("PatientName", "Modality", "PatientID")}
    assert m.nested(m.apply(e)).first().patient.name == "DOE^JANE^M"
    lost = Mapping().with_computed("x", "a{StudyID}b")
    assert lost.with_missing("blank").apply(e).first().x == "ab" and lost.with_missing("omit").apply(e).first().x is None
    with pytest.raises(Exception, match="StudyID"):
        lost.apply(e).collect()


def test_validation_rules(spark):
    good = part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes())])).drop("transfer_syntax_uid")
    assert validate.validate(good).count() == 0
    base = good.filter("tag in ('00020010', '00080060')")
    broken = base.unionByName(good.filter("tag = '00080060'").withColumn("ordinal", F.lit(99).cast("long"))).unionByName(good.filter("tag = '00100010' and depth = 0").withColumn("is_meta", F.lit(True)).withColumn("is_complete", F.lit(False)))
    broken = broken.unionByName(good.filter("tag = '00081155' and path_text = '00082112[1]/'")).unionByName(good.filter("tag = '00100020'").withColumn("vr", F.lit("ZZ")))
    codes = {r.code: r["count"] for r in validate.validate(broken, spark.createDataFrame([("z", "error", "cut off")], "instance_id string, status string, error_message string")).groupBy("code").count().collect()}
    assert codes == {"DuplicateAttribute": 1, "InvalidMetaTagPlacement": 1, "MissingRequiredMetaAttribute": 3, "IncompleteAttribute": 1, "SequenceMismatch": 1, "SequenceItemMismatch": 1, "InvalidAttribute": 1, "ParserError": 1}
    gaps = good.filter("path_text <> '00082112[0]/' and not startswith(path_text, '00082112[0]/')")
    assert [r.code for r in validate.item_gaps(gaps).collect()] == ["SequenceItemMismatch"]
    assert validate.strict(good, validate.validate(good)).count() == good.count()
    with pytest.raises(Exception, match="validation failed"):
        validate.strict(broken, validate.validate(broken)).collect()


def fold_uid(text):
    a = b = 2166136261
    units = struct.unpack(f">{len(text.encode('utf-16-be')) // 2}H", text.encode("utf-16-be"))
    for u in units:
        a = ((a ^ u) * 16777619) % 2**32
        b = ((b ^ (u * 31)) * 2246822519) % 2**32
    return f"2.25.{a}{b}"


def test_deidentification(spark):
    e = part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes())]), part10.Options(bulk="stream"))
    out = deid.deidentify(e, deid.Mask.default().merge({"PatientID": "literal", "7FEXXXXX": "Z", "Modality": "K"}))
    rows = {(r.path_text, r.tag): r for r in out.collect()}
    assert rows["", "00100010"].str == "" and rows["", "00100020"].str == "literal" and rows["", "00080060"].str == "CT"
    assert rows["", "0020000D"].str == fold_uid("0020000D|2.25.101") and rows["", "00020003"].str == "2.25.103"
    assert not any(p for p, _ in rows), "what stands in a replaced sequence goes with it"
    pixel = rows["", "7FE00010"]
    assert not pixel.is_bulk and pixel.bulk_offset is None and pixel.bin == b"", "bulk values are masked too"
    seeds = ["", "a", "0020000D|1.2.3", "é𝔘 x", "z" * 200]
    got = spark.createDataFrame([(s,) for s in seeds], "s string").select(dicom.deterministic_uid(F.col("s")).alias("u")).collect()
    assert [r.u for r in got] == [fold_uid(s) for s in seeds]
    same = deid.deidentify(e, deid.Mask({"StudyInstanceUID": "U", "SeriesInstanceUID": "U"}), consistent_uids=True).filter("tag = '0020000D'").first().str
    assert same == fold_uid("2.25.101")
    new = spark.range(20).select(dicom.new_uid().alias("u")).collect()
    assert len({r.u for r in new}) == 20 and all(r.u.startswith("2.25.") and r.u[5:].isdigit() and len(r.u) <= 64 for r in new)


def test_entities_and_modules(spark):
    e = part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes())]))
    assert entities.classify(e).first().entity_kind == "Image"
    m = entities.modules(e).first()
    assert m.image_pixel.ImageBytes == 2048 and m.voi.WindowWidth == 1024.0 and m.general_series.SeriesNumber == 7 and m.patient.PatientName == "DOE^JANE^M"
    ko = [{"0040A375": {"vr": "SQ", "Value": [{"0020000D": {"vr": "UI", "Value": ["1.1"]}, "00081115": {"vr": "SQ", "Value": [{"0020000E": {"vr": "UI", "Value": ["1.2"]}, "00081199": {"vr": "SQ", "Value": [{"00081150": {"vr": "UI", "Value": ["c"]}, "00081155": {"vr": "UI", "Value": ["i"]}}]}}]}}]}, "00620002": {"vr": "SQ", "Value": [{"00620004": {"vr": "US", "Value": [1]}, "00620005": {"vr": "LO", "Value": ["liver"]}}]}, "54000100": {"vr": "SQ", "Value": [{"003A0005": {"vr": "US", "Value": [12]}}]}}]
    k = metadata.read_json(spark.createDataFrame([("k", json.dumps(ko))], "instance_id string, json string"))
    assert tuple(entities.evidence(k).first()) == ("k", "1.1", "1.2", "c", "i")
    assert entities.segments(k).first().label == "liver" and entities.waveform_groups(k).first().channels == "12"


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert str(one(dicom.parse_da(lit("20240229")))) == "2024-02-29" and one(dicom.parse_da(lit("20230229"))) is None
    assert one(dicom.parse_tm(lit("123456.5"))) == 45296500000 and one(dicom.parse_tm(lit("12"))) == 43200000000 and one(dicom.parse_tm(lit("2500"))) is None
    assert one(dicom.parse_dt(lit("20240102030405.5+0200")).cast("string")) == "2024-01-02 01:04:05.5" and one(dicom.parse_dt(lit("2024")).cast("string")) == "2024-01-01 00:00:00"
    assert one(dicom.human_name(lit("=山田^太郎="))).text == "太郎 山田" and one(dicom.human_name(lit(" "))) is None
    assert one(dicom.valid_uid(lit("1.2.03"))) is False and one(dicom.valid_uid(lit("1.2.0.3\x00"))) is True
    assert one(dicom.decode_text(lit(b"\xe9"), lit("ISO_IR 100"))) == "é" and one(dicom.decode_text(lit(b"\xe9"), lit("ISO_IR 192"))) is None and one(dicom.decode_text(lit(b"\x1b$B"), lit("ISO_IR 6"))) is None
    assert one(dicom.inline_binary(lit("data:x;base64,YWJj"))) == b"abc" and one(dicom.fhir_unsigned(lit("2147483648"))) is None
    assert one(dicom.safe_name(lit("../a b?.pdf"))) == "a_b_.pdf" and one(dicom.mime_extension(lit("Application/PDF; x=1"))) == "pdf" and one(dicom.photometric(lit(None).cast("string"))) == "MONOCHROME1"
    assert one(dicom.document_bytes(lit(b"abcd"), lit(3))) == b"abc" and one(dicom.is_private(lit("00091001"))) and one(dicom.tag_id(lit(8), lit(0x60))) == "00080060"


def test_multipart_bodies(spark):
    body = b"--b\r\nContent-Type: application/dicom\r\n\r\nAAA\r\n--b\r\n\r\nB\r\nB\r\n--b--\r\n"
    got = objects.split_multipart(body, 'multipart/related; boundary="b"')
    assert got == [({"content-type": "application/dicom"}, b"AAA"), ({}, b"B\r\nB")]
    for bad, kind in ((body, "multipart/related"), (body[:-6], "multipart/related; boundary=b"), (b"--b\r\nContent-Type: x", "multipart/related; boundary=b"), (b"--bx", "multipart/related; boundary=b")):
        with pytest.raises(ValueError):
            objects.split_multipart(bad, kind)
    made = packages.multipart_body(spark.createDataFrame([("k", "1", bytearray(b"x")), ("k", "2", bytearray(b"y"))], "batch_id string, instance_id string, content binary")).first()
    assert [b for _, b in objects.split_multipart(bytes(made.body), made.content_type)] == [b"x", b"y"]
    assert objects.dicomweb_url("http://h/d/", study=None, query={"a": ["1", "2"]}) == "http://h/d/studies?a=1&a=2"
    assert objects.dicomweb_url("http://h", "wado-metadata", "series", "1", "2") == "http://h/studies/1/series/2/metadata"


def test_http_source_reads_one_partition_per_url(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = objects.read_http(spark, [f"{base}/a", f"{base}/b"])
    assert {bytes(r.content) for r in got.collect()} == {b"/a", b"/b"} and got.rdd.getNumPartitions() == 2
    server.shutdown()


def test_codecs_round_trip():
    rng = np.random.default_rng(1)
    for samples, bits, planar in ((1, 8, 0), (1, 16, 0), (3, 8, 0), (3, 8, 1)):
        im = codecs.Image(7, 9, samples, bits, bits, planar=planar)
        raw = (rng.integers(0, 4, 7 * 9 * samples * bits // 8).astype(np.uint8) * 60).tobytes()
        assert codecs.rle_decode(codecs.rle_encode(raw, im), im) == raw
    for shape, kind in (((5, 6, 4), np.uint8), ((5, 6, 3), np.uint8), ((5, 6, 1), np.uint16), ((5, 6, 1), np.uint8)):
        a = rng.integers(0, np.iinfo(kind).max, shape).astype(kind)
        assert np.array_equal(codecs.png_decode(codecs.png_encode(a)), a) and np.array_equal(codecs.tiff_decode(codecs.tiff_encode(a)), a)
    a = rng.integers(0, 255, (6, 5, 3)).astype(np.uint8)
    lines, flat = b"", a.reshape(6, 15).astype(int)
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):  # all PNG filters, computed here
        out = []
        for i in range(15):
            left, up, corner = (flat[y, i - 3] if i > 2 else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - 3] if y and i > 2 else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            out.append((flat[y, i] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        lines += bytes([kind, *out])
    made = codecs.png_encode(a)
    body = zlib.compress(lines)
    idat = struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body))
    at = made.index(b"IDAT") - 4
    n = struct.unpack(">I", made[at : at + 4])[0]
    assert np.array_equal(codecs.png_decode(made[:at] + idat + made[at + 12 + n :]), a)


def test_native_pixels_to_grey():
    im = codecs.Image(1, 4, allocated=16, stored=16, signed=True, center=0, width=4096)
    grey = codecs.rgba(np.array([-2048, -1, 0, 2047], "<i2").tobytes(), im)[0, :, 0]
    assert grey.tolist() == [0, 127, 127, 254]
    im = codecs.Image(1, 4, allocated=16, stored=16, center=2048, width=4096)
    assert codecs.rgba(np.array([0, 1024, 2048, 4095], "<u2").tobytes(), im)[0, :, 0].tolist() == [0, 63, 127, 254]
    assert codecs.rgba(np.array([0, 1024, 2048, 4095], ">u2").tobytes(), im, big=True)[0, :, 0].tolist() == [0, 63, 127, 254]
    assert codecs.rgba(bytes([0, 10, 255]), codecs.Image(1, 3, photometric="MONOCHROME1"))[0, :, 0].tolist() == [255, 245, 0]
    assert codecs.rgba(bytes([1, 2, 3, 4, 5, 6]), codecs.Image(1, 2, 3, planar=1, photometric="RGB"))[0, :, :3].tolist() == [[1, 3, 5], [2, 4, 6]]
    lut = tuple(np.array([0, 0x1000, 0xFF00, 0x8000]) + c for c in range(3))
    assert codecs.rgba(bytes([2, 3]), codecs.Image(1, 2, photometric="PALETTE COLOR", palette=lut))[0, :, 0].tolist() == [255, 128]
    assert codecs.samples_of(bytes([0x34, 0x12, 0xAB]), codecs.Image(1, 2, allocated=12, stored=12)).ravel().tolist() == [0x234, 0xAB1]
    assert codecs.expand_palette(struct.pack("<8H", 0, 2, 5, 7, 1, 3, 13, 0), 0, 16, True)[:5].tolist() == [5, 7, 9, 11, 13]
    with pytest.raises(codecs.CodecError):
        codecs.rgba(b"\0", im)


def test_frames_and_fragments():
    three = [b"aa", b"bbbb", b"cc"]
    assert codecs.frames_of(codecs.encapsulate(three), 3) == three
    bare = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x for x in (b"", *three, b"dd"))
    assert codecs.frames_of(bare, 2) == [b"aabbbb", b"ccdd"] and codecs.frames_of(bare, 1) == [b"aabbbbccdd"]


def test_redaction_and_text_regions():
    assert redact.boxes([{"x": -1.5, "y": 2.2, "width": 4, "height": 100}], 10, 8) == [(0, 2, 3, 8)]
    assert redact.boxes([{"x": 0.5, "y": 0, "width": 0.25, "height": 1}], 10, 8, "normalized") == [(5, 0, 8, 8)]
    assert redact.boxes([{"x": 0, "y": 0, "width": 20, "height": 8}], 10, 8, "auto-fit") == [(0, 0, 10, 8)]
    picture = np.zeros((120, 200, 4), np.uint8)
    picture[:, :, 3] = 255
    picture[50:70, 80:120, :3] = 90  # the body
    for i in range(8):  # eight glyphs at the top left
        x = 6 + i * 8
        picture[5:13, x : x + 2, :3] = 255
        picture[5:7, x : x + 5, :3] = 255
        picture[11:13, x : x + 5, :3] = 255
    found = redact.text_regions(picture)
    assert len(found) == 1 and found[0][0] <= 6 and found[0][1] <= 5 and found[0][2] >= 67 and found[0][3] >= 13 and found[0][3] < 40
    assert redact.text_regions(np.zeros((30, 30, 4), np.uint8)) == []
    wrap = np.zeros((4, 10), bool)
    wrap[1, 9] = wrap[2, 0] = True
    assert len(redact.components(wrap, 9)) == 2, "rows do not wrap"
    assert redact.percentile(np.array([1, 2, 3, 4]), 0.5) == 2


def test_frames_through_the_plan(spark):
    raw = codecs.encapsulate([codecs.rle_encode(PIXELS.astype("<u2").tobytes(), codecs.Image(32, 32, 1, 16, 16))])
    tail = raw[: -8]
    e = part10.read_elements(objects.from_bytes(spark, [("native", part10_bytes()), ("rle", part10_bytes(RLE, encapsulated=tail + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)))]))
    f = frames.extract_frames(e)
    assert f.count() == 2
    out = {r.instance_id: bytes(r.bytes) for r in frames.transcode(f, EXPLICIT).collect()}
    assert out["native"] == out["rle"] == PIXELS.astype("<u2").tobytes()
    dark = {r.instance_id: np.frombuffer(r.bytes, "<u2").reshape(32, 32) for r in frames.redact_frames(f, [{"x": 4, "y": 2, "width": 8, "height": 3}], action="white").collect()}
    want = PIXELS.copy()
    want[2:5, 4:12] = 65535
    assert all(np.array_equal(d, want) for d in dark.values())
    png = frames.pictures(f).collect()
    assert all(codecs.png_decode(bytes(r.content)).shape == (32, 32, 4) for r in png)
    jpeg = frames.transcode(f, "1.2.840.10008.1.2.4.201")  # without a codec
    assert jpeg.filter("concern is not null").count() == 2 and frames.transcode(f, "1.2.840.10008.1.2.4.201", "skip").count() == 0
    assert frames.stretch(np.array([[10, 110]], np.uint8)).tolist() == [[0, 255]]


def test_documents_and_archives(spark):
    docs = spark.createDataFrame([("d1", "application/pdf", "My report", bytearray(b"%PDF-1"))], "instance_id string, mime_type string, title string, bytes binary")
    wrapped = packages.wrap_documents(docs)
    assert validate.validate(wrapped).count() == 0
    made = writer.write_bytes(wrapped)
    back = packages.unwrap_documents(part10.read_elements(made)).first()
    assert bytes(back.content) == b"%PDF-1" and back.file_name == "My_report.pdf" and back.mime_type == "application/pdf"
    import io
    import zipfile

    z = packages.zip_by(made.withColumn("study", F.lit("s")).withColumn("content_type", F.lit("application/dicom")), "study").first()
    names = zipfile.ZipFile(io.BytesIO(bytes(z.archive)))
    assert names.namelist() == ["d1.dcm", "manifest.json"] and names.read("d1.dcm")[128:132] == b"DICM"
    k = made.select(kinds.kind_of(kinds.format_of(F.col("content"))).alias("k")).first().k
    assert k == "dicom"


def test_folders_files_and_streams(spark, tmp_path):
    files = objects.from_bytes(spark, [("a", part10_bytes()), ("b", part10_bytes())])
    folder = str(tmp_path / "in")
    assert writer.write_files(files, folder) == 2
    (tmp_path / "in" / ".hidden.dcm").write_bytes(b"x")
    assert objects.read_folder(spark, folder).count() == 2 and objects.read_folder(spark, folder, max_files=1).count() == 1 and objects.read_folder(spark, folder, extensions=["png"]).count() == 0
    seen = []
    q = streams.start(part10.read_elements(objects.watch_folder(spark, folder).filter("source_uri not like '%hidden%'")), lambda df, _: seen.extend(r.instance_id for r in df.select("instance_id").distinct().collect()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert len(set(seen)) == 2
    records = spark.createDataFrame([("s", "i1"), ("s", "i1"), ("s", "i2")], "study_uid string, sop_uid string").withColumn("ts", F.timestamp_seconds(F.lit(1000)))
    records.write.parquet(str(tmp_path / "rec"))
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "rec"))
    q = streams.study_totals(stream, "ts", "10 minutes").writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n_instances) from totals").first()[0] == 2


def test_builder(spark, tmp_path):
    p = Pipeline(spark).from_bytes([("a", part10_bytes()), ("b", part10_bytes(uids=("2.25.101", "2.25.102", "2.25.104")))]).of("dicom")
    study = p.with_validation("strict").to_imaging_study().build().first()
    assert (study.number_of_series, study.number_of_instances) == (1, 2)
    assert {r.tag for r in p.to_selection(Selection("Modality")).build().collect()} == {"00080060"}
    masked = p.with_deidentification().to_dicom().build().collect()
    assert all(b"DOE" not in bytes(r.content) for r in masked)
    assert p.with_burned_in_redaction(regions=[{"x": 0, "y": 0, "width": 2, "height": 2}]).to_pictures().build().count() == 2
    assert p.to_entities().build().count() == 2 and p.to_instances().build().count() == 2 and p.concerns().count() == 0
    assert Pipeline(spark).from_bytes([("j", b'{"a": 1}')]).of("json").to_structured_value().build().selectExpr("variant_get(value, '$.a', 'int') AS a").first().a == 1
    for bad in (Pipeline(spark).of("dicom").to_elements(), p, p.with_transcoding(EXPLICIT).to_entities(), Pipeline(spark).from_bytes([]).of("json").to_entities()):
        with pytest.raises(BuildError):
            bad.build()
    with pytest.raises(BuildError):
        p.to_entities().to_instances()


def test_dump_lines(spark):
    lines = ["(0008,0060) CS [CT]                                     #   2, 1 Modality", "(0028,0010) US 32                                       #   2, 1 Rows", "garbage", "(0010,0010) PN (no value available)                     #   0, 0 PatientName"]
    got = metadata.parse_dump(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.tag, r.vr, r.value, r.keyword) for r in got] == [("00080060", "CS", "CT", "Modality"), ("00280010", "US", "32", "Rows"), ("00100010", "PN", "", "PatientName")]


def test_dictionary_is_consistent():
    assert all(KEYWORDS[e.keyword] == t for t, e in TAGS.items()) and len(set(KEYWORDS)) == len(TAGS)


def jpeg_lossless(px, predictor, bits, shift=0, restart_rows=0):
    """A plain encoder: one scan, one table in which every category has five bits."""
    rows, columns, n = px.shape
    low = (px >> shift).astype(int)
    code, intervals = [], []

    def guess(i, j, k, first):
        if i == first:
            return low[i, j - 1, k] if j else 1 << (bits - shift - 1)
        if not j:
            return low[i - 1, j, k]
        a, b, c = (int(x) for x in (low[i, j - 1, k], low[i - 1, j, k], low[i - 1, j - 1, k]))
        return (a, b, c, a + b - c, a + (b - c) // 2, b + (a - c) // 2, (a + b) // 2)[predictor - 1]

    step = restart_rows or rows
    for first in range(0, rows, step):
        code = []
        for i in range(first, min(rows, first + step)):
            for j in range(columns):
                for k in range(n):
                    d = (int(low[i, j, k]) - int(guess(i, j, k, first))) % 65536
                    d = d - 65536 if d > 32768 else d
                    size = abs(d).bit_length()
                    code.append(f"{size:05b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if 0 < size < 16 else ""))
        s = "".join(code)
        s += "1" * (-len(s) % 8)
        intervals.append(int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00"))
    seg = lambda m, body: bytes([255, m]) + struct.pack(">H", len(body) + 2) + body
    body = b"".join(x + (bytes([255, 0xD0 + i % 8]) if i + 1 < len(intervals) else b"") for i, x in enumerate(intervals))
    head = seg(0xC3, struct.pack(">BHHB", bits, rows, columns, n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n))) + seg(0xC4, bytes([0, 0, 0, 0, 0, 17] + [0] * 11) + bytes(range(17)))
    head += seg(0xDD, struct.pack(">H", restart_rows * columns)) if restart_rows else b""
    return b"\xff\xd8" + head + seg(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + bytes([predictor, 0, shift])) + body + b"\xff\xd9"


def test_lossless_jpeg_round_trip():
    rng = np.random.default_rng(4)
    for predictor in range(1, 8):
        for bits, n, shift, restart in ((8, 3, 0, 0), (12, 1, 0, 3), (16, 1, 0, 0), (16, 1, 2, 2)):
            px = (rng.integers(0, 1 << bits, (7, 9, n)) >> shift) << shift
            data = jpeg_lossless(px, predictor, bits, shift, restart)
            got, depth = jpeg.decode_lossless(data)
            assert depth == bits and np.array_equal(got, px), (predictor, bits, shift)
    im = codecs.Image(7, 9, 1, 16, 16)
    assert codecs.DECODERS["1.2.840.10008.1.2.4.70"](data + b"\0", im) == px.astype("<u2").tobytes()
    for bad in (data[:-40], b"\xff\xd8\xff", b"", data.replace(b"\xff\xc3", b"\xff\xc0"), data[:30]):
        with pytest.raises(codecs.CodecError):
            codecs.jpeg_lossless_decode(bad, im)
    with pytest.raises(codecs.CodecError):
        codecs.jpeg_lossless_decode(data, codecs.Image(9, 7, 1, 16, 16))


def test_image_files_are_redacted_or_held_back(spark):
    picture = np.full((8, 10, 4), 200, np.uint8)
    made = [("p", codecs.png_encode(picture)), ("t", codecs.tiff_encode(picture)), ("j", b"\xff\xd8\xff\xe0"), ("d", codecs.png_encode(picture)[:40]), ("n", None)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in made], "instance_id string, content binary")
    got = {r.instance_id: r for r in frames.redact_images(df, [{"x": 2, "y": 1, "width": 3, "height": 2}]).collect()}
    want = picture.copy()
    want[1:3, 2:5, :3] = 0
    assert np.array_equal(codecs.png_decode(bytes(got["p"].content)), want) and np.array_equal(codecs.tiff_decode(bytes(got["t"].content)), want)
    assert all(got[i].content is None and got[i].concern for i in "jdn") and got["p"].concern is None


def java_image(spark):
    """The JVM's picture classes, an implementation of JPEG that is not ours; JVMs without them skip the test."""
    try:
        jvm = spark.sparkContext._jvm
        jvm.java.lang.System.setProperty("java.awt.headless", "true")
        assert jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").hasNext()
    except Exception:
        pytest.skip("no javax.imageio")
    return jvm


def test_dct_jpeg_against_another_codec(spark):
    jvm = java_image(spark)
    y, x = np.mgrid[0:45, 0:53]
    rgb = np.stack([128 + 90 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), 60 + x + y], 2).astype(np.uint8)
    data = codecs.jpeg_file(rgb, 95)
    theirs = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    flat = np.array(list(theirs.getRGB(0, 0, 53, 45, None, 0, 53)), np.int64)
    got = np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], 1).reshape(45, 53, 3)
    assert np.abs(got - codecs.jpeg_picture(data)).max() <= 2 and np.abs(got - rgb).mean() < 3
    for kind in (1, 10):  # RGB (coded with subsampled colours) and grey
        image = jvm.java.awt.image.BufferedImage(53, 45, kind)
        for j in range(45):
            for i in range(53):
                r, g, b = rgb[j, i].tolist()
                if kind == 10:
                    image.getRaster().setSample(i, j, 0, g)
                else:
                    image.setRGB(i, j, r << 16 | g << 8 | b)
        stream = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(image, "jpeg", stream)
        ours = codecs.jpeg_picture(bytes(stream.toByteArray()))
        assert ours.shape == (45, 53, 3 if kind == 1 else 1)
        assert np.abs(ours.astype(int) - (rgb if kind == 1 else rgb[:, :, 1:2])).mean() < 4


def test_dct_jpeg_round_trips_and_damage():
    rng = np.random.default_rng(5)
    for shape in ((8, 16, 3), (1, 1, 1), (17, 9, 1), (30, 41, 3)):
        px = rng.integers(0, 256, shape).astype(np.uint8)
        got, bits, transform = jpeg.decode_dct(jpeg.encode_baseline(px, 100))
        assert (bits, transform) == (8, None) and np.abs(got - px).max() <= 1
    data = jpeg.encode_baseline(px)
    for n in range(0, len(data) - 2, 37):
        with pytest.raises(jpeg.JpegError):
            jpeg.decode_dct(data[:n])
    with pytest.raises(jpeg.JpegError, match="process 9"):
        jpeg.decode_dct(data.replace(b"\xff\xc0", b"\xff\xc9", 1))
    with pytest.raises(jpeg.JpegError, match="scan parameters"):  # a progressive picture whose scan is a sequential one
        jpeg.decode_dct(data.replace(b"\xff\xc0", b"\xff\xc2", 1))
    with pytest.raises(codecs.CodecError):
        codecs.jpeg_dct_decode(data, codecs.Image(30, 40, 3))
    lengths = jpeg._code_lengths({s: 2**s for s in range(25)})
    assert max(lengths.values()) == 16 and sum(2.0**-n for n in lengths.values()) <= 1 - 2.0**-16


def test_frames_to_and_from_baseline_jpeg(spark):
    grey = np.clip(np.add.outer(np.arange(32), np.arange(32)) * 4, 0, 255).astype(np.uint8)
    rgb = np.stack([grey, grey.T[::-1], 255 - grey], 2)
    rows = [
        ("deep", 0, EXPLICIT, 32, 32, 1, 16, 12, False, "MONOCHROME1", 0, 1.0, 0.0, 2048.0, 4096.0, "CT", None, 0, 16, (grey.astype("<u2") * 16).tobytes(), None),
        ("rgb", 0, EXPLICIT, 32, 32, 3, 8, 8, False, "RGB", 1, 1.0, 0.0, None, None, "US", None, 0, 16, rgb.transpose(2, 0, 1).tobytes(), None),
        ("422", 0, codecs.JPEG_BASELINE, 32, 32, 3, 8, 8, False, "YBR_FULL_422", 0, 1.0, 0.0, None, None, "US", None, 0, 16, codecs.jpeg_file(rgb, 100), None),
        ("bad", 0, codecs.JPEG_BASELINE, 32, 32, 1, 8, 8, False, "MONOCHROME2", 0, 1.0, 0.0, None, None, "US", None, 0, 16, b"\xff\xd8\xff", None),
    ]
    f = spark.createDataFrame(rows, frames.FRAME)
    coded = frames.transcode(f, codecs.JPEG_BASELINE)
    got = {r.instance_id: r for r in coded.collect()}
    assert (got["deep"].photometric, got["deep"].stored, got["deep"].center) == ("MONOCHROME2", 8, None) and (got["rgb"].photometric, got["rgb"].planar) == ("YBR_FULL", 0)
    seen = {r.instance_id: r for r in frames.pictures(coded, "rgba").collect()}
    picture = lambda k: np.frombuffer(seen[k].content, np.uint8).reshape(32, 32, 4)[:, :, :3].astype(int)
    assert np.abs(picture("deep")[:, :, 0] - (255 - grey)).max() <= 6 and np.abs(picture("rgb") - rgb).mean() < 4 and np.abs(picture("422") - rgb).max() <= 3
    assert seen["bad"].content is None and seen["bad"].concern
    native = {r.instance_id: r for r in frames.redact_frames(f, [{"x": 0, "y": 0, "width": 4, "height": 2}]).collect()}
    assert (native["422"].photometric, native["422"].transfer_syntax_uid) == ("YBR_FULL", EXPLICIT)
    black = np.frombuffer(native["422"].bytes, np.uint8).reshape(32, 32, 3)
    assert (black[:2, :4] == (0, 128, 128)).all() and native["bad"].concern
    files = spark.createDataFrame([("j", codecs.jpeg_file(rgb, 100)), ("cut", codecs.jpeg_file(rgb)[:300])], "instance_id string, content binary")
    out = {r.instance_id: r for r in frames.redact_images(files, [{"x": 0, "y": 0, "width": 16, "height": 16}]).collect()}
    assert out["j"].concern is None and codecs.jpeg_picture(bytes(out["j"].content))[:16, :16].max() <= 2
    assert out["cut"].content is None and out["cut"].concern


def test_palettes_reach_the_frames(spark):
    def palette_object(segmented):
        us = lambda *v: struct.pack(f"<{len(v)}H", *v)
        body = element("0020000D", "UI", b"2.25.1") + element("00280002", "US", us(1)) + element("00280004", "CS", b"PALETTE COLOR") + element("00280010", "US", us(1)) + element("00280011", "US", us(4)) + element("00280100", "US", us(8)) + element("00280101", "US", us(8)) + element("00280103", "US", us(0))
        body += b"".join(element(f"0028110{i}", "US", us(4, 10, 16)) for i in (1, 2, 3))
        tables = {1: (0, 16384, 32768, 49152), 2: (256,) * 4, 3: (0, 0, 0, 65280)}
        if segmented:
            coded = {1: us(0, 1, 0, 1, 3, 49152), 2: us(0, 4, *tables[2]), 3: us(0, 3, 0, 0, 0, 0, 1, 65280)}
            body += b"".join(element(f"0028122{i}", "OW", coded[i]) for i in (1, 2, 3))
        else:
            body += b"".join(element(f"0028120{i}", "OW", us(*tables[i])) for i in (1, 2, 3))
        return body + element("7FE00010", "OW", bytes([9, 11, 12, 200]))

    made = [(name, b"\0" * 128 + b"DICM" + element("00020010", "UI", EXPLICIT.encode()) + palette_object(seg)) for name, seg in (("plain", False), ("segmented", True))]
    f = frames.extract_frames(part10.read_elements(objects.from_bytes(spark, made)))
    want = [[0, 1, 0], [64, 1, 0], [128, 1, 0], [192, 1, 255]]
    for r in frames.pictures(f, "rgba").collect():
        assert r.concern is None and np.frombuffer(r.content, np.uint8).reshape(4, 4)[:, :3].tolist() == want, r.instance_id
    drawn = frames.transcode(f, codecs.JPEG_BASELINE)
    assert {(r.samples, r.photometric, r.palette) for r in drawn.collect()} == {(3, "YBR_FULL", None)}


def test_mixed_objects_become_frames_or_captures(spark):
    grey = np.add.outer(np.arange(6), np.arange(5)).astype(np.uint8)[:, :, None] * 10
    deep = (grey.astype(np.uint16) * 300)
    rgb = np.dstack([grey[:, :, 0], grey[:, :, 0] + 1, grey[:, :, 0] + 2]).astype(np.uint8)
    made = [("dicom", part10_bytes()), ("png", codecs.png_encode(rgb)), ("tiff", codecs.tiff_encode(deep)), ("grey", codecs.png_encode(grey)), ("cut", codecs.png_encode(rgb)[:50])]
    source = objects.from_bytes(spark, made)
    p = Pipeline(spark).from_reader(lambda s: source).of("imaging")
    got = {r.instance_id: r for r in p.with_normalization("frames", stretched=True).to_frames().build().collect()}
    assert got["png"].bytes == rgb.tobytes() and got["tiff"].bytes == deep.astype("<u2").tobytes() and got["dicom"].bytes == PIXELS.astype("<u2").tobytes()
    assert max(got["grey"].bytes) == 255 and got["cut"].bytes is None and got["cut"].concern
    out = {r.instance_id: r for r in p.with_normalization("dicom").to_objects().build().collect()}
    assert out["dicom"].content == made[0][1] and out["cut"].content is None and out["cut"].concern
    back = frames.extract_frames(part10.read_elements(objects.from_bytes(spark, [(k, bytes(out[k].content)) for k in ("png", "tiff", "grey")])))
    again = {r.instance_id: (r.rows, r.columns, r.samples, r.allocated, r.bytes) for r in back.collect()}
    assert again == {"png": (6, 5, 3, 8, rgb.tobytes()), "tiff": (6, 5, 1, 16, deep.astype("<u2").tobytes()), "grey": (6, 5, 1, 8, grey.tobytes())}
    odd = objects.from_bytes(spark, [("text", b"hello")])
    with pytest.raises(Exception, match="neither DICOM"):
        Pipeline(spark).from_reader(lambda s: odd).of("imaging").with_normalization("dicom").to_objects().build().collect()
    kept = Pipeline(spark).from_reader(lambda s: odd).of("imaging").with_normalization("dicom", "passthrough").to_objects().build().first()
    assert kept.content == b"hello" and kept.concern
    with pytest.raises(BuildError):
        Pipeline(spark).from_reader(lambda s: odd).of("dicom").with_normalization("dicom").to_objects().build()


def test_bodies_are_sent(spark):
    import http.server
    import threading

    seen = {}

    class Store(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen[self.headers["Content-Type"]] = body
            self.send_response(409 if b"refuse" in body else 200)
            self.end_headers()
            self.wfile.write(b"stored")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    parts = spark.createDataFrame([("one", "a", b"first"), ("one", "b", b"second"), ("two", "c", b"refuse")], "batch_id string, instance_id string, content binary")
    out = {r.batch_id: r for r in packages.send_http(packages.multipart_body(parts), f"http://127.0.0.1:{server.server_port}/studies").collect()}
    server.shutdown()
    assert (out["one"].status, out["one"].response, out["one"].concern) == (200, b"stored", None) and (out["two"].status, out["two"].concern) == (409, "status 409")
    lost = packages.send_http(packages.multipart_body(parts), "http://127.0.0.1:1/studies", timeout=2).collect()
    assert all(r.status is None and r.concern for r in lost)


def test_study_references(spark):
    e = part10.read_elements(objects.from_bytes(spark, [("a", part10_bytes()), ("b", part10_bytes())]))
    rows = fhir.records(e)
    study = lambda **o: json.loads(fhir.imaging_study(rows, **o).first().resource)
    plain = study()
    assert "endpoint" not in plain and plain["subject"] == {"reference": "#patient"}
    told = study(subject="reference", endpoints={"study": ["Endpoint/1"], "series": [{"identifier": {"system": "urn:x", "value": "7"}}]}, templates={"study": "Endpoint/{StudyInstanceUID}", "series": "Endpoint/{SOPInstanceUID}-{StudyID}", "subject": "Patient/p-{ PatientSex }"})
    assert told["endpoint"] == [{"reference": "Endpoint/1"}, {"reference": "Endpoint/2.25.101"}]
    assert told["series"][0]["endpoint"] == [{"identifier": {"system": "urn:x", "value": "7"}}]  # no StudyID: no templated reference
    assert told["subject"] == {"reference": "Patient/p-F"} and "contained" not in told
    assert study(subject={"reference": "Group/3", "display": "G"})["subject"] == {"reference": "Group/3", "display": "G"}
    for bad in ({"subject": {"reference": "Endpoint/1"}}, {"subject": {}}, {"endpoints": {"study": ["Patient/1"]}}, {"endpoints": {"instance": []}}, {"endpoints": {"study": ["#e"]}}, {"subject": {"identifier": {"value": "1", "system": "no uri"}}}):
        with pytest.raises(ValueError):
            fhir.imaging_study(rows, **bad)
