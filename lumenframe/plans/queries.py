"""Registered queries: operators bound to the driver's tables, each with SQL that gives the same rows.

A customer stands for a study, an order for a series, an order line for an
instance; the columns of an order are its elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import dicom, pixels
from lumenframe.operators import deid, entities, fhir, validate
from lumenframe.operators.mapping import Mapping
from lumenframe.operators.select import Selection, frame_indexes, pivot_first, query
from lumenframe.sources import kinds
from lumenframe.streaming import streams

PATH = "array<struct<tag:string,item:int>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element rows of orders: five top-level elements each, by ordinal."""
    o = table(spark, sf_dir, "orders")
    rows = F.array(
        *(
            F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), value.cast("string").alias("str"))
            for i, (tag, vr, value) in enumerate(
                (("00080020", "DA", F.date_format("o_orderdate", "yyyyMMdd")), ("00080050", "SH", F.col("o_orderstatus")), ("00080060", "CS", F.col("o_orderpriority")), ("0020000D", "UI", F.concat(F.lit("1.2."), F.col("o_custkey"))), ("0020000E", "UI", F.concat(F.lit("1.3."), F.col("o_orderkey"))))
            )
        )
    )
    e = o.select(F.col("o_orderkey").cast("string").alias("instance_id"), F.explode(rows).alias("e")).select("instance_id", "e.*")
    return e.select("*", F.lit(False).alias("is_meta"), F.lit("").alias("path_text"), F.lit(0).alias("depth"), F.array().cast(PATH).alias("path"), F.lit(True).alias("is_complete"))


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of order lines; (l_orderkey, l_linenumber) repeats like an instance that was sent twice."""
    seen = F.concat_ws("|", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0"))
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    values = {
        "StudyInstanceUID": F.concat(F.lit("1.2."), F.col("o_custkey")), "SeriesInstanceUID": F.concat(F.lit("1.3."), F.col("o_orderkey")), "SOPInstanceUID": F.concat(F.lit("1.4."), F.col("o_orderkey"), F.lit("."), F.col("l_linenumber")), "SOPClassUID": F.lit("1.2.840.10008.5.1.4.1.1.7"),
        "Modality": F.substring("o_orderpriority", 1, 1), "PatientID": F.col("o_custkey").cast("string"), "InstanceNumber": F.col("l_linenumber").cast("string"), "StudyDate": F.date_format("o_orderdate", "yyyyMMdd"),
    }
    return joined.select(*(values.get(t, F.lit(None)).cast("string").alias(t) for t in fhir.TAGS), seen.alias("seen"))


_SEEN = "lpad(l_orderkey::VARCHAR,12,'0')||'|'||lpad(l_linenumber::VARCHAR,4,'0')||'|'||lpad(l_partkey::VARCHAR,12,'0')||'|'||lpad(l_suppkey::VARCHAR,12,'0')"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@registered(
    f"""WITH r AS (SELECT '1.2.'||o_custkey AS study_uid, o_orderkey, l_linenumber, substr(o_orderpriority,1,1) AS m, {_SEEN} AS seen FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
    m AS (SELECT study_uid, m, min(seen) AS s FROM r GROUP BY 1,2), u AS (SELECT study_uid, string_agg(m, '\\' ORDER BY s) AS modalities FROM m GROUP BY 1)
    SELECT r.study_uid, count(DISTINCT o_orderkey) AS number_of_series, count(DISTINCT (o_orderkey, l_linenumber)) AS number_of_instances, any_value(modalities) AS modalities FROM r JOIN u USING (study_uid) GROUP BY 1"""
)
def q_study_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fhir.imaging_study(line_records(spark, sf_dir)).select("study_uid", "number_of_series", "number_of_instances", "modalities")


@registered('SELECT o_orderkey::VARCHAR AS instance_id, strftime(o_orderdate, \'%Y%m%d\') AS "StudyDate", o_orderpriority AS "Modality" FROM orders')
def q_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_first(order_elements(spark, sf_dir), Selection("StudyDate", "Modality"))


_EVENT = "SELECT user_id::VARCHAR AS instance_id, {f}(event_type, (ts, event_id)) AS \"Modality\" FROM events GROUP BY user_id"


def _event_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("instance_id"), F.struct("ts", "event_id").alias("ordinal"), F.lit("00080060").alias("tag"), F.col("event_type").alias("str"))


@registered(_EVENT.format(f="arg_min"))
def q_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_first(_event_elements(spark, sf_dir), Selection("Modality"))


@registered(_EVENT.format(f="arg_max"))
def q_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_first(_event_elements(spark, sf_dir), Selection("Modality"), last=True)


def _templates(spark: SparkSession, sf_dir: str, missing: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    row = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nation has 25 rows at any scale
    known = F.col("n_name") if missing == "error" else F.when(F.col("c_acctbal") >= 0, F.col("n_name"))
    m = Mapping().with_property("site", "A1").with_computed("label", "{PatientName} ({prop.site}) of {PatientAddress}").with_missing(missing)
    columns = dict(m.columns({"00100010": F.col("c_name"), "00101040": known}))
    return row.select("c_custkey", columns["label"].alias("label"))


@registered("SELECT c_custkey, c_name||' (A1) of '||n_name AS label FROM customer JOIN nation ON c_nationkey=n_nationkey")
def q_template_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir, "error")


@registered("SELECT c_custkey, c_name||' (A1) of '||CASE WHEN c_acctbal>=0 THEN n_name ELSE '' END AS label FROM customer JOIN nation ON c_nationkey=n_nationkey")
def q_template_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir, "blank")


@registered("SELECT c_custkey, CASE WHEN c_acctbal>=0 THEN c_name||' (A1) of '||n_name END AS label FROM customer JOIN nation ON c_nationkey=n_nationkey")
def q_template_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir, "omit")


@registered(
    """WITH r AS (SELECT o_custkey, o_orderkey, l_linenumber, substr(o_orderpriority,1,1) AS m, (l_partkey % 3)::VARCHAR AS cls FROM lineitem JOIN orders ON l_orderkey=o_orderkey)
    SELECT 'instance of several classes' AS rule, '1.4.'||o_orderkey||'.'||l_linenumber AS uid FROM r GROUP BY o_orderkey, l_linenumber HAVING count(DISTINCT cls)>1
    UNION ALL SELECT 'study of several patient issuers', '1.2.'||o_custkey FROM r GROUP BY o_custkey HAVING count(DISTINCT m)>1"""
)
def q_study_summary_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_records(spark, sf_dir).withColumn("SOPClassUID", F.concat(F.lit("1.2."), F.substring("seen", 19, 12).cast("long") % 3)).withColumn("IssuerOfPatientID", F.col("Modality"))
    return fhir.integrity(rows)


@registered(
    f"""WITH r AS (SELECT '1.2.'||o_custkey AS study_uid, substr(o_orderpriority,1,1) AS m, min({_SEEN}) AS s FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2)
    SELECT study_uid, string_agg(m, ',' ORDER BY s) AS modalities FROM r GROUP BY 1"""
)
def q_modality_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_records(spark, sf_dir)
    return rows.groupBy(F.col("StudyInstanceUID").alias("study_uid")).agg(F.array_join(fhir.ordered_union(dicom.modality_list(F.col("Modality"))), ",").alias("modalities"))


def _concerns(found: DataFrame) -> DataFrame:
    return found.select("instance_id", "code", "tag", "ordinal")


@registered(
    """WITH e AS (SELECT l_orderkey::VARCHAR AS instance_id, '0020'||lpad(l_linenumber::VARCHAR,4,'0') AS tag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus)::BIGINT AS ordinal FROM lineitem),
    d AS (SELECT *, row_number() OVER (PARTITION BY instance_id, tag ORDER BY ordinal) AS n FROM e) SELECT instance_id, 'DuplicateAttribute' AS code, tag, ordinal FROM d WHERE n>1"""
)
def q_validate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("instance_id"), F.concat(F.lit("0020"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0")).alias("tag"), F.row_number().over(order).cast("long").alias("ordinal"))
    return _concerns(validate.duplicates(e.select("*", F.lit(False).alias("is_meta"), F.lit("").alias("path_text"))))


@registered(
    """SELECT o_orderkey::VARCHAR AS instance_id, 'MissingRequiredMetaAttribute' AS code, t AS tag, NULL::BIGINT AS ordinal FROM orders, (VALUES ('00020001'),('00020002'),('00020003'),('00020010')) v(t)
    WHERE NOT (t='00020001' OR (t='00020010' AND o_orderstatus='F') OR (t='00020002' AND o_orderkey%2=0))"""
)
def q_validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tags = F.array(F.lit("00020001"), F.when(F.col("o_orderstatus") == "F", "00020010"), F.when(F.col("o_orderkey") % 2 == 0, "00020002"))
    e = o.select(F.col("o_orderkey").cast("string").alias("instance_id"), F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("tag"), F.lit(True).alias("is_meta"))
    return _concerns(validate.missing_meta(e))


@registered("SELECT o_orderkey::VARCHAR AS instance_id, 'InvalidMetaTagPlacement' AS code, CASE WHEN o_orderstatus='F' THEN '00080050' ELSE '00020010' END AS tag, o_orderkey::BIGINT AS ordinal FROM orders WHERE o_orderstatus IN ('F','O')")
def q_validate_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tag = F.when(F.col("o_orderstatus") == "F", "00080050").when(F.col("o_orderstatus") == "O", "00020010").otherwise("00080060")
    e = o.select(F.col("o_orderkey").cast("string").alias("instance_id"), F.col("o_orderkey").cast("long").alias("ordinal"), tag.alias("tag"), (F.col("o_orderstatus") == "F").alias("is_meta"), F.lit("").alias("path_text"))
    return _concerns(validate.misplaced_meta(e))


@registered(
    """SELECT c_custkey, CASE c_custkey%6 WHEN 0 THEN 'ANON^ANON' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN c_name WHEN 4 THEN 'ANON^CLEAN' ELSE 'literal' END AS pn,
    CASE c_custkey%6 WHEN 0 THEN '[MASKED]' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN c_mktsegment WHEN 4 THEN '[CLEANED]' ELSE 'literal' END AS lo,
    CASE c_custkey%6 WHEN 0 THEN '19000101' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '20240101' WHEN 4 THEN '19000101' ELSE 'literal' END AS da FROM customer"""
)
def q_deid_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = F.array(*map(F.lit, ("X/Z/D", "Z*", "X", "K", "C", "literal")))
    action = F.element_at(actions, (F.col("c_custkey") % 6 + 1).cast("int"))
    masked = lambda vr, value, name: deid.masked_value(F.lit("00100010"), F.lit(vr), value, action).alias(name)
    return table(spark, sf_dir, "customer").select("c_custkey", masked("PN", F.col("c_name"), "pn"), masked("LO", F.col("c_mktsegment"), "lo"), masked("DA", F.lit("20240101"), "da"))


@registered(
    """WITH t AS (SELECT c_custkey, '0020000D|'||c_name AS s FROM customer), u AS (SELECT c_custkey, list_transform(range(1, length(s)+1), lambda i: unicode(substr(s, i, 1))::HUGEINT) AS c FROM t),
    f AS (SELECT c_custkey, list_reduce(list_prepend(2166136261::HUGEINT, c), lambda h, x: (xor(h::BIGINT, x::BIGINT)::HUGEINT * 16777619) % 4294967296) AS a, list_reduce(list_prepend(2166136261::HUGEINT, c), lambda h, x: (xor(h::BIGINT, (x*31)::BIGINT)::HUGEINT * 2246822519) % 4294967296) AS b FROM u)
    SELECT c_custkey, '2.25.'||a::VARCHAR||b::VARCHAR AS uid FROM f"""
)
def q_deid_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", deid.masked_value(F.lit("0020000D"), F.lit("UI"), F.col("c_name"), F.lit("U")).alias("uid"))


@registered(
    """SELECT event_id, CASE WHEN user_id%7=0 THEN 'KeyObjectSelection' WHEN user_id%7=1 THEN 'Segmentation' WHEN user_id%7=2 THEN 'StructuredReport' WHEN user_id%7=3 THEN 'Waveform' WHEN user_id%7=4 THEN 'PresentationState' WHEN event_type='click' THEN 'WorklistItem' ELSE 'Image' END AS entity_kind FROM events"""
)
def q_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    modality = F.element_at(F.array(*map(F.lit, ("KO", "SEG", "SR", "ECG", "PR", "CT", "MR"))), (F.col("user_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", entities.entity_kind(F.lit(None).cast("string"), modality, F.col("event_type") == "click").alias("entity_kind"))


@registered("SELECT c_custkey, split_part(c_name,'#',1) AS family, split_part(c_name,'#',2) AS given, split_part(c_name,'#',2)||' '||split_part(c_name,'#',1) AS text FROM customer")
def q_human_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = dicom.human_name(F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit("^")), F.lit("^^Dr=x^y")))
    return table(spark, sf_dir, "customer").select("c_custkey", n["family"].alias("family"), n["given"][0].alias("given"), n["text"].alias("text"))


@registered("SELECT c_custkey, CASE c_custkey%3 WHEN 0 THEN 'email' WHEN 1 THEN 'url' ELSE 'phone' END AS system, CASE c_custkey%3 WHEN 0 THEN c_custkey||'@x.org' WHEN 1 THEN 'https://x.org/'||c_custkey ELSE '555-'||c_custkey END AS value FROM customer")
def q_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    s = F.when(F.col("c_custkey") % 3 == 0, F.concat(k, F.lit("@x.org "))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" https://x.org/"), k)).otherwise(F.concat(F.lit("555-"), k, F.lit("\x00")))
    c = dicom.contact_point(s)
    return table(spark, sf_dir, "customer").select("c_custkey", c["system"].alias("system"), c["value"].alias("value"))


@registered("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'other' ELSE 'unknown' END AS gender FROM orders")
def q_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dicom.gender(F.col("o_orderstatus")).alias("gender"))


@registered(
    """SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN strftime(o_orderdate,'%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate,'%Y-%m') WHEN 2 THEN strftime(o_orderdate,'%Y') END AS partial,
    CASE o_orderkey%4 WHEN 0 THEN strftime(o_orderdate,'%Y-%m-%d')||'T'||strftime(o_orderdate,'%H:%M:%S')||'+02:00' WHEN 1 THEN strftime(o_orderdate,'%Y-%m') WHEN 2 THEN strftime(o_orderdate,'%Y') END AS started,
    CASE WHEN o_orderkey%4=0 THEN strftime(o_orderdate,'%Y-%m-%d') END AS day FROM orders"""
)
def q_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyyMM")).when(k == 2, F.date_format("o_orderdate", "yyyy")).otherwise("20230230")
    day = F.date_format(dicom.parse_da(s), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", dicom.fhir_date(s).alias("partial"), dicom.started(s, F.date_format("o_orderdate", "HHmmss"), F.lit("+0200")).alias("started"), day.alias("day"))


@registered("""SELECT event_type AS study_uid, count(DISTINCT user_id) AS n_series, count(DISTINCT event_id) AS n_instances, string_agg(DISTINCT (user_id%3)::VARCHAR, ',' ORDER BY (user_id%3)::VARCHAR) AS modalities FROM events GROUP BY 1""")
def q_json_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.sources.metadata import studies_of_json

    e = table(spark, sf_dir, "events")
    field = lambda tag, c: F.concat(F.lit(f'"{tag}":{{"vr":"UI","Value":["'), c.cast("string"), F.lit('"]}'))
    text = F.concat(F.lit("["), F.lit("{"), F.concat_ws(",", field("0020000D", F.col("event_type")), field("0020000E", F.concat(F.col("event_type"), F.lit("-"), F.col("user_id"))), field("00080018", F.col("event_id")), field("00080060", F.col("user_id") % 3)), F.lit("}]"))
    return studies_of_json(e.select(F.col("event_id").cast("string").alias("instance_id"), text.alias("json")))


@registered("SELECT doc_id, CASE doc_id%5 WHEN 0 THEN 'image' WHEN 1 THEN 'dicom' WHEN 2 THEN 'image' ELSE 'unknown' END AS kind, CASE doc_id%5 WHEN 0 THEN 'png' WHEN 1 THEN 'dicom' WHEN 2 THEN 'jpeg' ELSE 'unknown' END AS format FROM documents")
def q_kind_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("doc_id") % 5, F.col("text").cast("binary")
    content = F.when(k == 0, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), text)).when(k == 1, F.concat(F.unhex(F.lit("00" * 128 + "4449434D")), text)).when(k == 2, F.concat(F.unhex(F.lit("FFD8FF")), text)).otherwise(text)
    fmt = kinds.format_of(content)
    return table(spark, sf_dir, "documents").select("doc_id", kinds.kind_of(fmt).alias("kind"), fmt.alias("format"))


@registered("SELECT p_partkey, unnest(range(1, p_size::BIGINT, 3))::INTEGER AS frame FROM part")
def q_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(frame_indexes(F.col("p_size"), {"start": 1, "step": 3})).alias("frame")).filter((F.col("frame") >= 1))


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, floor((least(greatest(l_quantity, 5.0), 45.0) - 5.0) / 40.0 * 255)::INTEGER AS grey FROM lineitem")
def q_window_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", pixels.window_level(F.col("l_quantity"), F.lit(25.0), F.lit(40.0)).alias("grey"))


@registered(
    """SELECT p_partkey, greatest(0, least(floor(p_size*0.5), 40))::INTEGER AS x0, greatest(0, least(floor(p_size*0.25-3), 40))::INTEGER AS y0, greatest(0, least(ceil(p_size*0.5+p_size*1.5), 40))::INTEGER AS x1, greatest(0, least(ceil(p_size*0.25-3+7.5), 40))::INTEGER AS y1 FROM part"""
)
def q_redact_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    r = pixels.region(s * 0.5, s * 0.25 - 3, s * 1.5, F.lit(7.5), F.lit(40), F.lit(40))
    return table(spark, sf_dir, "part").select("p_partkey", *(r[c].alias(c) for c in ("x0", "y0", "x1", "y1")))


@registered(
    """WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1,2), r AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS run, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM c)
    SELECT l_returnflag, min(l_quantity) AS threshold FROM r WHERE run > floor(0.975*(total-1)) GROUP BY 1"""
)
def q_histogram_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.percentile_threshold(table(spark, sf_dir, "lineitem"), "l_quantity", 0.975, ["l_returnflag"])


@registered(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS since FROM s GROUP BY user_id, k"""
)
def q_session_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.idle_batches(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")
    return out.select("user_id", "n", F.unix_micros(F.col("start").cast("timestamp")).alias("since"))


@registered(
    """WITH RECURSIVE kept AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL SELECT e.user_id, min(e.ts) FROM kept k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 1 HOUR GROUP BY e.user_id)
    SELECT user_id, count(*) AS n FROM kept GROUP BY 1"""
)
def q_dedupe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drop_repeats(table(spark, sf_dir, "events"), "user_id", "ts", "1 hour").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey AS last_int, l_linenumber::DOUBLE + 0.5 AS last_decimal FROM lineitem")
def q_module_is_ds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("l_partkey").cast("string"), F.lit("\\ "), F.col("l_suppkey").cast("string"), F.lit("abc"))
    decimal = F.concat(F.lit("1\\x\\"), F.col("l_linenumber").cast("string"), F.lit(".5 "))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dicom.last_value(dicom.is_values(text)).alias("last_int"), dicom.last_value(dicom.ds_values(decimal)).alias("last_decimal"))


@registered("SELECT DISTINCT c_custkey, c_mktsegment, c_name FROM customer WHERE c_name LIKE '%1_' AND c_mktsegment = 'BUILDING'")
def q_query_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "customer"), {"c_name": "*1?", "c_mktsegment": "BUILDING"}, return_keys=["c_custkey"])
