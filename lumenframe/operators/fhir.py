"""Study, series and instance aggregation to FHIR R4 ImagingStudy."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.dictionary import KEYWORDS
from lumenframe.functions.dicom import clean, contact_point, fhir_date, fhir_unsigned, gender, human_name, modality_list, non_blank, started, urn_oid, valid_uid
from lumenframe.operators.mapping import Mapping
from lumenframe.operators.objects import facts
from lumenframe.operators.select import Selection, pivot_first

TAGS = (
    "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "SOPClassUID", "Modality", "ModalitiesInStudy", "StudyID", "AccessionNumber", "StudyDate", "StudyTime", "SeriesDate", "SeriesTime", "TimezoneOffsetFromUTC",
    "StudyDescription", "SeriesDescription", "SeriesNumber", "InstanceNumber", "NumberOfStudyRelatedSeries", "NumberOfStudyRelatedInstances", "PatientID", "IssuerOfPatientID", "PatientName", "PatientBirthDate", "PatientSex", "PatientTelephoneNumbers", "PatientTelecomInformation",
)
#: The tags of the elements that a study is made of.
NEEDED = frozenset(KEYWORDS[t] for t in TAGS)
DCM = "http://dicom.nema.org/resources/ontology/DCM"


def records(elements: DataFrame) -> DataFrame:
    """One row per object with the elements that the mapping reads, and `seen`, which orders the objects."""
    top = elements.filter("depth = 0")
    wide = pivot_first(top, Selection(*TAGS), last=True)
    return wide.withColumn("seen", F.col("instance_id"))


def object_records(parsed: DataFrame) -> DataFrame:
    """Records of whole parsed objects, seen in the order of their source (path, then part)."""
    return facts(parsed, Selection(*TAGS), ("instance_id", "seen"), last=True)


def first_known(value: str | Column, order: str | Column = "seen") -> Column:
    """Aggregate: the earliest value that is not blank."""
    v = F.col(value) if isinstance(value, str) else value
    return F.min(F.when(v.isNotNull() & (F.trim(v.cast("string")) != ""), F.struct(F.col(order) if isinstance(order, str) else order, v.alias("v"))))["v"]


def ordered_union(values: Column, order: str | Column = "seen") -> Column:
    """Aggregate: distinct values of arrays in order of first appearance. Values of one group only (a study's modalities, names)."""
    o = F.col(order) if isinstance(order, str) else order
    pairs = F.array_sort(F.collect_set(F.when(F.size(values) > 0, F.struct(o.alias("o"), values.alias("v")))))
    return F.array_distinct(F.flatten(F.transform(pairs, lambda p: p["v"])))


#: By kind of UID: its column, and the rule that one value of each other column for it is.
_OWNED = {
    "study": ("StudyInstanceUID", {"PatientID": "study of several patients", "IssuerOfPatientID": "study of several patient issuers", "NumberOfStudyRelatedSeries": "study with several series totals", "NumberOfStudyRelatedInstances": "study with several instance totals"}),
    "series": ("SeriesInstanceUID", {"StudyInstanceUID": "series in several studies", "Modality": "series of several modalities"}),
    "instance": ("SOPInstanceUID", {"SeriesInstanceUID": "instance in several series", "SOPClassUID": "instance of several classes"}),
    "class": ("SOPClassUID", {}),
}


def integrity(rows: DataFrame) -> DataFrame:
    """Violations (rule, uid) of records: one owner, class and patient for each UID, and valid UIDs and numbers.

    One pass and one shuffle: each record gives a row for each of its UIDs, with
    64-bit hashes of what must agree and a bit for each invalid value; these are
    combined before the shuffle, and UIDs are tested once they are distinct.
    """
    wide = max(len(rules) for _, rules in _OWNED.values())
    numbers, dates = ("SeriesNumber", "InstanceNumber"), ("StudyDate", "SeriesDate", "PatientBirthDate")
    wrong = [(non_blank(F.col(c)).isNotNull() & fhir_unsigned(F.col(c)).isNull()) for c in numbers] + [(non_blank(F.col(c)).isNotNull() & fhir_date(F.col(c)).isNull()) for c in dates]
    bits = reduce(Column.__add__, (F.when(F.coalesce(w, F.lit(False)), 1 << i).otherwise(0) for i, w in enumerate(wrong)))

    def claim(kind: str) -> Column:
        key, rules = _OWNED[kind]
        values = [F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in rules] + [F.lit(None).cast("long")] * (wide - len(rules))
        return F.struct(F.lit(kind).alias("kind"), F.col(key).alias("uid"), *(v.alias(f"h{i}") for i, v in enumerate(values)), (bits if kind == "instance" else F.lit(0)).cast("int").alias("bits"))

    claims = rows.select(F.explode(F.array(*map(claim, _OWNED))).alias("c")).select("c.*")
    held = claims.groupBy("kind", "uid").agg(*(f(f"h{i}").alias(f"{n}{i}") for i in range(wide) for f, n in ((F.min, "lo"), (F.max, "hi"))), F.bit_or("bits").alias("bits"))
    found = []
    for kind, (key, rules) in _OWNED.items():
        own = F.col("kind") == kind
        found += [F.when(own & F.col("uid").isNotNull() & (F.col(f"lo{i}") != F.col(f"hi{i}")), rule) for i, rule in enumerate(rules.values())]
        found.append(F.when(own & ~valid_uid(F.col("uid")), f"invalid {key}"))
    found += [F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, f"invalid {c}") for i, c in enumerate((*numbers, *dates))]
    return held.select(F.explode(F.array_compact(F.array(*found))).alias("rule"), "uid")


_HEAD = {
    "study_id": "StudyID", "accession": "AccessionNumber", "description": "StudyDescription", "patient_id": "PatientID", "issuer": "IssuerOfPatientID", "patient_name": "PatientName", "sex": "PatientSex", "phone": "PatientTelephoneNumbers", "telecom": "PatientTelecomInformation",
    "declared_series": "NumberOfStudyRelatedSeries", "declared_instances": "NumberOfStudyRelatedInstances",
}


def _earliest(value: Column) -> Column:
    """What `first_known` takes the least of."""
    return F.when(value.isNotNull() & (F.trim(value.cast("string")) != ""), F.struct("seen", value.alias("v")))


def _first_of_each(rows: Column, key: str, *rest: str) -> Column:
    """Of an array of structs with `seen` the earliest of each key, in the order seen: struct(seen, key, rest)."""
    by_key = F.sort_array(F.transform(rows, lambda r: F.struct(r[key].alias(key), r["seen"].alias("seen"), *(r[c].alias(c) for c in rest))))
    before = F.concat(F.array(F.lit(None)), F.transform(F.slice(by_key, 1, F.greatest(F.size(by_key) - 1, F.lit(0))), lambda r: F.struct(r[key].alias(key))))
    pairs = F.zip_with(by_key, before, lambda x, y: F.struct(x.alias("x"), (y.isNotNull() & x[key].eqNullSafe(y[key])).alias("again")))
    return F.sort_array(F.transform(F.filter(pairs, lambda z: ~z["again"]), lambda z: F.struct(z["x"]["seen"].alias("seen"), z["x"][key].alias(key), *(z["x"][c].alias(c) for c in rest))))


def hierarchy(rows: DataFrame, further: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, studies), with instances deduplicated by UID; the first seen object of a UID wins. further: columns of a study by name, of each its earliest value.

    A study folds its series: its earliest value is the least of theirs. Two
    shuffles, the second of a row a series, and no join; the records are read
    once.
    """
    head = {n: _earliest(F.col(c)) for n, c in _HEAD.items()} | {
        "started": _earliest(started(F.col("StudyDate"), F.col("StudyTime"), F.col("TimezoneOffsetFromUTC"))), "birth_date": _earliest(fhir_date(F.col("PatientBirthDate"))),
        "s_modality": _earliest(F.col("Modality")), "s_number": _earliest(fhir_unsigned(F.col("SeriesNumber"))), "s_description": _earliest(F.col("SeriesDescription")), "s_started": _earliest(started(F.col("SeriesDate"), F.col("SeriesTime"), F.col("TimezoneOffsetFromUTC"))),
    }
    head |= {n: F.when(c.isNotNull(), F.struct("seen", c.alias("v"))) for n, c in (further or {}).items()}
    own = F.struct("seen", clean(F.col("SOPInstanceUID")).alias("uid"), clean(F.col("SOPClassUID")).alias("class"), fhir_unsigned(F.col("InstanceNumber")).alias("number"))
    said = F.struct(F.coalesce("ModalitiesInStudy", "Modality").alias("modality"), F.col("PatientName").alias("name"), F.col("PatientTelephoneNumbers").alias("phone"), F.col("PatientTelecomInformation").alias("telecom"), non_blank(F.col("NumberOfStudyRelatedSeries")).alias("n_series"), non_blank(F.col("NumberOfStudyRelatedInstances")).alias("n_instances"))
    # what was said is said by most records of a series alike: one row for each way of saying it, before the series is put together
    # dealt by series first, both steps of putting a series together need no other shuffle
    rows = rows.repartition("StudyInstanceUID", "SeriesInstanceUID")
    ways = rows.groupBy("StudyInstanceUID", "SeriesInstanceUID", said.alias("m")).agg(*(F.min(c).alias(n) for n, c in head.items()), F.min("seen").alias("seen"), F.collect_list(own).alias("instances"))
    series = ways.groupBy("StudyInstanceUID", "SeriesInstanceUID").agg(*(F.min(n).alias(n) for n in head), F.min("seen").alias("first"), F.collect_list(F.struct("seen", "m")).alias("texts"), F.flatten(F.collect_list("instances")).alias("instances"))
    series = series.withColumn("instances", _first_of_each(F.col("instances"), "uid", "class", "number")).withColumn("texts", _first_of_each(F.col("texts"), "m"))
    fields = [F.col("s_modality")["v"].alias("modality"), F.col("s_number")["v"].alias("number"), F.col("s_description")["v"].alias("s_description"), F.col("s_started")["v"].alias("s_started")]
    series = series.select("StudyInstanceUID", "SeriesInstanceUID", *(n for n in head if not n.startswith("s_")), *fields, F.size("instances").cast("long").alias("n_instances"), F.col("first").alias("seen"), "instances", "texts")
    return series, studies_of(series, further=further or ())


def studies_of(series: DataFrame, each: Column | None = None, further: Iterable[str] = ()) -> DataFrame:
    """Series of `hierarchy` folded to studies; each: what a study keeps of a series, in order of appearance."""
    names = [*_HEAD, "started", "birth_date", *further]
    listed = [F.sort_array(F.collect_list(each)).alias("series")] if each is not None else []
    out = series.groupBy("StudyInstanceUID").agg(*(F.min(n)["v"].alias(n) for n in names), _first_of_each(F.flatten(F.collect_list("texts")), "m").alias("texts"), F.count(F.lit(1)).alias("n_series"), F.sum("n_instances").alias("n_instances"), *listed)
    union = lambda values: F.array_distinct(F.array_compact(values))
    said = lambda f: F.transform("texts", lambda p: f(p["m"]))
    unions = {
        "modalities": union(F.flatten(said(lambda m: F.coalesce(modality_list(m["modality"]), F.array().cast("array<string>"))))), "names": union(said(lambda m: human_name(m["name"]))),
        "telecoms": union(F.flatten(said(lambda m: F.array(contact_point(m["phone"]), contact_point(m["telecom"]))))),
        "totals": F.greatest(F.size(union(said(lambda m: m["n_series"]))), F.size(union(said(lambda m: m["n_instances"])))),
    }
    return out.withColumns(unions).drop("texts")


def _pruned(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


_REFERENCE = "reference string, type string, identifier struct<system:string,value:string>, display string"


def _reference(value: str | dict, what: str) -> dict:
    """A checked Reference; ValueError says what is wrong with it."""
    held = {"reference": value.strip()} if isinstance(value, str) else dict(value)
    identifier, target = held.get("identifier") or {}, held.get("reference") or ""
    types = ("Endpoint",) if what == "Endpoint" else ("Patient", "Device", "Group")
    if not target and not (identifier.get("value") or "").strip():
        raise ValueError(f"{what}: a reference needs reference or identifier.value")
    if re.search(r"\s", target) or target.startswith("#"):
        raise ValueError(f"{what}: {target!r} has blanks or is of a contained resource")
    if identifier.get("system") is not None and not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:\S+", identifier["system"]):
        raise ValueError(f"{what}: the identifier's system is no URI")
    named = re.search(r"(?:^|/)([A-Z][A-Za-z]+)/[^/]+(?:/_history/[^/]+)?$", target)
    if (named and named[1] not in types) or (held.get("type") is not None and held["type"].split("/")[-1] not in types):
        raise ValueError(f"{what}: the target is one of {types}")
    return held


def _as_column(held: dict) -> Column:
    """A Reference struct; unset fields are null and so not in the JSON."""
    return F.from_json(F.lit(json.dumps(held)), _REFERENCE)


def _text(rows: DataFrame, template: str) -> Column:
    """A record's text of a template; null without one of its tokens."""
    return Mapping().with_missing("omit").text(template, {KEYWORDS[t]: non_blank(F.col(t)) for t in TAGS if t in rows.columns})


def _templated(rows: DataFrame, keys: list[str], template: str, name: str) -> DataFrame:
    """keys and the distinct texts of a template over the group's records, first seen first; records that lack a token give none."""
    texts = rows.select(*keys, "seen", _text(rows, template).alias("_t")).filter("_t is not null")
    once = texts.groupBy(*keys, "_t").agg(F.min("seen").alias("seen"))
    return once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "_t"))), lambda x: x["_t"]).alias(name))


def _endpoints(df: DataFrame, rows: DataFrame, keys: list[str], given: list, template: str | None) -> tuple[DataFrame, Column | None]:
    """df with what the template needs, and its column of given and templated Endpoint references, if there are any."""
    fixed = [_as_column(_reference(x, "Endpoint")) for x in given]
    if not template:
        return df, F.array(*fixed) if fixed else None
    named = f"_texts_{len(keys)}"
    found = df.join(_templated(rows, keys, template, named), keys, "left")
    made = F.transform(F.coalesce(F.col(named), F.array().cast("array<string>")), lambda t: F.from_json(F.to_json(F.struct(t.alias("reference"))), _REFERENCE))
    return found, F.array_distinct(F.concat(*([F.array(*fixed)] if fixed else []), made))


def coding(code: Column) -> Column:
    return F.struct(F.lit(DCM).alias("system"), code.alias("code"))


def _series_entry(endpoints: Column | None) -> Column:
    """A series of the resource; `_o` orders them."""
    return F.struct(
        F.col("seen").alias("_o"), clean(F.col("SeriesInstanceUID")).alias("uid"), F.col("number"), coding(F.col("modality")).alias("modality"), _pruned(F.col("s_description")).alias("description"), F.col("n_instances").alias("numberOfInstances"), F.col("s_started").alias("started"),
        *([F.when(F.size(endpoints) > 0, endpoints).alias("endpoint")] if endpoints is not None else []),
        F.transform("instances", lambda i: F.struct(i["uid"].alias("uid"), F.struct(F.lit("urn:ietf:rfc:3986").alias("system"), F.concat(F.lit("urn:oid:"), i["class"]).alias("code")).alias("sopClass"), i["number"].alias("number"))).alias("instance"),
    )


def imaging_study(rows: DataFrame, profile: str = "full", subject: str | dict = "contained", endpoints: dict[str, list] | None = None, templates: dict[str, str] | None = None, conflicts: str = "error") -> DataFrame:
    """study_uid, number_of_series, number_of_instances, modalities and the pruned resource as JSON.

    study-summary: totals are those that objects declare; conflicting ones raise, unless conflicts is first.
    subject: contained, reference, none, or a Reference of its own. endpoints: lists of References (or their texts) for study and series.
    templates: texts with {Keyword} tokens for study and series endpoints and, in reference mode, the subject
    (Patient/{PatientID} if not given); a record that lacks a token gives no reference.
    """
    if profile not in ("full", "study-summary"):
        raise ValueError("profile is full or study-summary")
    if conflicts not in ("error", "first"):
        raise ValueError("conflicts is error or first")
    if not isinstance(subject, dict) and subject not in ("contained", "reference", "none"):
        raise ValueError("subject is contained, reference, none or a Reference")
    endpoints, templates = endpoints or {}, templates or {}
    if set(endpoints) - {"study", "series"} or set(templates) - {"study", "series", "subject"}:
        raise ValueError("endpoints are of study or series, templates also of subject")
    # a reference is the earliest text of its study: an aggregate like the others, so that the records need not be read again
    further = {"_subject": _text(rows, templates.get("subject", "Patient/{PatientID}"))} if subject == "reference" else {}
    series, studies = hierarchy(rows, further)
    if profile == "full":
        series, series_endpoints = _endpoints(series, rows, ["StudyInstanceUID", "SeriesInstanceUID"], endpoints.get("series", []), templates.get("series"))
        studies = studies_of(series, _series_entry(series_endpoints), further)
    studies, study_endpoints = _endpoints(studies, rows, ["StudyInstanceUID"], endpoints.get("study", []), templates.get("study"))
    if isinstance(subject, dict):
        refers = _as_column(_reference(subject, "subject"))
    elif subject == "reference":
        refers = F.when(F.col("_subject").isNotNull(), F.struct(F.col("_subject").alias("reference")))
    else:
        refers = F.struct(F.lit("#patient").alias("reference"))
    if profile == "full":
        listed = F.transform("series", lambda s: s.dropFields("_o"))
    else:
        studies = studies.withColumn("n_series", fhir_unsigned(F.col("declared_series")).cast("long")).withColumn("n_instances", fhir_unsigned(F.col("declared_instances")).cast("long"))
        if conflicts == "error":
            broken = F.raise_error(F.concat(F.lit("conflicting totals in study "), F.coalesce("StudyInstanceUID", F.lit("")))).cast("boolean")
            studies = studies.filter(F.when(F.col("totals") > 1, broken).otherwise(F.lit(True)))
        listed = None
    identifiers = F.filter(
        F.array(
            F.struct(F.lit("urn:dicom:uid").alias("system"), urn_oid(F.col("StudyInstanceUID")).alias("value")),
            F.when(non_blank(F.col("study_id")).isNotNull(), F.struct(F.lit(None).cast("string").alias("system"), non_blank(F.col("study_id")).alias("value"))),
            F.when(non_blank(F.col("accession")).isNotNull(), F.struct(F.lit(None).cast("string").alias("system"), non_blank(F.col("accession")).alias("value"))),
        ),
        lambda x: x.isNotNull(),
    )
    patient = F.struct(
        F.lit("Patient").alias("resourceType"), F.lit("patient").alias("id"),
        F.when(F.col("patient_id").isNotNull(), F.array(F.struct(F.col("patient_id").alias("value"), F.when(F.col("issuer").isNotNull(), F.struct(F.col("issuer").alias("display"))).alias("assigner")))).alias("identifier"),
        F.when(F.size("names") > 0, F.col("names")).alias("name"),
        F.when(F.size("telecoms") > 0, F.col("telecoms")).alias("telecom"),
        F.when(F.col("sex").isNotNull(), gender(F.col("sex"))).alias("gender"), F.col("birth_date").alias("birthDate"),
    )
    fields = [
        F.lit("ImagingStudy").alias("resourceType"),
        *([F.array(patient).alias("contained")] if subject == "contained" else []),
        identifiers.alias("identifier"),
        F.lit("available").alias("status"),
        F.when(F.size("modalities") > 0, F.transform("modalities", lambda m: coding(m))).alias("modality"),
        *([refers.alias("subject")] if subject != "none" else []),
        *([F.when(F.size(study_endpoints) > 0, study_endpoints).alias("endpoint")] if study_endpoints is not None else []),
        F.col("started"),
        F.col("n_series").alias("numberOfSeries"),
        F.col("n_instances").alias("numberOfInstances"),
        _pruned(F.col("description")).alias("description"),
        *([listed.alias("series")] if listed is not None else []),
    ]
    return studies.select(F.col("StudyInstanceUID").alias("study_uid"), F.col("n_series").alias("number_of_series"), F.col("n_instances").alias("number_of_instances"), F.array_join("modalities", "\\").alias("modalities"), F.to_json(F.struct(*fields)).alias("resource"))
