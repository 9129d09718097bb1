"""Scalar functions over element values, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.dictionary import MIME_CLASSES, MIME_EXTENSIONS


def clean(s: Column) -> Column:
    """Text without NUL padding and outer blanks."""
    return F.trim(F.replace(s, F.lit("\x00"), F.lit("")))


def non_blank(s: Column) -> Column:
    t = clean(s)
    return F.when(F.length(t) > 0, t)


def parse_da(s: Column) -> Column:
    """A date from yyyyMMdd (or the old yyyy.MM.dd); anything else is null."""
    t = F.replace(clean(s), F.lit("."), F.lit(""))
    return F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))


def parse_tm(s: Column) -> Column:
    """Microseconds of the day from HH[MM[SS[.ffffff]]]; null if out of range."""
    t = F.replace(clean(s), F.lit(":"), F.lit(""))
    ok = t.rlike(r"^([01]\d|2[0-3])([0-5]\d(([0-5]\d|60)(\.\d{1,6})?)?)?$")
    part = lambda i, n: F.coalesce(F.substring(t, i, n).try_cast("long"), F.lit(0))
    micros = F.coalesce(F.rpad(F.regexp_extract(t, r"\.(\d{1,6})$", 1), 6, "0").try_cast("long"), F.lit(0))
    return F.when(ok, ((part(1, 2) * 60 + F.when(F.length(t) >= 4, part(3, 2)).otherwise(0)) * 60 + F.when(F.length(t) >= 6, part(5, 2)).otherwise(0)) * 1_000_000 + micros)


def parse_dt(s: Column) -> Column:
    """A UTC timestamp from YYYY[MM[DD[HH[MM[SS[.f]]]]]][+ZZZZ]; missing parts are their least value, a missing zone is UTC."""
    t = clean(s)
    p = r"^(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\.\d{1,6})?([+-]\d{4})?$"
    g = lambda i, least: F.coalesce(F.nullif(F.regexp_extract(t, p, i), F.lit("")), F.lit(least))
    stamp = F.concat(g(1, "0000"), F.lit("-"), g(2, "01"), F.lit("-"), g(3, "01"), F.lit(" "), g(4, "00"), F.lit(":"), g(5, "00"), F.lit(":"), g(6, "00"), g(7, ""))
    zone = g(8, "+0000")
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    shift = F.when(zone.startswith("-"), minutes).otherwise(-minutes)
    return F.when(t.rlike(p), F.timestamp_add("MINUTE", shift, stamp.try_cast("timestamp")))


def values(s: Column) -> Column:
    """The values of a multi-valued text, cleaned."""
    return F.transform(F.split(s, r"\\"), lambda x: clean(x))


def is_values(s: Column) -> Column:
    """Integer strings; of text after the digits the digits count, other text is null."""
    return F.transform(F.split(s, r"\\"), lambda x: F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("long"))


def ds_values(s: Column) -> Column:
    return F.transform(F.split(s, r"\\"), lambda x: F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"))


def last_value(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.element_at(xs, -1))


def tag_id(group: Column, element: Column) -> Column:
    return F.concat(F.lpad(F.hex(group.cast("long")), 4, "0"), F.lpad(F.hex(element.cast("long")), 4, "0"))


def is_private(tag: Column) -> Column:
    return F.conv(F.substring(tag, 1, 4), 16, 10).cast("int") % 2 == 1


def pn_representation(s: Column) -> Column:
    """The first of the alphabetic, ideographic and phonetic groups that is not blank."""
    return F.get(F.filter(F.transform(F.split(s, "="), lambda x: F.trim(x)), lambda x: F.length(x) > 0), F.lit(0))


def human_name(s: Column) -> Column:
    """struct(use, text, family, given, prefix, suffix) of FAMILY^GIVEN^MIDDLE^PREFIX^SUFFIX."""
    parts = F.transform(F.split(pn_representation(s), r"\^"), lambda x: F.trim(x))
    at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    given = F.filter(F.array(at(1), at(2)), lambda x: x.isNotNull())
    text = F.array_join(F.concat(given, F.filter(F.array(at(0)), lambda x: x.isNotNull())), " ")
    return F.when(pn_representation(s).isNotNull(), F.struct(F.lit("usual").alias("use"), text.alias("text"), at(0).alias("family"), given.alias("given"), at(3).alias("prefix"), at(4).alias("suffix")))


def contact_point(s: Column) -> Column:
    """struct(system, value): an address with @ is an email, a web address a url, all else a phone."""
    t = non_blank(s)
    system = F.when(t.contains("@"), "email").when(F.lower(t).rlike("^https?://"), "url").otherwise("phone")
    return F.when(t.isNotNull(), F.struct(system.alias("system"), t.alias("value")))


def gender(s: Column) -> Column:
    t = F.upper(clean(s))
    return F.when(t == "M", "male").when(t == "F", "female").when(t == "O", "other").otherwise("unknown")


def fhir_date(s: Column) -> Column:
    """A FHIR date of a year, a month or a day; null if the date does not exist."""
    t = clean(s)
    year, month, day = F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)
    return (
        F.when(~t.rlike(r"^\d{4}(\d{2}){0,2}$") | (year == "0000"), F.lit(None).cast("string"))
        .when(F.length(t) == 4, year)
        .when((F.length(t) == 6) & month.between("01", "12"), F.concat_ws("-", year, month))
        .when((F.length(t) == 8) & F.try_to_date(t, "yyyyMMdd").isNotNull(), F.concat_ws("-", year, month, day))
    )


def valid_offset(s: Column) -> Column:
    t = clean(s)
    return t.rlike(r"^(\+(0\d|1[0-3])[0-5]\d|\+1400|-(0\d|1[01])[0-5]\d|-1200)$") & (t != "-0000")


def started(date: Column, time: Column, offset: Column) -> Column:
    """A FHIR instant if day, seconds and offset are all there, else the date."""
    d, t, z = fhir_date(date), clean(time), clean(offset)
    full = (F.length(d) == 10) & t.rlike(r"^([01]\d|2[0-3])[0-5]\d([0-5]\d|60)(\.\d{1,6})?$") & valid_offset(offset)
    clock = F.concat(F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":"), F.substring(t, 5, 9))
    return F.when(F.coalesce(full, F.lit(False)), F.concat(d, F.lit("T"), clock, F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2))).otherwise(d)


def urn_oid(uid: Column) -> Column:
    return F.concat(F.lit("urn:oid:"), clean(uid))


def valid_uid(uid: Column) -> Column:
    t = clean(uid)
    return F.coalesce(t.rlike(r"^[0-2](\.(0|[1-9]\d*))+$") & (F.length(t) <= 64), F.lit(False))


def modality_list(s: Column) -> Column:
    """Distinct modality codes in order of appearance."""
    return F.array_distinct(F.filter(values(s), lambda x: F.length(x) > 0))


def decode_text(raw: Column, charset: Column) -> Column:
    """Text of the supported character sets; null for others, for escapes and for bytes that are not in the set."""
    one = F.coalesce(F.upper(clean(charset)), F.lit(""))
    hexed = F.hex(raw)
    escaped = F.instr(F.regexp_replace(hexed, "(..)", "$1 "), "1B ") > 0
    ascii_ok = ~F.regexp_replace(hexed, "(..)", "$1 ").rlike("[89A-F][0-9A-F] ")
    text = (
        F.when(one.isin("", "ISO_IR 6", "ISO 2022 IR 6") & ascii_ok, F.decode(raw, "US-ASCII"))
        .when(one == "ISO_IR 100", F.decode(raw, "ISO-8859-1"))
        .when((one == "ISO_IR 192") & F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    )
    return F.when(~escaped, clean(text))


def inline_binary(s: Column) -> Column:
    """Bytes of base64 text, with or without a data URI before it; null if it is none."""
    return F.try_to_binary(F.regexp_replace(clean(s), r"^data:[^,]*,", ""), F.lit("base64"))


def mime(s: Column) -> Column:
    return F.lower(F.trim(F.get(F.split(s, ";"), F.lit(0))))


def _lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def mime_extension(s: Column) -> Column:
    return _lookup(mime(s), MIME_EXTENSIONS, "bin")


def mime_sop_class(s: Column) -> Column:
    return _lookup(mime(s), MIME_CLASSES, None)


def document_bytes(raw: Column, length: Column) -> Column:
    """The declared length of a document's bytes; all of them if none (or more) is declared."""
    return F.when(length.isNotNull() & (length >= 0) & (length < F.length(raw)), F.substring(raw, F.lit(1), length.cast("int"))).otherwise(raw)


def safe_name(s: Column, default: str = "document") -> Column:
    t = F.regexp_replace(F.regexp_replace(F.trim(s), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(F.length(t) > 0, F.substring(t, 1, 100)).otherwise(default)


def photometric(s: Column) -> Column:
    return F.coalesce(F.upper(non_blank(s)), F.lit("MONOCHROME1"))


def image_bytes(rows: Column, columns: Column, samples: Column, bits: Column) -> Column:
    return F.ceil(rows.cast("long") * columns.cast("long") * samples.cast("long") * bits.cast("long") / 8).cast("long")


def fhir_unsigned(s: Column) -> Column:
    """An integer of 0 to 2147483647, else null."""
    t = clean(s)
    return F.when(t.rlike(r"^\d+$") & (t.try_cast("long") <= 2147483647), t.try_cast("int"))


def _times(h: Column, factor: int) -> Column:
    """h * factor modulo 2**32, by halves of the factor, so that no product passes 2**63."""
    m = F.lit(0xFFFFFFFF).cast("long")
    high = F.shiftleft((h * F.lit(factor >> 16)).bitwiseAND(m), 16).bitwiseAND(m)
    return (high + h * F.lit(factor & 0xFFFF)).bitwiseAND(m)


def deterministic_uid(seed: Column) -> Column:
    """2.25. and the decimals of two 32-bit folds over the UTF-16 units of a text."""
    units = F.transform(F.sequence(F.lit(1), F.greatest(F.length(F.hex(F.encode(seed, "UTF-16BE"))) / 4, F.lit(1)).cast("int")), lambda i: F.coalesce(F.conv(F.substring(F.hex(F.encode(seed, "UTF-16BE")), i * 4 - 3, F.lit(4)), 16, 10).try_cast("long"), F.lit(-1).cast("long")))
    units = F.filter(units, lambda u: u >= 0)
    start = F.struct(F.lit(2166136261).cast("long").alias("a"), F.lit(2166136261).cast("long").alias("b"))
    fold = F.aggregate(units, start, lambda h, u: F.struct(_times(h["a"].bitwiseXOR(u), 16777619).alias("a"), _times(h["b"].bitwiseXOR(u * 31), 2246822519).alias("b")))
    return F.substring(F.concat(F.lit("2.25."), fold["a"].cast("string"), fold["b"].cast("string")), 1, 64)


def new_uid() -> Column:
    """A random 2.25. UID of a version 4 UUID's 128 bits (as decimal text, by two halves)."""
    h = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    half = lambda i: F.conv(F.substring(h, i, 16), 16, 10).cast("decimal(38,0)")
    return F.concat(F.lit("2.25."), F.substring(half(1).cast("string"), 1, 19), F.lpad(half(17).cast("string"), 20, "0"))
