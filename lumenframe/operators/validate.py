"""Structural validation: one declarative query per rule, all giving concern rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.dictionary import CONTROL_TAGS, REQUIRED_META, VR_SIZE

CODES = ("MissingScope", "InvalidAttribute", "DuplicateAttribute", "InvalidMetaTagPlacement", "MissingRequiredMetaAttribute", "SequenceItemMismatch", "SequenceMismatch", "IncompleteAttribute", "ParserError")


#: Estimated bytes of a plan that a partition is given by `_by_instance`.
PARTITION_BYTES = 4 << 20
#: Plans of this size and more are of sources that do not tell theirs; Spark deals their rows.
UNKNOWN_BYTES = 1 << 60


def _by_instance(elements: DataFrame) -> DataFrame:
    """elements as they are if there are few, else dealt by instance_id to as many partitions as the input asks for.

    Without that a task's rows are as many as fit in 64 MB when compressed, and element rows of a million objects do.
    """
    size = int(elements._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # by files and row widths: nothing runs
    n = min(size // PARTITION_BYTES, 64 * elements.sparkSession.sparkContext.defaultParallelism) if size < UNKNOWN_BYTES else 0
    return elements.repartition(n, "instance_id") if n > 1 else elements


def _concern(df: DataFrame, severity: str, code: str, message: Column | str, event: str, ordinal: Column | None = None, tag: Column | None = None, path: Column | None = None) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(
        "instance_id",
        (F.col("ordinal") if ordinal is None else ordinal).cast("long").alias("ordinal"),
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        text.alias("message"),
        F.lit(event).alias("event"),
        (F.col("path_text") if path is None else path).cast("string").alias("path_text"),
        (F.col("tag") if tag is None else tag).cast("string").alias("tag"),
    )


def duplicates(elements: DataFrame) -> DataFrame:
    """Elements whose tag has been seen before in the same scope (object, meta or not, sequence item)."""
    scope = Window.partitionBy("instance_id", "is_meta", F.coalesce("path_text", F.lit("")), "tag").orderBy("ordinal")
    again = _by_instance(elements.filter(~F.col("tag").isin(*CONTROL_TAGS)).select("instance_id", "is_meta", "path_text", "tag", "ordinal")).withColumn("_nth", F.row_number().over(scope)).filter("_nth > 1")
    return _concern(again, "warning", "DuplicateAttribute", F.concat(F.lit("element "), F.col("tag"), F.lit(" repeats in its scope")), "onStartAttribute")


def invalid(elements: DataFrame) -> DataFrame:
    """Elements without a valid tag or with an unknown VR."""
    bad_tag = F.col("tag").isNull() | ~F.col("tag").rlike("^[0-9A-F]{8}$")
    bad_vr = F.col("vr").isNotNull() & ~F.col("vr").isin(*VR_SIZE, "NONE")
    return _concern(elements.filter(F.coalesce(bad_tag, F.lit(True)) | bad_vr), "error", "InvalidAttribute", "no valid data element tag or VR", "onStartAttribute")


def misplaced_meta(elements: DataFrame) -> DataFrame:
    """File meta elements in the data set and others in the file meta information."""
    group2 = F.startswith("tag", F.lit("0002"))
    return _concern(elements.filter((group2 & ~F.col("is_meta")) | (~group2 & F.col("is_meta"))), "error", "InvalidMetaTagPlacement", F.concat(F.lit("element "), F.col("tag"), F.lit(" is in the wrong set")), "onStartAttribute")


def missing_meta(elements: DataFrame, required: tuple[str, ...] = REQUIRED_META) -> DataFrame:
    """Required file meta elements that an object with file meta information lacks."""
    has = {f"_{i}": F.max(F.coalesce(F.col("tag") == t, F.lit(False))).alias(f"_{i}") for i, t in enumerate(required)}  # flags have a fixed size, sets do not
    held = _by_instance(elements.filter("is_meta").select("instance_id", "tag")).groupBy("instance_id").agg(*has.values())
    lacking = held.select("instance_id", F.explode(F.array_compact(F.array(*(F.when(~F.col(c), t) for c, t in zip(has, required, strict=True)), F.lit(None).cast("string")))).alias("tag"))
    none = F.lit(None)
    return _concern(lacking, "error", "MissingRequiredMetaAttribute", F.concat(F.lit("required file meta element "), F.col("tag"), F.lit(" is missing")), "onEndMetaSet", none, None, none)


def incomplete(elements: DataFrame) -> DataFrame:
    return _concern(elements.filter(~F.col("is_complete")), "error", "IncompleteAttribute", "the value is shorter than declared", "onEndAttribute")


def sequence_mismatches(elements: DataFrame) -> DataFrame:
    """Elements inside an item whose sequence is not among the object's elements at that place."""
    above = F.regexp_replace("path_text", r"[0-9A-F]{8}\[\d+\]/$", "")
    held = ("ordinal", "path_text", "tag")
    claim = lambda seq, above_, owns: F.struct(seq.alias("_seq"), above_.alias("_above"), F.lit(owns).alias("_owns"), *((F.when(F.lit(False), F.col(c)) if owns else F.col(c)).alias(c) for c in held))
    inner = F.when(F.col("depth") > 0, claim(F.try_element_at("path", F.lit(-1))["tag"], above, False))
    owner = F.when(F.col("vr") == "SQ", claim(F.col("tag"), F.coalesce("path_text", F.lit("")), True))
    claims = _by_instance(elements.filter("depth > 0 or vr = 'SQ'").select("instance_id", F.explode(F.array_compact(F.array(inner, owner))).alias("c")).select("instance_id", "c.*"))
    owned = F.max("_owns").over(Window.partitionBy("instance_id", "_seq", "_above"))
    unknown = F.col("instance_id").isNull() | F.col("_seq").isNull() | F.col("_above").isNull()
    return _concern(claims.withColumn("_owned", owned & ~unknown).filter("not _owns and not _owned"), "error", "SequenceMismatch", "the item belongs to no open sequence", "onStartItem")


def item_gaps(elements: DataFrame) -> DataFrame:
    """Items whose number leaves out an earlier item of the same sequence; empty items count as there only if an element says so."""
    items = _by_instance(elements.filter("depth > 0").select("instance_id", F.regexp_replace("path_text", r"\[\d+\]/$", "").alias("seq"), F.try_element_at("path", F.lit(-1))["item"].alias("item"), "path_text")).distinct()
    order = Window.partitionBy("instance_id", "seq").orderBy("item")
    gaps = items.withColumn("_gap", F.col("item") - F.coalesce(F.lag("item").over(order), F.lit(-1))).filter("_gap > 1")
    return _concern(gaps, "warning", "SequenceItemMismatch", "an item number is left out", "onStartItem", F.lit(None), F.lit(None))


def missing_scope(elements: DataFrame) -> DataFrame:
    return _concern(elements.filter(F.col("is_meta").isNull()), "error", "MissingScope", "an element stands outside of meta set, data set and item", "onStartAttribute")


def parser_errors(objects: DataFrame) -> DataFrame:
    """Objects that did not parse: objects(instance_id, status, error_message)."""
    none = F.lit(None)
    return _concern(objects.filter("status = 'error'"), "error", "ParserError", F.col("error_message"), "onError", none, none, none)


RULES = (missing_scope, invalid, duplicates, misplaced_meta, missing_meta, incomplete, sequence_mismatches, item_gaps)


def validate(elements: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """All concerns of all rules."""
    found = [rule(elements) for rule in RULES]
    if objects is not None:
        found.append(parser_errors(objects))
    return reduce(DataFrame.unionByName, found)


_ISSUE = "array<struct<ordinal:bigint,severity:string,code:string,message:string,event:string,path_text:string,tag:string>>"


def _issue(e: Column | None, severity: str, code: str, message: Column | str, event: str, tag: Column | None = None, path: Column | None = None) -> Column:
    none = F.lit(None)
    held = (none, none, none) if e is None else (e["ordinal"], e["path_text"], e["tag"])
    text = F.lit(message) if isinstance(message, str) else message
    fields = (held[0].cast("long").alias("ordinal"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("message"), F.lit(event).alias("event"))
    return F.struct(*fields, (held[1] if path is None else path).cast("string").alias("path_text"), (held[2] if tag is None else tag).cast("string").alias("tag"))


def _pairs(values: Column) -> Column:
    """Each value with the one before it (null for the first)."""
    before = F.concat(F.array(F.lit(None)), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))))
    return F.zip_with(values, before, lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def object_concerns(parsed: DataFrame) -> DataFrame:
    """parsed with `concerns`: those of all rules, found in each object's own row, without a shuffle."""
    e = F.col("elements")
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    is_false = lambda c: F.coalesce(c, F.lit(False))
    group2 = lambda x: F.startswith(x["tag"], F.lit("0002"))
    bad_tag = lambda x: F.coalesce(x["tag"].isNull() | ~x["tag"].rlike("^[0-9A-F]{8}$"), F.lit(True))
    bad_vr = lambda x: is_false(x["vr"].isNotNull() & ~x["vr"].isin(*VR_SIZE, "NONE"))
    each = lambda keep, *what: F.transform(F.filter(e, lambda x: is_false(keep(x))), lambda x: _issue(x, *what[:2], what[2](x) if callable(what[2]) else what[2], what[3]))
    scopes = F.array_sort(F.transform(F.filter(e, lambda x: ~x["tag"].isin(*CONTROL_TAGS)), lambda x: F.struct(x["is_meta"].alias("m"), F.coalesce(x["path_text"], F.lit("")).alias("p"), x["tag"].alias("tag"), x["ordinal"].alias("ordinal"), x["path_text"].alias("path_text"))))
    again = let(scopes, lambda s: F.filter(_pairs(s), lambda z: is_false(z["x"]["m"].eqNullSafe(z["y"]["m"]) & (z["x"]["p"] == z["y"]["p"]) & (z["x"]["tag"] == z["y"]["tag"]))))
    duplicated = F.transform(again, lambda z: _issue(z["x"], "warning", "DuplicateAttribute", F.concat(F.lit("element "), z["x"]["tag"], F.lit(" repeats in its scope")), "onStartAttribute"))
    required = F.array(*map(F.lit, REQUIRED_META))
    held = F.transform(F.filter(e, lambda x: is_false(x["is_meta"])), lambda x: x["tag"])
    lacking = F.when(F.exists(e, lambda x: is_false(x["is_meta"])), F.array_except(required, held)).otherwise(F.array().cast("array<string>"))
    missing = F.transform(lacking, lambda t: _issue(None, "error", "MissingRequiredMetaAttribute", F.concat(F.lit("required file meta element "), t, F.lit(" is missing")), "onEndMetaSet", t))
    above = lambda x: F.regexp_replace(x["path_text"], r"[0-9A-F]{8}\[\d+\]/$", "")
    inner = F.transform(F.filter(e, lambda x: x["depth"] > 0), lambda x: F.struct(x["ordinal"].alias("ordinal"), x["path_text"].alias("path_text"), x["tag"].alias("tag"), F.concat(above(x), F.lit("|"), F.try_element_at(x["path"], F.lit(-1))["tag"]).alias("owner")))
    owners = F.transform(F.filter(e, lambda x: x["vr"] == "SQ"), lambda x: F.concat(F.coalesce(x["path_text"], F.lit("")), F.lit("|"), x["tag"]))
    orphans = let(inner, lambda i: let(F.array_except(F.transform(i, lambda x: x["owner"]), owners), lambda lost: F.when(F.size(lost) > 0, F.filter(i, lambda x: F.array_contains(lost, x["owner"]))).otherwise(F.filter(i, lambda x: F.lit(False)))))
    homeless = F.transform(orphans, lambda x: _issue(x, "error", "SequenceMismatch", "the item belongs to no open sequence", "onStartItem"))
    items = F.array_sort(F.array_distinct(F.transform(F.filter(e, lambda x: x["depth"] > 0), lambda x: F.struct(F.regexp_replace(x["path_text"], r"\[\d+\]/$", "").alias("seq"), F.try_element_at(x["path"], F.lit(-1))["item"].alias("item"), x["path_text"].alias("path_text")))))
    gaps = let(items, lambda s: F.filter(_pairs(s), lambda z: z["x"]["item"] - F.when(is_false(z["x"]["seq"] == z["y"]["seq"]), z["y"]["item"]).otherwise(F.lit(-1)) > 1))
    left_out = F.transform(gaps, lambda z: _issue(None, "warning", "SequenceItemMismatch", "an item number is left out", "onStartItem", path=z["x"]["path_text"]))
    unread = F.array(_issue(None, "error", "ParserError", F.col("error_message"), "onError"))
    found = [
        each(lambda x: x["is_meta"].isNull(), "error", "MissingScope", "an element stands outside of meta set, data set and item", "onStartAttribute"),
        each(lambda x: bad_tag(x) | bad_vr(x), "error", "InvalidAttribute", "no valid data element tag or VR", "onStartAttribute"),
        duplicated,
        each(lambda x: (group2(x) & ~x["is_meta"]) | (~group2(x) & x["is_meta"]), "error", "InvalidMetaTagPlacement", lambda x: F.concat(F.lit("element "), x["tag"], F.lit(" is in the wrong set")), "onStartAttribute"),
        missing,
        each(lambda x: ~x["is_complete"], "error", "IncompleteAttribute", "the value is shorter than declared", "onEndAttribute"),
        homeless,
        left_out,
    ]
    return parsed.withColumn("concerns", F.when(F.col("error_message").isNull(), F.concat(*(x.cast(_ISSUE) for x in found))).otherwise(unread.cast(_ISSUE)))


def concern_rows(judged: DataFrame) -> DataFrame:
    """One row per concern of `object_concerns`, as `validate` gives."""
    return judged.select("instance_id", F.explode("concerns").alias("c")).select("instance_id", "c.*")


def strict_objects(judged: DataFrame) -> DataFrame:
    """Objects of `object_concerns`, raising when one with a warning or an error is read."""
    bad = F.filter("concerns", lambda c: c["severity"].isin("warning", "error"))
    broken = F.raise_error(F.concat(F.lit("validation failed: "), F.coalesce(F.get(bad, F.lit(0))["message"], F.lit("")))).cast("boolean")
    return judged.filter(F.when(F.size(bad) > 0, broken).otherwise(F.lit(True))).drop("concerns")


def strict(elements: DataFrame, concerns: DataFrame) -> DataFrame:
    """elements, raising when they are read if any warning or error is among the concerns."""
    bad = concerns.filter("severity in ('warning', 'error')").agg(F.count(F.lit(1)).alias("_n"), F.min("message").alias("_m"))
    checked = elements.crossJoin(F.broadcast(bad))  # one row
    return checked.filter(F.when(F.col("_n") > 0, F.raise_error(F.concat(F.lit("validation failed: "), F.col("_m"))).cast("boolean")).otherwise(F.lit(True))).drop("_n", "_m")
