"""Template-driven mapping of elements to named properties, compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.dictionary import KEYWORDS, TAGS, tag_of
from lumenframe.operators.objects import value_of

_TOKEN = re.compile(r"\{([^{}]+)\}")
POLICIES = ("error", "blank", "omit")


def as_text(c: Column, kind: str) -> Column:
    """How a value reads inside a template: dates in ISO form, lists joined by backslash, structs as JSON."""
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if kind.startswith("array<string"):
        return F.array_join(c, "\\")
    if kind.startswith("array<") and "struct" not in kind:
        return F.array_join(F.transform(c, lambda x: x.cast("string")), "\\")
    if kind.startswith(("struct", "map", "array")):
        return F.to_json(c)
    return c.cast("string")


@dataclass(frozen=True)
class Property:
    name: str
    tag: str | None = None
    template: str | None = None
    resolve: Callable[[dict[str, Column]], Column] | None = None
    transform: Callable[[Column], Column] | None = None
    phase: str = "end"


@dataclass(frozen=True)
class Mapping:
    """Tags and templates to (dotted) properties; immutable, each with_* gives a new one."""

    properties: tuple[Property, ...] = ()
    bag: dict[str, Any] = field(default_factory=dict)
    missing: str = "error"

    def with_tag(self, name: str, target: str, template: str | None = None, transform: Callable[[Column], Column] | None = None) -> Mapping:
        return replace(self, properties=(*self.properties, Property(target, tag_of(name), template, None, transform, "tag")))

    def with_computed(self, target: str, template: str | None = None, resolve: Callable[[dict[str, Column]], Column] | None = None, transform: Callable[[Column], Column] | None = None, phase: str = "end") -> Mapping:
        if phase not in ("start", "end"):
            raise ValueError("phase is start or end")
        return replace(self, properties=(*self.properties, Property(target, None, template, resolve, transform, phase)))

    def with_property(self, name: str, value: Any) -> Mapping:
        if not isinstance(value, (str, int, float, bool, type(None))):
            raise TypeError("properties are scalars")
        return replace(self, bag={**self.bag, name: value})

    def with_missing(self, policy: str) -> Mapping:
        if policy not in POLICIES:
            raise ValueError(f"policy is one of {POLICIES}")
        return replace(self, missing=policy)

    def needed_tags(self) -> tuple[str, ...]:
        """All tags that properties and template tokens read: what a reader has to keep."""
        out = [p.tag for p in self.properties if p.tag]
        for p in self.properties:
            for token in _TOKEN.findall(p.template or ""):
                tag = _dicom_token(token.strip())
                if tag:
                    out.append(tag)
        return tuple(dict.fromkeys(out))

    def text(self, template: str, lookup: dict[str, Column], key: Column | None = None, value: Column | None = None) -> Column:
        """The compiled template; null if a missing token omits the property."""
        parts: list[Column] = []
        at = 0
        for m in _TOKEN.finditer(template):
            if m.start() > at:
                parts.append(F.lit(template[at : m.start()]))
            token = m[1].strip()
            if token == "value" and value is not None:
                found = value
            elif token == "key" and key is not None:
                found = key
            elif token.startswith("prop."):
                held = self.bag.get(token[5:])
                found = F.lit(None if held is None else str(held)).cast("string")
            else:
                tag = _dicom_token(token)
                found = lookup[tag] if tag in lookup else lookup[token] if token in lookup else F.lit(None).cast("string")
            if self.missing == "blank":
                found = F.coalesce(found, F.lit(""))
            elif self.missing == "error":
                found = F.coalesce(found, F.raise_error(F.lit(f"template token {token!r} has no value")).cast("string"))
            parts.append(found)
            at = m.end()
        if at < len(template):
            parts.append(F.lit(template[at:]))
        return F.concat(*parts) if parts else F.lit("")

    def columns(self, lookup: dict[str, Column]) -> list[tuple[str, Column]]:
        """(property, expression) in order of definition: start phase, tags, end phase. lookup: a text column for each tag."""
        done: dict[str, Column] = {}
        order = [p for p in self.properties if p.phase == "start"] + [p for p in self.properties if p.phase == "tag"] + [p for p in self.properties if p.phase == "end"]
        for p in order:
            seen = {**lookup, **done}
            if p.resolve is not None:
                out = p.resolve(seen)
            elif p.tag is not None:
                out = lookup[p.tag]
                if p.template is not None:
                    out = F.when(out.isNotNull(), self.text(p.template, seen, F.lit(p.tag), out))
            else:
                out = self.text(p.template or "", seen)
            done[p.name] = p.transform(out) if p.transform is not None else out
        return list(done.items())

    def apply(self, elements: DataFrame, keys: Sequence[str] = ("instance_id",), value: str = "str") -> DataFrame:
        """One row per object with a column per property; the last occurrence of a tag wins."""
        tags = self.needed_tags()
        last = [F.max(F.when(F.col("tag") == t, F.struct("ordinal", F.col(value).cast("string").alias("v"))))["v"].alias(f"_{t}") for t in tags]
        rows = elements.groupBy(*keys).agg(*last) if last else elements.select(*keys).distinct()  # unfiltered: objects without any of the tags stay
        return rows.select(*keys, *(c.alias(n) for n, c in self.columns({t: F.col(f"_{t}") for t in tags})))

    def apply_objects(self, parsed: DataFrame) -> DataFrame:
        """One row per whole parsed object with a column per property, without a shuffle."""
        tags = self.needed_tags()
        rows = parsed.filter("error_message is null").select("instance_id", *(value_of(t, last=True, top=False).alias(f"_{t}") for t in tags))
        return rows.select("instance_id", *(c.alias(n) for n, c in self.columns({t: F.col(f"_{t}") for t in tags})))

    def nested(self, row: DataFrame, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
        """Dotted property columns folded into structs."""
        tree: dict = {}
        for c in row.columns:
            if c not in keys:
                at = tree
                *path, leaf = c.split(".")
                for x in path:
                    at = at.setdefault(x, {})
                at[leaf] = F.col(f"`{c}`")

        def fold(node: dict) -> list[Column]:
            return [(F.struct(*fold(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

        return row.select(*keys, *fold(tree))


def _dicom_token(token: str) -> str | None:
    name = token.removeprefix("dicom.")
    if name in KEYWORDS:
        return KEYWORDS[name]
    by_case = {k.lower(): t for k, t in KEYWORDS.items()}
    if name.lower() in by_case and token.startswith("dicom."):
        return by_case[name.lower()]
    if len(name) == 8 and name.upper() in TAGS:
        return name.upper()
    return None
