"""De-identification by action codes, as a decision table over the columns of an element."""

from __future__ import annotations

from collections.abc import Callable
from collections.abc import Mapping as Map

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.dictionary import BYTE_VRS, DEFAULT_MASK, DEFAULT_MASK_VRS, tag_of
from lumenframe.functions.dicom import deterministic_uid
from lumenframe.schema import ELEMENT_NAMES

ACTIONS = frozenset("D Z X K C U Z/D X/Z X/D X/Z/D X/Z/U".split())
#: What a compound action does.
RESOLVED = {"Z/D": "D", "X/D": "D", "X/Z/D": "D", "X/Z": "Z", "X/Z/U": "U"}
_NUMBERS = ("FL", "FD", "SL", "SS", "SV", "UL", "US", "UV", "IS", "DS")
_CLEANED = ("LO", "LT", "SH", "ST", "UC", "UT", "UR", "AE", "CS")


STANDARD_ROOT = "1.2.840.10008."
_ODD = "13579BDF"


class Mask:
    """Actions by tag or keyword; a tag may have X for any digit. Values that are no action are literal replacements.

    private: what becomes of private elements that no key names, removed (X) unless they are kept (K).
    by_vr: actions of other elements that no key names; UIDs of the standard itself stay.
    """

    def __init__(self, actions: Map[str, str] | None = None, private: str = "X", by_vr: Map[str, str] | None = None):
        if private not in ("X", "K"):
            raise ValueError("private is X or K")
        self.private, self.by_vr = private, dict(by_vr or {})
        self.actions: dict[str, str] = {}
        for k, v in (actions or {}).items():
            self.actions[self._key(k)] = v

    @staticmethod
    def _key(name: str) -> str:
        bare = name.upper().replace("(", "").replace(")", "").replace(",", "")
        if len(bare) == 8 and "X" in bare and all(c in "0123456789ABCDEFX" for c in bare):
            return bare
        return tag_of(name)

    @classmethod
    def default(cls) -> Mask:
        return cls(DEFAULT_MASK, by_vr=DEFAULT_MASK_VRS)

    def _like(self, actions: Map[str, str], private: str | None = None) -> Mask:
        return Mask(actions, private or self.private, self.by_vr)

    def merge(self, other: Mask | Map[str, str]) -> Mask:
        """Both masks; of equal keys the other's wins. Private elements are kept only if both masks keep them."""
        both = other if isinstance(other, Mask) else Mask(other, self.private)
        merged = self._like({**self.actions, **both.actions}, "K" if self.private == both.private == "K" else "X")
        merged.by_vr |= both.by_vr
        return merged

    def without(self, *names: str) -> Mask:
        """The mask without these keys; what a rule by VR or a pattern would do to them, it does not."""
        gone = {self._key(n) for n in names}
        return self._like({k: v for k, v in self.actions.items() if k not in gone} | {k: "K" for k in gone if "X" not in k and (self.by_vr or any("X" in p for p in self.actions))})

    def keeping_private(self) -> Mask:
        return self._like(self.actions, "K")

    def column(self, tag: Column, vr: Column | None = None, value: Column | None = None) -> Column:
        """The action of a tag: exact keys first, then patterns, then private elements, then rules by VR; null without one."""
        out = F.lit(None).cast("string")
        if self.by_vr and vr is not None:
            own = F.coalesce(F.startswith(value, F.lit(STANDARD_ROOT)), F.lit(False)) if value is not None else F.lit(False)
            for kind, action in self.by_vr.items():
                out = F.when((vr == kind) & (~own if kind == "UI" else F.lit(True)), action).otherwise(out)
        if self.private == "X":
            out = F.when(F.substring(tag, 4, 1).isin(*_ODD), "X").otherwise(out)
        by_action: dict[str, list[str]] = {}
        for k, v in self.actions.items():
            if "X" in k:
                out = F.when(tag.rlike("^" + k.replace("X", "[0-9A-F]") + "$"), v).otherwise(out)
            else:
                by_action.setdefault(v, []).append(k)
        for v, keys in by_action.items():  # one hashed lookup an action
            out = F.when(tag.isin(*keys), v).otherwise(out)
        return out

    def hides(self, path: Column) -> Column:
        """Whether a path of sequences leads through one that is removed, emptied or replaced."""
        emptied = {t for t, a in self.actions.items() if a.rstrip("*").upper() in ACTIONS - {"K"}}
        exact, patterns = [t for t in emptied if "X" not in t], [t for t in emptied if "X" in t]
        kept = [t for t in self.actions if "X" not in t and t not in emptied]

        def gone(tag: Column) -> Column:
            out = tag.isin(*exact) if exact else F.lit(False)
            loose = F.substring(tag, 4, 1).isin(*_ODD) if self.private == "X" else F.lit(False)
            if patterns:
                loose = loose | tag.rlike("^(?:" + "|".join(t.replace("X", "[0-9A-F]") for t in sorted(patterns)) + ")$")
            return out | (loose & ~tag.isin(*kept) if kept else loose)

        return F.exists(F.coalesce(path, F.array().cast("array<struct<tag:string,item:int>>")), lambda p: gone(p["tag"]))


def resolved(action: Column) -> Column:
    """One of D Z X K C U, or null for a literal."""
    code = F.upper(F.regexp_replace(action, r"\*$", ""))
    out = F.when(code.isin("D", "Z", "X", "K", "C", "U"), code)
    for k, v in RESOLVED.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def dummy(tag: Column, vr: Column, value: Column, consistent_uids: bool = False) -> Column:
    uid = deterministic_uid(F.coalesce(value, F.lit("")) if consistent_uids else F.concat(tag, F.lit("|"), F.coalesce(value, F.lit(""))))
    return (
        F.when(vr == "DA", "19000101").when(vr == "DT", "19000101000000.000000").when(vr == "TM", "000000").when(vr.isin(*_NUMBERS), "0").when(vr == "UI", uid)
        .when(vr == "SQ", F.lit(None)).when(vr.isin(*BYTE_VRS, "AT"), "\x00").when(vr == "PN", "ANON^ANON").otherwise("[MASKED]")
    )


def masked_value(tag: Column, vr: Column, value: Column, action: Column, consistent_uids: bool = False, code: Column | None = None) -> Column:
    """The value of an element after its action; null if it is removed (see `removed`). code: the action as `resolved`, if it is at hand."""
    code = resolved(action) if code is None else code
    blank = F.when(vr == "SQ", F.lit(None)).otherwise(F.lit(""))
    clean = F.when(vr == "PN", "ANON^CLEAN").when(vr.isin(*_CLEANED), "[CLEANED]").otherwise(dummy(tag, vr, value, consistent_uids))
    uid = dummy(tag, F.lit("UI"), value, consistent_uids)
    return (
        F.when(action.isNull() | (code == "K"), value).when(code == "X", F.lit(None)).when(code == "Z", blank)
        .when(code == "D", dummy(tag, vr, value, consistent_uids)).when(code == "C", clean).when(code == "U", uid).otherwise(action)
    )


def _changed(action: Column, code: Column) -> Column:
    return action.isNotNull() & F.coalesce(code != "K", F.lit(True))


def _changes(get: Callable[[str], Column], code: Column, changed: Column, new: Column) -> dict[str, Column]:
    """New values of an element's columns; get gives the old ones."""
    vr = get("vr")
    number = vr.isin(*_NUMBERS) & changed
    return {
        "strs": F.when(changed, F.when(new.isNotNull(), F.array(new))).otherwise(get("strs")),
        "ints": F.when(changed, F.when(number & get("ints").isNotNull(), F.array(F.lit(0).cast("long")))).otherwise(get("ints")),
        "dbls": F.when(changed, F.when(number & get("dbls").isNotNull(), F.array(F.lit(0.0)))).otherwise(get("dbls")),
        "bin": F.when(changed & vr.isin(*BYTE_VRS), F.when(code == "Z", F.lit(b"")).otherwise(F.lit(b"\x00"))).when(changed, F.lit(None)).otherwise(get("bin")),
        "is_bulk": get("is_bulk") & ~changed,
        "bulk_offset": F.when(~changed, get("bulk_offset")),
        "bulk_uri": F.when(~changed, get("bulk_uri")),
        "str": F.when(changed, new).otherwise(get("str")),
    }


def _stays(code: Column) -> Column:
    return F.coalesce(code != "X", F.lit(True))


def deidentify(elements: DataFrame, mask: Mask | None = None, consistent_uids: bool = False) -> DataFrame:
    """Element rows after the mask. File meta stays; elements inside a removed, emptied or replaced sequence go with it; bulk values are masked like others."""
    mask = mask or Mask.default()
    vr, value = (F.col(c) if c in elements.columns else None for c in ("vr", "str"))
    df = elements.withColumn("_action", F.when(~F.col("is_meta"), mask.column(F.col("tag"), vr, value)))
    code = resolved(F.col("_action"))
    df = df.filter(_stays(code) & ~mask.hides(F.col("path")))
    new = masked_value(F.col("tag"), F.col("vr"), F.col("str"), F.col("_action"), consistent_uids)
    out = _changes(F.col, code, _changed(F.col("_action"), code), new)
    return df.select(*(out[c].alias(c) if c in out else F.col(c) for c in elements.columns))


def deidentify_objects(parsed: DataFrame, mask: Mask | None = None, consistent_uids: bool = False) -> DataFrame:
    """Whole parsed objects after the mask, each in its own row."""
    mask = mask or Mask.default()
    # an action, its code and the new value are worked out once an element, each in a pass of its own over the array
    acted = F.transform("elements", lambda e: F.struct(e.alias("e"), F.when(~e["is_meta"], mask.column(e["tag"], e["vr"], e["str"])).alias("action")))
    coded = F.transform(acted, lambda j: F.struct(j["e"].alias("e"), j["action"].alias("action"), F.when(j["action"].isNotNull(), resolved(j["action"])).alias("code")))
    kept = F.filter(coded, lambda j: _stays(j["code"]) & ~((F.size(j["e"]["path"]) > 0) & mask.hides(j["e"]["path"])))

    def valued(j: Column) -> Column:
        changed = _changed(j["action"], j["code"])
        new = masked_value(j["e"]["tag"], j["e"]["vr"], j["e"]["str"], j["action"], consistent_uids, j["code"])
        return F.struct(j["e"].alias("e"), j["code"].alias("code"), changed.alias("changed"), F.when(changed, new).alias("new"))

    def changed(j: Column) -> Column:
        new = _changes(lambda c: j["e"][c], j["code"], j["changed"], j["new"])
        return F.when(j["changed"], F.struct(*((new[c] if c in new else j["e"][c]).alias(c) for c in ELEMENT_NAMES))).otherwise(j["e"])

    return parsed.withColumn("elements", F.transform(F.transform(kept, valued), changed))
