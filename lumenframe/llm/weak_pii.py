"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.
Looser candidates (secrets, national ids, bank accounts, phone numbers without a
country code) are voted on by three labelers: a strict pattern, a gazetteer and
the words before the span. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is for each kind; the posteriors
train a logistic span classifier over discrete span features, which is compiled
into a column expression and decides about the candidates.

Defined cases: null and empty texts have no spans; a candidate that overlaps a
base span is dropped; without any candidate the
classifier accepts nothing. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.scans import let, pieces_of, running_max, running_sum

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "ssn", "iban", "local_phone")
KINDS = BASE_KINDS + EXTRA_KINDS

# Possessive forms of the base patterns: what follows a greedy part is never in
# its class, so the matches are the same and long runs take linear time. A match
# starts at the start of its run or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"  # shorter runs fail at each of their digits, so nothing but their matches is left out
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"\b(?:[Pp]ass(?:word|wd|phrase)|PASSWORD|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey)\x20{0,2}+[=:]\x20{0,2}+\"?[A-Za-z0-9_/+-]{8,}+\"?|\bAKIA[0-9A-Z]{16}\b"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+\b"
LOCAL = r"(?<![0-9+)(-])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])|(?<![0-9+-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9.-])"
EXTRA = f"(?:{SECRET})|(?:{SSN})|(?:{IBAN})|(?:{LOCAL})"

#: Gazetteers: names that stand before secrets, country codes of accounts, area codes.
SECRET_NAMES = r"(?i)^(?:pass|token|secret|api|access)|^AKIA"
IBAN_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CUES = {
    "secret": r"(?i)(?:pass|token|secret|key|login|credential|export|auth)",
    "ssn": r"(?i)(?:ssn|social|security|insurance|tax)",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta|bank)",
    "local_phone": r"(?i)(?:call|tel|phone|fax|mobile|contact|ring|appel|llam|ruf)",
}
CONTEXT_CHARS = 24
#: No offset of a text.
_FAR = -(1 << 31) + 1
MAX_FEATURES = 4


_FOUND = "array<struct<start:int,end:int,found:string,before:string>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found,before>> of all matches, left to right, from the pieces between them; before: the CONTEXT_CHARS before the match."""
    tail = lambda x: F.substring(x, F.lit(-CONTEXT_CHARS), F.lit(CONTEXT_CHARS))

    def placed(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x["pieces"], 1, F.size(x["found"])), x["found"], lambda p, m: F.struct(p.alias("p"), m.alias("m")))

        def spans(pairs: Column) -> Column:
            ends = running_sum(F.transform(pairs, lambda v: F.length(v["p"]) + F.length(v["m"])))

            def one(v: Column, i: Column) -> Column:
                context = tail(F.concat(F.when(i > 0, tail(F.get(x["found"], i - 1))).otherwise(F.lit("")), v["p"]))
                return F.struct((v["end"] - F.length(v["m"])).alias("start"), v["end"].alias("end"), v["m"].alias("found"), context.alias("before"))

            both = F.zip_with(pairs, F.slice(ends, 2, F.size(pairs)), lambda v, e: F.struct(v["p"].alias("p"), v["m"].alias("m"), e.alias("end")))
            return F.transform(both, one)

        return let(pairs, spans)

    def some(found: Column) -> Column:
        none = F.array().cast(_FOUND)
        return F.when(F.size(found) > 0, let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("pieces")), placed)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 12 to 19 digits has a right check digit."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0


def _part_ok(p: Column) -> Column:
    short = F.ltrim(p, F.lit("0"))
    return (F.length(short) <= 3) & (F.coalesce(F.when(F.length(short).between(1, 3), short).cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> of the base kinds, by start, then kind."""
    none = F.array().cast(_FOUND)
    digits = text.rlike("[0-9]")

    def of(kind: str, when: Column, pattern: str, keep) -> Column:
        k = KINDS.index(kind)
        found = F.filter(F.when(when, located(text, pattern)).otherwise(none), keep)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    def card_ok(s: Column) -> Column:
        d = _digits(s["found"])
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))

    return F.array_sort(
        F.concat(
            of("email", F.contains(text, F.lit("@")), EMAIL, lambda s: F.lit(True)),
            of("ip", digits, IP, lambda s: F.forall(F.split(s["found"], r"\."), _part_ok)),
            of("card", digits, CARD, card_ok),
            of("phone", F.contains(text, F.lit("+")), PHONE, lambda s: F.length(_digits(s["found"])).between(9, 15)),
        )
    )


def _kind(found: Column) -> Column:
    return (
        F.when(found.rlike(f"^(?:{SECRET})$"), "secret")
        .when(found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(found.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .otherwise("local_phone")
    )


def candidates(text: Column) -> Column:
    """array<struct<start,kind,end,strict,listed,cue,long>>: the labelers' votes (1 for, 0 against, null: abstains)."""
    none = F.array().cast(_FOUND)
    found = F.when(text.rlike(r"[0-9=:]"), located(text, EXTRA)).otherwise(none)

    def votes(s: Column) -> Column:
        t, kind = s["found"], _kind(s["found"])
        value = F.regexp_replace(t, "^[A-Za-z_-]+\\x20*[=:]\\x20*|\"", "")
        strict = (
            F.when(kind == "secret", value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 12))
            .when(kind == "ssn", ~t.rlike("^(?:000|666|9)") & ~t.rlike("-00-") & ~t.rlike("0000$"))
            .when(kind == "iban", F.length(F.regexp_replace(t, " ", "")).between(15, 34))
            .otherwise(~_digits(t).rlike("^[01]"))
        )
        listed = (
            F.when(kind == "secret", t.rlike(SECRET_NAMES))
            .when(kind == "iban", F.substring(t, 1, 2).isin(*IBAN_COUNTRIES))
            .when(kind == "local_phone", _digits(t).rlike("^[2-9][0-8][0-9]"))
        )
        words = F.when(kind == "secret", F.concat(s["before"], F.substring(t, 1, 12))).otherwise(s["before"])
        cue = F.lit(False)
        for k, p in CUES.items():
            cue = F.when(kind == k, words.rlike(p)).otherwise(cue)
        number = F.lit(0)
        for i, k in enumerate(KINDS):
            number = F.when(kind == k, i).otherwise(number)
        vote = lambda c: c.cast("int")
        return F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end"), vote(strict).alias("strict"), vote(listed).alias("listed"), F.when(cue, 1).cast("int").alias("cue"), F.least(F.floor(F.length(t) / 8), F.lit(MAX_FEATURES)).cast("int").alias("long"))

    return F.transform(found, votes)


@dataclass
class SpanModel:
    """What the labelers are worth and the span classifier's weights, by feature name."""

    reliability: dict[tuple[int, str], tuple[float, float]] = field(default_factory=dict)
    bias: float = -9.0
    weights: dict[tuple[str, int], float] = field(default_factory=dict)

    def accept(self, s: Column) -> Column:
        total = F.lit(float(self.bias))
        for (name, value), w in self.weights.items():
            total = total + F.when(F.coalesce(s[name], F.lit(-1)) == value, F.lit(float(w))).otherwise(F.lit(0.0))
        return total >= 0


LABELERS = ("strict", "listed", "cue")
FEATURES = ("kind", *LABELERS, "long")


def em(patterns: list[tuple[int, tuple[int, int, int], float]], rounds: int = 50) -> tuple[dict, dict]:
    """Posterior of each (kind, votes) and (true, false) positive rate of each (kind, labeler). Votes: 1, 0 or -1 for abstention."""
    post = {(k, v): min(0.95, max(0.05, 0.35 + 0.25 * sum((x == 1) - (x == 0) for x in v))) for k, v, _ in patterns}
    rates: dict = {}
    for _ in range(rounds):
        for k in {k for k, _, _ in patterns}:
            own = [(v, n) for kk, v, n in patterns if kk == k]
            yes = sum(n * post[k, v] for v, n in own)
            no = sum(n * (1 - post[k, v]) for v, n in own)
            prior = (yes + 1) / (yes + no + 2)
            table = []
            for i, name in enumerate(LABELERS):
                p = {x: (sum(n * post[k, v] for v, n in own if v[i] == x) + (2 if x == 1 else 0.5)) / (yes + 3) for x in (1, 0, -1)}
                q = {x: (sum(n * (1 - post[k, v]) for v, n in own if v[i] == x) + (0.5 if x == 1 else 2)) / (no + 4.5) for x in (1, 0, -1)}
                rates[k, name] = (p[1], q[1])
                table.append((p, q))
            for v, _ in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(p[x] / q[x]) for x, (p, q) in zip(v, table, strict=True))
                post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


def fit(spans: DataFrame) -> SpanModel:
    """spans: rows of candidates() exploded. Only counts of feature combinations come to the driver: 4 x 3 x 3 x 2 x 5 at most."""
    rows = spans.groupBy(*FEATURES).count().collect()
    if not rows:
        return SpanModel()
    votes = lambda r: tuple(-1 if r[x] is None else r[x] for x in LABELERS)
    totals: dict = {}
    for r in rows:
        totals[r["kind"], votes(r)] = totals.get((r["kind"], votes(r)), 0) + r["count"]
    post, rates = em([(k, v, float(n)) for (k, v), n in sorted(totals.items())])
    names = sorted({(f, -1 if r[f] is None else r[f]) for r in rows for f in FEATURES})
    at = {x: i for i, x in enumerate(names)}
    data = [([at[f, -1 if r[f] is None else r[f]] for f in FEATURES], post[r["kind"], votes(r)], float(r["count"])) for r in sorted(rows, key=lambda r: str(tuple(r)))]
    whole = sum(n for _, _, n in data)
    w, b = [0.0] * len(names), 0.0
    for _ in range(400):  # ridge logistic regression on the soft labels, over combinations weighted by count
        gw, gb = [0.001 * x for x in w], 0.0
        for ids, y, n in data:
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(w[i] for i in ids))))) - y) * n / whole
            gb += d
            for i in ids:
                gw[i] += d
        b -= gb
        w = [x - g for x, g in zip(w, gw, strict=True)]
    return SpanModel(rates, b, {x: round(w[i], 6) for x, i in at.items()})


def chosen(base: Column, extra: Column, model: SpanModel) -> Column:
    """All spans as array<struct<start,kind,end>>: the base ones and accepted candidates that overlap no base span.

    Base spans are sorted by start, so a candidate overlaps one if the largest
    end before it is beyond its start or the next base span starts before its end.
    """
    mark = lambda s, own: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["kind"].alias("kind"), s["end"].alias("end"))

    def fitted(good: Column) -> Column:
        both = F.array_sort(F.concat(F.transform(base, lambda s: mark(s, 0)), F.transform(good, lambda s: mark(s, 1))))

        def clear(all_: Column) -> Column:
            reach = running_max(F.transform(all_, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(F.lit(-1))))
            # starts of base spans to come, as maxima of their negatives from the end
            ahead = F.reverse(running_max(F.transform(F.reverse(all_), lambda s: F.when(s["own"] == 0, -s["start"]).otherwise(F.lit(_FAR))), _FAR))
            judged = F.zip_with(all_, F.arrays_zip(reach.alias("reach"), ahead.alias("ahead")), lambda s, r: F.struct(s.alias("s"), r["reach"].alias("reach"), r["ahead"].alias("ahead")))
            stay = F.filter(F.slice(judged, 1, F.size(all_)), lambda j: (j["s"]["own"] == 0) | ((j["reach"] <= j["s"]["start"]) & (-j["ahead"] >= j["s"]["end"])))
            return F.array_sort(F.transform(stay, lambda j: F.struct(j["s"]["start"].alias("start"), j["s"]["kind"].alias("kind"), j["s"]["end"].alias("end"))))

        return F.when(F.size(good) > 0, let(both, clear)).otherwise(base)

    return let(F.filter(extra, lambda s: model.accept(s)), fitted)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; what spans overlap is replaced once, by the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut(sorted_: Column) -> Column:
        def gaps(reach: Column) -> Column:
            first = F.filter(F.zip_with(sorted_, F.slice(reach, 1, F.size(sorted_)), lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda x: x["start"] >= x["at"])
            starts = lambda f: F.concat(F.transform(f, lambda x: x["at"]), F.array(F.element_at(reach, -1)))
            ends = lambda f: F.concat(F.transform(f, lambda x: x["start"]), F.array(F.length(text)))
            tags = lambda f: F.concat(F.transform(f, lambda x: F.element_at(names, x["kind"] + 1)), F.array(F.lit("")))
            return let(first, lambda f: F.array_join(F.zip_with(pieces_of(text, starts(f), ends(f)), tags(f), lambda p, t: F.concat(p, t)), ""))

        return let(running_max(F.transform(sorted_, lambda s: s["end"]), 0), gaps)

    return F.when(F.size(spans) > 0, let(spans, cut)).otherwise(text)


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with personal data in text replaced; null texts stay null, and columns of any name stay as they are."""
    held: list[str] = []
    for name in ("_base", "_extra", "_spans"):
        while name in docs.columns:
            name += "_"
        held.append(name)
    base, extra, spans = held
    t = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn(base, base_spans(t)).withColumn(extra, candidates(t)).withColumn(spans, chosen(F.col(base), F.col(extra), model))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col(spans)))).select(*docs.columns)


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, base, extra: the base spans and the candidates of docs(doc_id, text)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_spans(t).alias("base"), candidates(t).alias("extra"))


def fit_on(docs: DataFrame) -> SpanModel:
    """The span model of all candidates of docs(text)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return fit(docs.select(F.explode(candidates(t)).alias("s")).select("s.*"))
