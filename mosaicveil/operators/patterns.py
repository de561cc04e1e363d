"""The rule table of identifier formats and the operator that turns a rule into spans.

A rule is one literal pattern, scanned once for its matches and once for the gaps between them; offsets are running sums of both,
so all rules of a row are one projection without a Python worker and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..types import SPAN, SPANS, Config

# The accepted formats. (?U) gives \w, \b and \s their Unicode meaning.
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_GAP = "[  ]+"
_DATE = rf"(?:\d{{1,2}}[/.-]\d{{1,2}}[/.-](?:\d{{4}}|\d{{2}})|\d{{1,2}}(?:st|nd|rd|th)?{_GAP}{_MONTH}\.?,?{_GAP}\d{{4}}|{_MONTH}\.?{_GAP}\d{{1,2}}(?:st|nd|rd|th)?,?{_GAP}\d{{4}})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_PHONE_LABEL = r"(?iU)\b(?:tel(?:ephone)?|fax|phone|ph|mob(?:ile)?)\.?\s*(?:no\.?\s*)?[:-]?\s*\+?$"
_DOB_CUES = ("dob", "d.o.b", "date of birth", "birth date", "born on", "born", "year of birth", "yob", "जन्म")
_ACCOUNT_CUES = ("account no", "account number", "a/c", "acct", "bank account", "account:")
_PHONE_CUES = ("tel", "phone", "mobile", "mob", "fax", "contact no", "ph.")


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    pattern: str
    score: float
    gate: str  # cheap test of the whole text; where it fails the pattern isn't run
    check: Callable[[Column, Config], Column] | None = None
    trim: Callable[[Column], Column] | None = None  # shortens a value, null drops it
    cues: tuple[str, ...] = ()
    window: int = 40
    tail: str = ""  # pattern of the value at the end of the match, if it isn't the whole
    anywhere_on_id: bool = False
    not_after: str = ""


RULES: tuple[Rule, ...] = (
    Rule("email", "EMAIL", r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", 0.97, "@"),
    Rule("url", "URL", r"(?i)(?<![\w@/])(?:https?://|www\.)[^\s<>\"']+", 0.60, r"(?i)://|www\.", trim=S.trim_url),
    Rule("gstin", "GSTIN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", 0.97, r"\d[A-Z]{5}\d"),
    Rule("pan", "PAN", r"\b[A-Z]{3}[ABCFGHLJPTK][A-Z]\d{4}[A-Z]\b", 0.95, r"[A-Z]{5}\d{4}"),
    Rule("cin", "CIN", r"\b[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b", 0.98, r"[LU]\d{5}"),
    Rule("llpin", "LLPIN", r"\b[A-Z]{3}-\d{4}\b", 0.90, r"(?i)llp", cues=("llpin", "llp identification")),
    Rule("din", "DIN", r"\bDIN\b\.?(?:\s*(?:No\.?|Number))?\s*[:\-–]?\s*\d{8}\b", 0.97, "DIN", tail=r"\d{8}$"),
    Rule("sebi_reg", "SEBI_REG", r"\b(?:IN[A-DF-Z]\d{9}|INBI\d{8})\b", 0.95, r"IN[A-Z]"),
    Rule("ifsc", "IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.90, r"[A-Z]{4}0"),
    Rule("passport", "PASSPORT", r"\b[A-Z][1-9]\d{6}\b", 0.85, "(?i)passport", cues=("passport",)),
    Rule("aadhaar", "AADHAAR", r"(?<![\d-])(?<!\d )[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}(?![\d-])(?! \d)", 0.95, r"\d{4}[ -]?\d{4}[ -]?\d{4}", check=lambda v, c: S.aadhaar_ok(v)),
    Rule("credit_card", "CREDIT_CARD", r"(?<![\d-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])", 0.93, r"\d{4}[ -]?\d{4}[ -]?\d{4}", check=lambda v, c: S.luhn_ok(v)),
    Rule("bank_account", "BANK_ACCOUNT", r"(?<![\w.,])\d{9,18}(?!\w|,\d)", 0.90, r"(?i)a/c|acct|account", cues=_ACCOUNT_CUES, window=30),
    Rule("ssn", "SSN", r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])", 0.90, r"\d-\d\d-\d"),
    Rule("ipv4", "IP_ADDRESS", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)", 0.90, r"\d\.\d", check=lambda v, c: S.ip_ok(v)),
    Rule("ipv6", "IP_ADDRESS", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", 0.90, "[0-9A-Fa-f]:[0-9A-Fa-f]", check=lambda v, c: S.ip_ok(v)),
    Rule("phone_intl", "PHONE", r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,8}\)?){1,5}(?![\w])", 0.85, r"\+\d", trim=S.trim_phone),
    Rule("phone_landline", "PHONE", r"(?<![\w.,/+])\(?0\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,5}(?![\w.,/])", 0.75, r"0\d{2}", check=lambda v, c: S.phone_digits_ok(v, 10, 12)),
    Rule("phone_mobile", "PHONE", r"(?<![\w.,/+])[6-9]\d{4}[ -]?\d{5}(?![\w.,/])", 0.80, r"[6-9]\d{4}"),
    Rule("phone_mobile_334", "PHONE", r"(?<![\w.,/+])[6-9]\d{2}[ -]\d{3}[ -]\d{4}(?![\w.,/])", 0.75, r"\d[ -]\d{3}[ -]\d{4}"),
    Rule("phone_tollfree", "PHONE", r"(?<!\w)1800[ -]?\d{3,4}[ -]?\d{3,4}(?!\w)", 0.80, "1800"),
    Rule("phone_ctx", "PHONE", r"(?<![\w.,])\(?\d{2,5}\)?(?:[ -]\d{2,8}){1,3}(?![\w.,])", 0.70, r"\d[) -]+\d\d", check=lambda v, c: S.phone_digits_ok(v, 8, 12), cues=_PHONE_CUES, window=25),
    Rule("dob", "DOB", rf"(?i)(?<![\w/.-]){_DATE}(?![\w/-])", 0.90, r"\d", check=lambda v, c: S.dob_ok(v, c.as_of), cues=_DOB_CUES, window=45, anywhere_on_id=True, not_after=_PHONE_LABEL),
)
BY_NAME = {r.name: r for r in RULES}


def no_spans() -> Column:
    return F.array().cast(SPANS)


def located(text: Column, pattern: str) -> Column:
    """(start, text) of every match, starts counted in code points from 0: one fold over matches and the gaps before them."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("gap"))
    kind = "array<struct<start:int,text:string>>"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        more = F.concat(a["out"], F.array(F.struct(start.alias("start"), x["m"].alias("text")))).cast(kind)
        return F.when(x["m"].isNull(), a).otherwise(F.struct(more.alias("out"), (start + F.length(x["m"])).alias("at")))

    return F.aggregate(both, F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("at")), step, lambda a: a["out"])


def before(text: Column, start: Column, window: int) -> Column:
    """The window code points before start, or as many as there are."""
    return text.substr(F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)))


def pattern_spans(text: Column, rule: Rule, config: Config = Config(), id_context: Column | bool = False) -> Column:
    """Spans of one rule: match, then trim, then check, then context before the match."""
    on_id = F.lit(id_context) if isinstance(id_context, bool) else id_context

    def span(m: Column) -> Column:
        whole = m["text"]
        value = F.regexp_extract(whole, rule.tail, 0) if rule.tail else whole
        begin = m["start"] + F.length(whole) - F.length(value)
        value = rule.trim(value) if rule.trim else value
        return F.struct(m["start"].alias("match"), begin.alias("start"), value.alias("text"))

    def fits(s: Column) -> Column:
        ok = s["text"].isNotNull()
        if rule.not_after:
            ok &= ~before(text, s["start"], 20).rlike(rule.not_after)
        if rule.check:
            ok &= rule.check(s["text"], config)
        if rule.cues:
            near = F.lower(before(text, s["match"], rule.window))
            cue = F.lit(False)
            for word in rule.cues:
                cue |= F.contains(near, F.lit(word))
            ok &= (cue | on_id) if rule.anywhere_on_id else cue
        return ok

    made = F.transform(located(text, "(?U)" + rule.pattern), span)
    spans = F.transform(F.filter(made, fits), lambda s: F.struct(s["start"].cast("int").alias("start"), (s["start"] + F.length(s["text"])).cast("int").alias("end"), F.lit(rule.type).alias("type"), s["text"].alias("text"), F.lit(rule.score).alias("score"), F.lit(rule.name).alias("source")).cast(SPAN))
    return F.when(text.rlike(rule.gate), spans).otherwise(no_spans())


def all_pattern_spans(text: Column, config: Config = Config(), rules: tuple[Rule, ...] = RULES, id_context: Column | bool = False) -> Column:
    return F.concat(*(pattern_spans(text, r, config, id_context) for r in rules))
