"""Pseudonyms: keyed, deterministic, of the original's format. All are Column expressions over HMAC-SHA256."""

from __future__ import annotations

import hashlib
import hmac
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import VOCABULARY, Vocabulary
from . import scalars as S


def _pads(salt: str) -> tuple[str, str]:
    key = salt.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_hex(c: Column, salt: str) -> Column:
    """HMAC-SHA256 of a string under the salt, in hex; the key's pads are literals."""
    inner, outer = _pads(salt)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), c.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def number(seed: Column, at: int, below: Column | int) -> Column:
    """A number from 0 to below - 1, of the seed's at-th stretch of eight hex figures (a hash of the seed from the ninth on)."""
    part = seed.substr(8 * at + 1, 8) if at < 8 else F.sha2(F.concat(seed, F.lit(f":{at}")), 256).substr(1, 8)
    return F.conv(part, 16, 10).cast("long") % below


def pick(seed: Column, at: int, pool: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (number(seed, at, len(pool)) + 1).cast("int"))


def figures(seed: Column, at: int, n: int) -> Column:
    return F.concat(*(number(seed, at + k, 10).cast("string") for k in range(n)))


def letters(seed: Column, at: int, n: int) -> Column:
    return F.concat(*(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ").substr((number(seed, at + k, 26) + 1).cast("int"), F.lit(1)) for k in range(n)))


def key_seed(kind: str | Column, key: Column, salt: str) -> Column:
    return hmac_hex(F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("|0|"), key), salt)


def fake_key(kind: str, key: Column, salt: str, seed: Column | None = None, pan_seed: Column | None = None) -> Column:
    """The pseudonym of an identifier's bare letters and figures. seed, pan_seed: columns that hold them already."""
    seed = key_seed(kind, key, salt) if seed is None else seed
    nine = lambda at: (number(seed, at, 9) + 1).cast("string")
    other = lambda at, c: ((F.coalesce(c.cast("int"), F.lit(0)) + number(seed, at, 8)) % 9 + 1).cast("string")  # noqa: E731 - 1 to 9, not c
    some = lambda at, n: F.substring(figures(seed, at, 20), 1, 20).substr(F.lit(1), F.greatest(n, F.lit(0)).cast("int"))
    size = F.length(key)
    generic = F.array_join(
        F.transform(F.split(key, "(?!^)"), lambda c, i: F.when(c.rlike("[0-9]"), (F.conv(F.substring(F.sha2(F.concat(seed, i.cast("string")), 256), 1, 6), 16, 10).cast("long") % 10).cast("string")).otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ").substr((F.conv(F.substring(F.sha2(F.concat(seed, i.cast("string")), 256), 1, 6), 16, 10).cast("long") % 26 + 1).cast("int"), F.lit(1)))),
        "",
    )
    zeros = F.length(F.regexp_extract(key, "^0*(?=[0-9])", 0))
    if kind == "PAN":
        return F.when(size == 10, F.concat(letters(seed, 0, 3), key.substr(4, 1), letters(seed, 3, 1), figures(seed, 4, 4), letters(seed, 8, 1))).otherwise(generic)
    if kind == "AADHAAR":
        body = F.concat((number(seed, 0, 8) + 2).cast("string"), figures(seed, 1, 10))
        return F.when(size == 12, F.concat(body, S.verhoeff_digit(body))).otherwise(generic)
    if kind == "CIN":
        made = F.concat(key.substr(1, 1), figures(seed, 0, 5), pick(seed, 5, ("MH", "KA", "GJ", "DL", "TN", "WB", "UP", "RJ")), (number(seed, 6, 73) + 1950).cast("string"), key.substr(13, 3), figures(seed, 7, 6))
        return F.when(size == 21, made).otherwise(generic)
    if kind == "GSTIN":
        made = F.concat(F.lpad((number(seed, 0, 37) + 1).cast("string"), 2, "0"), fake_key("PAN", key.substr(3, 10), salt, pan_seed), key.substr(13, 1), F.lit("Z"), letters(seed, 1, 1))
        return F.when(size == 15, made).otherwise(generic)
    if kind == "SEBI_REG":
        head = F.regexp_extract(key, "^[A-Z]*(?:0*(?=[0-9]))?", 0)
        at = F.length(head) + 1
        return F.concat(head, F.when(size >= at, other(0, key.substr(at, F.lit(1)))).otherwise(""), some(1, size - at))
    if kind == "DIN":
        return F.concat(key.substr(F.lit(1), zeros), other(0, key.substr(zeros + 1, F.lit(1))), some(1, size - zeros - 1))
    if kind == "IFSC":
        return F.when(size == 11, F.concat(letters(seed, 0, 4), F.lit("0"), figures(seed, 4, 6))).otherwise(generic)
    if kind == "CREDIT_CARD":
        body = F.concat(key.substr(1, 1), some(0, size - 2))
        return F.concat(body, S.luhn_digit(body))
    if kind == "SSN":
        return F.when(size == 9, F.concat(F.lit("9"), figures(seed, 0, 8))).otherwise(generic)
    if kind == "PASSPORT":
        return F.when(size == 8, F.concat(letters(seed, 0, 1), nine(1), figures(seed, 2, 6))).otherwise(generic)
    if kind == "PHONE":
        head = F.when(key.startswith("1800"), 4).otherwise(F.greatest(size - 10, F.lit(0)))
        body = key.substr((head + 1).cast("int"), size)
        first = F.when(body.rlike("^[6-9]") & (F.length(body) == 10), (number(seed, 0, 4) + 6).cast("string")).otherwise(body.substr(1, 1))
        return F.concat(key.substr(F.lit(1), head.cast("int")), first, some(1, F.length(body) - 1))
    if kind == "BANK_ACCOUNT":
        return F.concat(other(0, key.substr(1, 1)), some(1, size - 1))
    return generic


def put_back(surface: Column, made: Column, of: str = r"[\p{L}\p{N}]") -> Column:
    """The surface with its letters and figures, one by one, taken from made; separators and case stay."""
    chars = F.split(surface, "(?!^)")
    step = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.struct(
            F.concat(a["out"], F.when(c.rlike(of), F.when(c.rlike("[a-z]"), F.lower(made.substr(a["at"], F.lit(1)))).otherwise(made.substr(a["at"], F.lit(1)))).otherwise(c)).alias("out"),
            (a["at"] + F.when(c.rlike(of), 1).otherwise(0)).alias("at"),
        ),
    )
    return step["out"]


def fake_identifier(kind: str, surface: Column, salt: str) -> Column:
    return put_back(surface, fake_key(kind, S.alnum_key(surface), salt))


def fake_ip(surface: Column, salt: str) -> Column:
    seed = hmac_hex(F.concat(F.lit("IP|"), surface), salt)
    four = F.concat(pick(seed, 0, ("192.0.2.", "198.51.100.", "203.0.113.")), (number(seed, 1, 254) + 1).cast("string"))
    six = F.concat(F.lit("2001:db8::"), *(F.concat(F.lit(":" if k else ""), F.lower(F.hex(number(seed, 2 + k, 65536)))) for k in range(3)))
    return F.when(F.contains(surface, F.lit(":")), six).otherwise(four)


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def date_shift(surface: Column, salt: str) -> Column:
    """Days to move a date by: 60 to 900 either way, by its normal form."""
    seed = hmac_hex(F.concat(F.lit("DATE|"), S.norm(surface)), salt)
    return ((number(seed, 0, 841) + 60) * F.when(number(seed, 1, 2) == 0, 1).otherwise(-1)).cast("int")


def fake_date(surface: Column, salt: str) -> Column:
    """A moved date in the layout, separators, padding, ordinal and case of the original; impossible dates lose their figures."""
    days = date_shift(surface, salt)
    # fixed values: the layouts of dates
    num = r"^(\d{1,2})([/.-])(\d{1,2})[/.-](\d{4}|\d{2})$"
    one = lambda p, k: F.regexp_extract(surface, p, k)
    y = one(num, 4)
    year = F.when(F.length(y) == 4, y.cast("int")).when(y.cast("int") > 30, y.cast("int") + 1900).otherwise(y.cast("int") + 2000)
    moved = lambda year, month, day: F.date_add(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day)), days)
    a = moved(year, one(num, 3).cast("int"), one(num, 1).cast("int"))
    padded = lambda v, like: F.when(F.length(like) == 2, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
    numeric = F.concat(padded(F.dayofmonth(a), one(num, 1)), one(num, 2), padded(F.month(a), one(num, 3)), one(num, 2), F.when(F.length(y) == 4, F.year(a).cast("string")).otherwise(F.lpad((F.year(a) % 100).cast("string"), 2, "0")))
    made = F.when(surface.rlike(num), numeric)
    for pattern, d, o, s1, m, s2, y_ in ((r"^(\d{1,2})(st|nd|rd|th)?(\s+)([A-Za-z]+)(\.?,?\s+)(\d{4})$", 1, 2, 3, 4, 5, 6), (r"^([A-Za-z]+)(\.?\s+)(\d{1,2})(st|nd|rd|th)?(,?\s+)(\d{4})$", 3, 4, 2, 1, 5, 6)):
        name = one(pattern, m)
        month = F.array_position(F.array(*(F.lit(x[:3].lower()) for x in _MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")
        b = moved(one(pattern, y_).cast("int"), month, one(pattern, d).cast("int"))
        full = F.element_at(F.array(*map(F.lit, _MONTHS)), F.month(b))
        word = S.match_case(name, F.when((F.length(name) <= 4) & ~F.lower(name).isin("june", "july"), F.substring(full, 1, 3)).otherwise(full))
        day = F.dayofmonth(b)
        nth = F.when(one(pattern, o) == "", "").when(day.between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
        parts = (day.cast("string"), nth, one(pattern, s1), word, one(pattern, s2)) if d == 1 else (word, one(pattern, s1), day.cast("string"), nth, one(pattern, s2))
        made = F.coalesce(made, F.when(surface.rlike(pattern), F.concat(*parts, F.year(b).cast("string"))))
    return F.coalesce(made, put_back(surface, fake_key("DOB", S.alnum_key(surface), salt)))


def fake_address(surface: Column, salt: str, v: Vocabulary = VOCABULARY) -> Column:
    seed = hmac_hex(F.concat(F.lit("ADDR|"), S.norm(surface)), salt)
    parts = F.least(F.lit(6), F.greatest(F.lit(2), F.length(F.regexp_replace(surface, "[^,]", "")) + 1))
    either = lambda words: "|".join(map(re.escape, sorted(words)))
    # a house's number is no PIN code, see names._of_house; Java's lookbehind wants bounds and is costly, so the figures are tested first
    no = rf"(?<!\b(?:{either(v.pin_words)})[\s.:–-]{{1,3}})\b(?:{either(v.number_words)})"
    six = r"[1-9]\d{2}\s?\d{3}(?!\d)"
    pin = F.regexp_extract(surface, rf"(?i)(?<!\d)(?={six})(?<!(?:#|\b(?:{either(v.house_words)})|{no})[\s.:–-]{{0,3}}){six}", 0)
    code = F.concat(F.lit("9"), figures(seed, 4, 2), F.when(F.length(pin) == 7, " ").otherwise(""), figures(seed, 8, 3))
    city = F.concat(pick(seed, 3, v.fake_cities), F.when(pin != "", F.concat(F.lit(" "), code)).otherwise(""))
    lead = F.slice(F.array(F.concat(F.lit("Plot No. "), (number(seed, 0, 250) + 1).cast("string")), pick(seed, 1, v.fake_buildings), pick(seed, 2, v.fake_streets), F.lit("Greenfield Park")), F.lit(1), (F.least(parts, F.lit(5)) - 1).cast("int"))
    made = F.array_join(F.concat(lead, F.array(city), F.when(surface.rlike(r"(?i)\bindia\b"), F.array(F.lit("India"))).otherwise(F.array().cast("array<string>"))), ", ")
    return S.match_case(surface, made)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def keyed_number(salt: str, what: str) -> int:
    return int.from_bytes(hmac.new(salt.encode(), what.encode(), hashlib.sha256).digest()[:8], "big")


def permuted(salt: str) -> str:
    """What A to Z become: each letter the next one of an order that the salt fixes, so none stays."""
    order = sorted(LETTERS, key=lambda x: keyed_number(salt, f"LETTER|{x}"))
    after = dict(zip(order, order[1:] + order[:1]))
    return "".join(after[x] for x in LETTERS)


def fake_initial(c: Column, salt: str) -> Column:
    """Capital letters through one permutation of the alphabet, fixed by the salt."""
    return F.translate(c, LETTERS, permuted(salt))
