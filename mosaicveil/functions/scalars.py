"""Text functions and checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tables of the Verhoeff check (dihedral group of ten, its permutations and inverses).
VERHOEFF_D = ["0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210"]
VERHOEFF_P = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]
VERHOEFF_INV = "0432156789"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _digit_at(table: list[str], row: Column, column: Column) -> Column:
    return F.substring(F.lit("".join(table)), 1, len(table) * 10).substr((row * 10 + column + 1).cast("int"), F.lit(1)).cast("int")


def _verhoeff_fold(c: Column, shift: int) -> Column:
    figures = F.filter(F.split(F.reverse(c), ""), lambda x: x != "")
    mapped = F.transform(figures, lambda x, i: _digit_at(VERHOEFF_P, (i + shift) % 8, x.cast("int")))
    return F.aggregate(mapped, F.lit(0), lambda a, x: _digit_at(VERHOEFF_D, a, x))


def verhoeff_ok(c: Column) -> Column:
    return _verhoeff_fold(digits(c), 0) == 0


def verhoeff_digit(c: Column) -> Column:
    return F.lit(VERHOEFF_INV).substr((_verhoeff_fold(digits(c), 1) + 1).cast("int"), F.lit(1))


def luhn_ok(c: Column) -> Column:
    d = digits(c)
    return F.length(d).between(13, 19) & F.expr("true") & F.call_function("luhn_check", d)


def luhn_digit(c: Column) -> Column:
    """Check figure that makes c followed by it pass."""
    figures = F.filter(F.split(F.reverse(digits(c)), ""), lambda x: x != "")
    total = F.aggregate(F.transform(figures, lambda x, i: F.when(i % 2 == 0, F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int"))), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def ip_ok(c: Column) -> Column:
    """A plausible address: every part in range without leading zeros; of IPv4 one part above 9."""
    parts = F.split(c, "[.]")
    four = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^(0|[1-9][0-9]{0,2})$") & (p.cast("int") <= 255)) & F.exists(parts, lambda p: p.cast("int") > 9)
    return F.when(F.instr(c, ":") > 0, c.rlike("^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")).otherwise(four)


def phone_digits_ok(c: Column, low: int, high: int) -> Column:
    return F.length(digits(c)).between(low, high)


def trim_phone(c: Column) -> Column:
    """Trailing groups go until 13 digits are left at most; null under 10 digits or if no group can go."""
    cut = F.aggregate(F.array(*(F.lit(k) for k in range(6))), c, lambda v, _: F.when(F.length(digits(v)) > 13, F.regexp_replace(v, "(?s)(?<=.)[ .-][^ .-]*$", "")).otherwise(v))
    return F.when(F.length(digits(cut)).between(10, 13), F.regexp_replace(cut, "[ .-]+$", ""))


def trim_url(c: Column) -> Column:
    v = F.regexp_replace(c, r"[.,;:)\]}'\"]+$", "")
    return F.when(F.length(v) > 6, v)


def aadhaar_ok(c: Column) -> Column:
    return (F.length(digits(c)) == 12) & (c.rlike(r"^\d{4}[ -]\d{4}[ -]\d{4}$") | verhoeff_ok(c))


def dob_ok(c: Column, as_of: str) -> Column:
    """A possible date of birth: month and day in range, a four-figure year from 1920 to as_of."""
    nums = F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), 1), lambda x: x.cast("int"))
    year = F.get(F.filter(nums, lambda n: n >= 100), 0)
    day = F.get(F.filter(nums, lambda n: n < 100), 0)
    first, second = F.get(nums, 0), F.get(nums, 1)
    numeric = first.between(1, 31) & second.between(1, 31) & (F.least(first, second) <= 12)
    return (year.isNull() | year.between(1920, int(as_of[:4]))) & F.when(c.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]"), numeric).otherwise(day.isNull() | day.between(1, 31))


def norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", ""))


def alnum_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def match_case(source: Column, made: Column) -> Column:
    letters = F.regexp_replace(source, r"[^\p{L}]", "")
    return F.when(letters == "", made).when((letters == F.upper(letters)) & (F.length(letters) > 1), F.upper(made)).when(letters == F.lower(letters), F.lower(made)).otherwise(made)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def host_of(c: Column) -> Column:
    """Host of an e-mail address or URL, without scheme, www, port and path; lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"^[a-z]+://", ""), r"^.*@", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^[^/?#:\s]*", 0), r"^www\.", "")


def eval_norm(value: Column, kind: Column) -> Column:
    """Type-aware normal form that evaluation compares."""
    return F.when(kind.isin("PERSON", "ORG", "ADDRESS", "DOB"), F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))).when(kind.isin("EMAIL", "URL"), F.lower(F.regexp_replace(value, "/+$", ""))).otherwise(alnum_key(value))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))
