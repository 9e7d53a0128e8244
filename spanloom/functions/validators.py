"""Checksums and plausibility, as column expressions and as functions of one value."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """Luhn's check over the digits; fewer than 12 are never valid."""
    d = digits(value)
    return (F.length(d) >= 12) & F.call_function("luhn_check", d)


def iban_valid(value: Column) -> Column:
    """Shape and remainder by 97 of the value without spaces, in upper case."""
    v = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    turned = F.split(F.concat(F.substr(v, F.lit(5), F.length(v)), F.substr(v, F.lit(1), F.lit(4))), "")

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).when(c == "", acc).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    shaped = v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    return F.when(shaped, F.aggregate(turned, F.lit(0), step) == 1).otherwise(False)


def plausible_date(value: Column) -> Column:
    """False for numeric dates that no calendar has; other shapes pass."""
    numeric = r"^(\d{1,2})[./](\d{1,2})[./]\d{2,4}$"
    a = F.regexp_extract(value, numeric, 1).try_cast("int")
    b = F.regexp_extract(value, numeric, 2).try_cast("int")
    either = (a.between(1, 31) & b.between(1, 12)) | (a.between(1, 12) & b.between(1, 31))
    return F.when(value.rlike(numeric), either).otherwise(True)


def plausible_phone(value: Column) -> Column:
    """7 to 15 digits; no range of years, no year in parentheses, no ISBN-13."""
    d = F.regexp_replace(value, r"(?U)\D", "")
    n = F.length(d)
    isbn = (n == 13) & d.rlike("^97[89]")
    years = F.trim(value).rlike(r"(?U)^(?:19|20)\d{2}\s*[-–]\s*(?:19|20)\d{2}$")
    return n.between(7, 15) & ~years & ~value.rlike(r"(?U)\((?:19|20)\d{2}") & ~isbn


# The same checks on one value, for the detectors' Arrow pass.

_IBAN_SHAPE = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_NUMERIC_DATE = re.compile(r"([0-9]{1,2})[./]([0-9]{1,2})[./][0-9]{2,4}")
_YEARS = re.compile(r"(?:19|20)\d{2}\s*[-–]\s*(?:19|20)\d{2}")
_YEAR_IN_PARENTHESES = re.compile(r"\((?:19|20)\d{2}")


def luhn_ok(value: str) -> bool:
    ds = [int(c) for c in value if c in "0123456789"]
    return len(ds) >= 12 and (sum(ds[-1::-2]) + sum(d // 5 + 2 * d % 10 for d in ds[-2::-2])) % 10 == 0


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return _IBAN_SHAPE.fullmatch(v) is not None and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def date_ok(value: str) -> bool:
    numeric = _NUMERIC_DATE.fullmatch(value)
    if not numeric:
        return True
    low, high = sorted(map(int, numeric.groups()))
    return 1 <= low <= 12 and 1 <= high <= 31


def phone_ok(value: str) -> bool:
    ds = [c for c in value if c.isdecimal()]
    if not 7 <= len(ds) <= 15 or _YEARS.fullmatch(value.strip()) or _YEAR_IN_PARENTHESES.search(value):
        return False
    return len(ds) != 13 or "".join(ds[:3]) not in ("978", "979")
