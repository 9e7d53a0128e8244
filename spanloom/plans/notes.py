"""Derived labelled notes: a text around one value for each row of `customer`, by SQL that Spark and DuckDB read alike.

The gold span of a note is where its value was put, so the oracle of a detector is the construction itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spanloom.sources.tables import table
from spanloom.operators.detect import detect
from spanloom.operators.recognizers import Recognizer

K = "c_custkey"


def digits(n: str, width: int) -> str:
    """n's last digits, padded with zeros."""
    return f"lpad(cast(({n}) % {10**width} as string), {width}, '0')"


def number(n: str) -> str:
    return f"cast({n} as string)"


def nth(k: int, width: int = 5) -> str:
    """The k-th digit from the left of the key padded to `width`."""
    return f"cast(substr({digits(K, width)}, {k}, 1) as int)"


def doubled(d: str) -> str:
    return f"(case when {d} > 4 then 2 * {d} - 9 else 2 * {d} end)"


# 4000 0000 00 and five digits of the key: the first and every other digit of the number count double.
LUHN = f"(8 + {doubled(nth(1))} + {nth(2)} + {doubled(nth(3))} + {nth(4)} + {doubled(nth(5))})"
CHECK = f"((10 - ({LUHN} % 10)) % 10)"
CARD = f"'4000000000' || {digits(K, 5)}"
ACCOUNT = f"'00000000' || {digits(K, 6)}"
# W E S T = 32 14 28 29, G B = 16 11.
IBAN_REST = f"(98 - cast(cast('32142829' || {ACCOUNT} || '161100' as decimal(38, 0)) % 97 as int))"


def letter(n: str) -> str:
    return f"chr(cast(65 + ({n}) % 26 as int))"


STOPPED = "'U.S.', 'U.K.', 'U.N.', 'E.U.', 'A.M.', 'P.M.', 'B.C.', 'A.D.', 'I.E.', 'E.G.', 'N.B.', 'P.S.', 'D.C.'"
INITIALS = f"{letter(K)} || '.' || {letter(f'({K} - {K} % 26) / 26')} || '.'"


@dataclass(frozen=True)
class Note:
    detector: str
    entity_type: str
    confidence: float
    before: str
    value: str
    after: str
    where: str = "true"

    def text(self) -> str:
        return f"'{self.before}' || {self.value} || '{self.after}'"


NOTES = (
    Note("email", "EMAIL", 0.99, "Write to ", f"'user' || {number(K)} || '.x@mail' || {number(f'{K} % 7')} || '.example.org'", ", not to a@b or @home."),
    Note("url", "URL", 0.98, "See (", f"'HTTPS://host' || {number(K)} || '.example.org/p?q=' || {number(f'{K} % 11')}", ") or ftp://x."),
    Note("ipv4", "IP", 0.9, "Server IP", f"{number(f'{K} % 223 + 1')} || '.' || {number(f'{K} % 256')} || '.' || {number(f'{K} % 100')} || '.' || {number(f'{K} % 7')}", " and 1.2.3.4.5 or 300.1.1.1"),
    Note("ipv6", "IP", 0.9, "Host ", f"'2001:db8:0:0:0:0:' || {number(f'{K} % 10000')} || ':1'", " at 10:30:00"),
    Note("us_ssn", "GOV_ID", 0.9, "SSN", f"{digits(K, 3)} || '-' || {digits(K, 2)} || '-' || {digits(K, 4)}", " or 1234-56-7890"),
    Note("street_en", "ADDRESS", 0.85, "lives at ", f"{number(f'{K} % 9000 + 1')} || ' N Baker Street'", ", not on a Street"),
    Note("street_de", "ADDRESS", 0.85, "wohnt ", f"'Hauptstraße ' || {number(f'{K} % 900 + 1')}", ", nicht weg"),
    Note("uk_postcode", "ADDRESS", 0.85, "in ", f"'SW' || {number(f'{K} % 10')} || 'A ' || {number(f'{K} % 7')} || 'AA'", " or so"),
    Note("us_state_zip", "ADDRESS", 0.8, "from Springfield, ", f"'IL ' || {digits(K, 5)}", " but IN 12345 no"),
    Note("zip_labelled", "ADDRESS", 0.8, "the zip code ", digits(K, 5), " and number 12345"),
    Note("zip_after_unit", "ADDRESS", 0.75, "at Suite 12, ", digits(K, 5), " and 54321"),
    Note("bic", "ACCOUNT_ID", 0.9, "swift code: ", f"'DEUTDEF' || {number(f'{K} % 10')}", " not ABCDEFGH"),
    Note("mac", "MAC", 0.95, "MAC Address", f"'4e:b8:7f:' || {digits(K, 2)} || ':' || {digits(f'{K} + 7', 2)} || ':0a'", " off"),
    Note("eth", "CRYPTO", 0.97, "send to ", f"'0x' || lpad({number(K)}, 40, '0')", " not 0x12"),
    Note("btc", "CRYPTO", 0.9, "wallet ", f"'1BoatSLRHtKNngkdXEeobR76b53LETtp' || replace({number(K)}, '0', '9')", " or 1abc"),
    Note("coord", "COORDINATES", 0.8, "at ", f"'[' || {number(f'{K} % 90')} || '.5,-' || {number(f'{K} % 180')} || '.25]'", " version 1.2, 3.4"),
    Note("case_num", "CASE_ID", 0.8, "court ", f"'AZ ' || {number(f'{K} % 9000 + 1')} || ' C ' || {number(f'{K} % 900 + 1')} || '/26'", " decided"),
    Note("ref_num", "CASE_ID", 0.7, "application ", f"{number(f'{K} % 90000 + 1000')} || '/97'", " or 3/4"),
    Note("initials", "PERSON", 0.55, "met ", INITIALS, " in the u.s. today", f"{INITIALS} not in ({STOPPED})"),
    Note("date", "DATE", 0.7, "on ", f"{number(f'{K} % 28 + 1')} || 'th of March ' || {number(f'1950 + {K} % 70')}", " you may 5 or 51.02.538"),
    Note("unit", "ADDRESS", 0.8, "in ", f"'Suite ' || {number(f'{K} % 9000 + 1')}", ", a suite of rooms"),
    Note("age", "AGE", 0.8, "she is ", f"{number(f'{K} % 90 + 10')} || ' years old'", ", 5 years later"),
    Note("time", "TIME", 0.65, "at ", f"{digits(f'{K} % 24', 2)} || ':' || {digits(f'{K} % 60', 2)} || ' PM'", " or 3:2"),
    Note("iban", "IBAN", 0.99, "pay to IBAN", f"'GB' || lpad({number(IBAN_REST)}, 2, '0') || 'WEST' || {ACCOUNT}", ", not GB00WEST12345698765432."),
    Note("card_luhn", "CREDIT_CARD", 0.97, "card", f"{CARD} || {number(CHECK)}", " exp 12/27"),
    Note("card_format", "CREDIT_CARD", 0.6, "card", f"{CARD} || {number(f'({CHECK} + 1) % 10')}", " exp 12/27"),
    Note("phone", "PHONE", 0.6, "call ", f"'+43 660 ' || {digits(f'{K} * 7919', 7)}", " in 2012-2013, see 417 (2023)"),
    Note("labelled_id", "PATIENT_ID", 0.85, "Patient No: ", digits(K, 8), " came"),
    Note("gazetteer", "LOCATION", 0.52, "from ", f"case {K} % 4 when 0 then 'Vienna' when 1 then 'New York' when 2 then 'Japan' else 'São Paulo' end", " not Viennas or vienna"),
    Note("custom:badge", "ACCOUNT_ID", 0.9, "badge = ", f"'B' || {digits(K, 6)} || 'x'", " and B12"),
)
RECOGNIZERS = (Recognizer("badge", r"badge\s*=\s*(?P<the_id>B\d{6}x)", "ACCOUNT_ID", group="the_id"),)


def spans(note: Note):
    """Query: what the detector finds in its notes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "customer").where(note.where).selectExpr(f"{K} as doc_id", f"{note.text()} as text")
        found = detect(docs, RECOGNIZERS if note.detector.startswith("custom:") else (), only=[note.detector])
        each = found.selectExpr("doc_id", "inline(spans)").where(f"detector = '{note.detector}'")
        return each.selectExpr("doc_id", "start as span_start", "`end` as span_end", "entity_type", "value", "confidence")

    return run


def spans_sql(note: Note) -> str:
    n = len(note.before)
    value = f"({note.value})"
    return (
        f"SELECT {K} AS doc_id, CAST({n} AS INTEGER) AS span_start, CAST({n} + length({value}) AS INTEGER) AS span_end, '{note.entity_type}' AS entity_type, "
        f"{value} AS value, CAST({note.confidence} AS DOUBLE) AS confidence FROM customer WHERE {note.where}"
    )
