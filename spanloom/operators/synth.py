"""Synthetic labelled documents: sentences of literals and drawn values, with gold spans by running lengths.

All draws are hashes of the seed, the document and the slot, so the documents are the same in every session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = "Anna,Boris,Carla,Dmitri,Elena,Frank,Greta,Hugo,May,Łukasz,Zoë,Øyvind".split(",")
LAST = "Keller,Novak,Larsen,Stone,Weber,O'Hara,Škoda,Summer,de Vries,Barrows".split(",")
CITY = "Vienna,Paris,Oslo,New York,São Paulo".split(",")
STREET = "Baker,Mill,Station,Garden".split(",")

#: By domain: (literal before, slot) in order, then the literal at the end.
TEMPLATES = {
    "medical": (("Patient: ", "PERSON"), (", born ", "DATE"), (", patient no: ", "PATIENT_ID"), (". Lives at ", "ADDRESS"), (". Mail ", "EMAIL"), (", phone ", "PHONE"), (". She is ", "AGE"), (".", None)),
    "legal": (("Contact: ", "PERSON"), (" filed as ", "CASE_ID"), (" in ", "LOCATION"), (" on ", "DATE"), (". See ", "URL"), (" from ", "IP"), (".", None)),
    "finance": (("Contact: ", "PERSON"), (" paid with card ", "CREDIT_CARD"), (" from account IBAN ", "IBAN"), (", ssn ", "GOV_ID"), (", device ", "MAC"), (", mail ", "EMAIL"), (" ok.", None)),
}


def _draw(seed: int, slot: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.lit(slot)), F.lit(n)).cast("long")


def _pick(pool: list[str], seed: int, slot: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (_draw(seed, slot, len(pool)) + 1).cast("int"))


def _digits(seed: int, slot: int, n: int) -> Column:
    return F.lpad(_draw(seed, slot, 10**n).cast("string"), n, "0")


def _luhn(body: Column, n: int) -> Column:
    """n digits and the check digit that makes Luhn's sum a multiple of ten."""
    total = F.lit(0)
    for k in range(n):
        d = F.substr(body, F.lit(k + 1), F.lit(1)).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if (n - k) % 2 else d)
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def _iban(account: Column) -> Column:
    rest = F.concat(F.lit("32142829"), account, F.lit("161100")).cast("decimal(38,0)") % 97
    return F.concat(F.lit("GB"), F.lpad((98 - rest.cast("int")).cast("string"), 2, "0"), F.lit("WEST"), account)


def value(kind: str, seed: int, slot: int) -> Column:
    number = lambda n: _digits(seed, slot, n)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = {
        "PERSON": lambda: text(_pick(FIRST, seed, slot), " ", _pick(LAST, seed, slot + 100)),
        "DATE": lambda: text((_draw(seed, slot, 28) + 1).cast("string"), " March ", (_draw(seed, slot + 100, 60) + 1950).cast("string")),
        "PATIENT_ID": lambda: number(8),
        "ADDRESS": lambda: text((_draw(seed, slot, 900) + 1).cast("string"), " ", _pick(STREET, seed, slot + 100), " Street"),
        "EMAIL": lambda: text("u", number(5), "@mail.example.org"),
        "PHONE": lambda: text("+43 660 ", number(7)),
        "AGE": lambda: text((_draw(seed, slot, 90) + 10).cast("string"), " years old"),
        "CASE_ID": lambda: text("AZ ", (_draw(seed, slot, 90) + 1).cast("string"), " C ", (_draw(seed, slot + 100, 900) + 1).cast("string"), "/26"),
        "LOCATION": lambda: _pick(CITY, seed, slot),
        "URL": lambda: text("https://host", number(3), ".example.org/p"),
        "IP": lambda: text("10.", _draw(seed, slot, 256).cast("string"), ".", _draw(seed, slot + 100, 256).cast("string"), ".7"),
        "CREDIT_CARD": lambda: _luhn(text("400000", number(9)), 15),
        "IBAN": lambda: _iban(text("000000", number(8))),
        "GOV_ID": lambda: text(_digits(seed, slot, 3), "-", _digits(seed, slot + 100, 2), "-", _digits(seed, slot + 200, 4)),
        "MAC": lambda: text("4e:b8:7f:00:", _digits(seed, slot, 2), ":", _digits(seed, slot + 100, 2)),
    }
    return made[kind]()


def labelled(spark: SparkSession, n: int = 30, seed: int = 7) -> DataFrame:
    """(doc_id, domain, text, gold): n documents whose domains take turns; gold: array<struct<start, end, entity_type, value>>."""
    out = None
    for turn, (domain, slots) in enumerate(sorted(TEMPLATES.items())):
        rows = spark.range(n).select(F.col("id").alias("doc_id")).where(F.col("doc_id") % len(TEMPLATES) == turn)
        kinds = [(k, kind) for k, (_, kind) in enumerate(slots) if kind]
        rows = rows.withColumns({f"v{k}": value(kind, seed, 1000 * turn + k) for k, kind in kinds})
        at, gold, text = F.lit(0), [], []
        for k, (before, kind) in enumerate(slots):
            at = at + len(before)
            text.append(F.lit(before))
            if kind:
                end = at + F.length(f"v{k}")
                gold.append(F.struct(at.alias("start"), end.alias("end"), F.lit(kind).alias("entity_type"), F.col(f"v{k}").alias("value")))
                text.append(F.col(f"v{k}"))
                at = end
        one = rows.select("doc_id", F.lit(domain).alias("domain"), F.concat(*text).alias("text"), F.array(*gold).alias("gold"))
        out = one if out is None else out.unionByName(one)
    return out
