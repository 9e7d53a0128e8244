"""Other ways to replace an entity than by its token: synthetic, generalized, redacted, blacked out; and overrides by a reviewer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.rex import arrow_pass, splice, spliced, struct_lists
from spanloom.operators.detect import Detectors
from spanloom.operators.policy import Policy
from spanloom.operators.resolve import norm_value
from spanloom.operators.sanitize import Sanitizer
from spanloom.operators.tokens import REDACTED, make_token

MODES = ("semantic", "synthetic", "generalize", "total", "blackout")
BLOCK, LONGEST_BLOCK = "█", 16
UNCERTAIN = 0.6
YEAR, SPACE = re.compile(r"\b(?:19|20)[0-9]{2}\b"), re.compile(r"[^\S\x1c-\x1f]")

#: Invented stand-ins by type; a type without a pool gets its name and number.
POOLS = {
    "PERSON": "Alex Morgan,Sam Rivera,Robin Clarke,Jamie Novak,Kim Larsen,Toni Weber,Jo Santos,Chris Dubois".split(","),
    "EMAIL": "person1@example.com,person2@example.com,person3@example.com,person4@example.com".split(","),
    "PHONE": "+1 202 555 0101,+1 202 555 0102,+1 202 555 0103,+1 202 555 0104".split(","),
    "ADDRESS": "1 Sample Street,2 Sample Street,3 Sample Street".split(","),
    "ORGANIZATION": "Example Group,Sample Holdings,Model Foundation".split(","),
    "LOCATION": "Northtown,Southville,Eastburg,Westhaven".split(","),
    "DATE": "2000-01-01,2000-02-02,2000-03-03".split(","),
    "IP": "192.0.2.1,192.0.2.2,192.0.2.3".split(","),
    "URL": "https://example.com/a,https://example.com/b".split(","),
}
# What a value of a type is in general; the other types give their own name.
GENERAL = {
    "PERSON": "a person",
    "ORGANIZATION": "an organisation",
    "LOCATION": "a place",
    "ADDRESS": "an address",
    "EMAIL": "an email",
    "PHONE": "a phone number",
    "IBAN": "a bank account",
    "CREDIT_CARD": "a card number",
    "IP": "an IP address",
    "GOV_ID": "an ID",
    "PATIENT_ID": "a patient ID",
    "CASE_ID": "a case number",
    "ACCOUNT_ID": "an account",
    "CRYPTO": "a wallet",
}


def _known(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose one of {', '.join(MODES)}")


def _by_type(table: dict[str, Column], entity_type: Column, other: Column) -> Column:
    out = other
    for name, value in table.items():
        out = F.when(entity_type == name, value).otherwise(out)
    return out


def synthetic(entity_type: Column, ordinal: Column) -> Column:
    """The stand-in of the ordinal-th (from 1) entity of a type; the same entity always has the same one."""

    def pick(pool: list[str]) -> Column:
        turn = F.floor((ordinal - 1) / len(pool)).cast("int")
        name = F.element_at(F.array(*[F.lit(x) for x in pool]), F.pmod(ordinal - 1, F.lit(len(pool))).cast("int") + 1)
        return F.when(turn == 0, name).otherwise(F.concat(name, F.lit(" "), (turn + 1).cast("string")))

    return _by_type({t: pick(p) for t, p in POOLS.items()}, entity_type, F.concat(F.initcap(F.translate(entity_type, "_", " ")), F.lit(" "), ordinal.cast("string")))


def generalized(entity_type: Column, value: Column) -> Column:
    """What the value is in general; of a date its year, if it is of the last or this century."""
    year = F.regexp_extract(value, r"\b((?:19|20)[0-9]{2})\b", 1)
    named = F.concat(F.lit("["), _by_type({t: F.lit(x) for t, x in GENERAL.items()}, entity_type, F.lower(entity_type)), F.lit("]"))
    return F.when(entity_type.isin("DATE", "DOB"), F.when(year != "", year).otherwise("[a date]")).otherwise(named)


def blackout(value: Column) -> Column:
    n = F.length(F.regexp_replace(value, r"(?U)\s", ""))
    return F.repeat(F.lit(BLOCK), F.least(F.greatest(n, F.lit(1)), F.lit(LONGEST_BLOCK)))


def replacement(mode: str, entity_type: Column, value: Column, token: Column, ordinal: Column) -> Column:
    """What stands for a value; an entity that the policy redacts is redacted in every mode."""
    _known(mode)
    made = {"semantic": token, "synthetic": synthetic(entity_type, ordinal), "generalize": generalized(entity_type, value), "total": F.lit(REDACTED), "blackout": blackout(value)}[mode]
    return F.when(token == REDACTED, REDACTED).otherwise(made)


def _synthetic(kind: str, value: str, token: str) -> str:
    ordinal = int(token[token.rindex("_") + 1 : -2])
    if kind not in POOLS:
        return " ".join(w[:1].upper() + w[1:].lower() for w in kind.split("_")) + f" {ordinal}"
    turn, k = divmod(ordinal - 1, len(POOLS[kind]))
    return POOLS[kind][k] + (f" {turn + 1}" if turn else "")


def _generalized(kind: str, value: str, token: str) -> str:
    if kind in ("DATE", "DOB"):
        year = YEAR.search(value)
        return year[0] if year else "[a date]"
    return f"[{GENERAL.get(kind) or kind.lower()}]"


def _blackout(kind: str, value: str, token: str) -> str:
    return BLOCK * min(max(len(SPACE.sub("", value)), 1), LONGEST_BLOCK)


#: `replacement` of one entity's type, value and token.
STAND_INS: dict[str, Callable[[str, str, str], str]] = {
    "semantic": lambda kind, value, token: token,
    "synthetic": _synthetic,
    "generalize": _generalized,
    "total": lambda kind, value, token: REDACTED,
    "blackout": _blackout,
}


def edits_in_mode(text: str, sanitizer: Sanitizer, detectors: Detectors, mode: str) -> Iterator[tuple[int, int, str]]:
    """The ordered edits of one text with what stands for their values in a mode."""
    stand_in = STAND_INS[mode]
    _, edits, vault, _ = sanitizer.edited(text, detectors)
    for s, e, token, _ in edits:
        yield s, e, token if token == REDACTED else stand_in(vault[token][0], text[s:e], token)


def in_mode(docs: DataFrame, policy: Policy, mode: str, **options) -> DataFrame:
    """(doc_id, text): what `rendered_rows` makes of sanitized documents, in the one pass that searches them; only texts leave it.

    options: those of a Sanitizer.
    """
    _known(mode)
    sanitizer, detectors = Sanitizer(policy, **options), Detectors(policy.recognizers)

    @arrow_pass("string")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([t and spliced(t, edits_in_mode(t, sanitizer, detectors, mode)) for t in texts.to_pylist()], pa.string())

    return docs.select("doc_id", made("text").alias("text"))


def mapping_in_mode(docs: DataFrame, policy: Policy, mode: str, **options) -> DataFrame:
    """(doc_id, replacement, value): the `mapping` of sanitized documents, in the one pass that searches them."""
    _known(mode)
    sanitizer, detectors = Sanitizer(policy, **options), Detectors(policy.recognizers)
    kinds = {"replacement": pa.string(), "start": pa.int32(), "value": pa.string()}

    def firsts(text: str) -> list[tuple[str, int, str]]:
        found: dict[str, tuple[int, str]] = {}
        for s, e, r in edits_in_mode(text, sanitizer, detectors, mode):
            found.setdefault(r, (s, text[s:e]))
        return [(r, *first) for r, first in found.items()]

    @arrow_pass("array<struct<replacement:string,start:int,value:string>>")
    def made(texts: pa.Array) -> pa.Array:
        return struct_lists((firsts(t or "") for t in texts.to_pylist()), kinds)

    each = docs.select("doc_id", F.inline(made("text")))
    return each.groupBy("doc_id", "replacement").agg(F.min_by("value", "start").alias("value"))


def placed() -> Column:
    """array<struct<start, end, entity_type, value, token, ordinal, confidence>> of a sanitized row's edits; type and number come from the token."""

    def one(e: Column) -> Column:
        token = e["replacement"]
        parsed = F.regexp_extract(token, r"^\[\[([A-Z_]+)_\d+\]\]$", 1)
        number = F.regexp_extract(token, r"_(\d+)\]\]$", 1).try_cast("int")
        # By place, not by a filter: a Python pass over what has a lambda within a lambda isn't found again by the optimizer.
        owner = F.get(F.col("entities")["entity_type"], (F.array_position(F.col("entities")["replacement"], token) - 1).cast("int"))
        kind = F.when(parsed != "", parsed).otherwise(owner)
        value = F.substr("text", e["start"] + 1, e["end"] - e["start"])
        fields = {"start": e["start"], "end": e["end"], "entity_type": kind, "value": value, "token": token, "ordinal": F.coalesce(number, F.lit(1)), "confidence": e["confidence"]}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    return F.transform("edits", one)


def spans_of(sanitized: DataFrame) -> DataFrame:
    """(doc_id, start, end, entity_type, value, token, ordinal, confidence) of every edit."""
    return sanitized.select("doc_id", F.inline(placed()))


def with_overrides(spans: DataFrame, overrides: DataFrame) -> DataFrame:
    """Spans after a reviewer's say: (doc_id, start, end, entity_type, value, kept). kept spans stay in the clear; others are added.

    A tagged value takes the token that its type and value have in the document, or the next free number of the type.
    """
    keep = overrides.where("kept").select("doc_id", "start", "end")
    left = spans.join(keep, ["doc_id", "start", "end"], "left_anti").withColumn("norm", norm_value(F.col("entity_type"), F.col("value")))
    new = overrides.where("not kept").select("doc_id", "start", "end", "entity_type", "value").withColumn("norm", norm_value(F.col("entity_type"), F.col("value")))
    known = left.groupBy("doc_id", "entity_type", "norm").agg(F.min("token").alias("token"), F.min("ordinal").alias("ordinal"))
    last = left.groupBy("doc_id", "entity_type").agg(F.max("ordinal").alias("last"))
    fresh = new.join(known, ["doc_id", "entity_type", "norm"], "left_anti").groupBy("doc_id", "entity_type", "norm").agg(F.min("start").alias("first"))
    fresh = fresh.join(last, ["doc_id", "entity_type"], "left")
    n = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("doc_id", "entity_type").orderBy("first"))
    fresh = fresh.select("doc_id", "entity_type", "norm", make_token(F.col("entity_type"), n).alias("token"), n.alias("ordinal"))
    added = new.join(known.unionByName(fresh), ["doc_id", "entity_type", "norm"]).withColumn("confidence", F.lit(1.0))
    return left.unionByName(added.select(*left.columns)).drop("norm")


def keep_uncertain(spans: DataFrame, threshold: float = UNCERTAIN) -> DataFrame:
    """Only spans that are sure enough are replaced."""
    return spans.where(F.col("confidence") >= threshold)


def rendered(docs: DataFrame, spans: DataFrame, mode: str) -> DataFrame:
    """(doc_id, text): the documents with their spans replaced in a mode; a span that begins in an earlier one is skipped."""
    made = spans.withColumn("r", replacement(mode, F.col("entity_type"), F.col("value"), F.col("token"), F.col("ordinal")))
    edits = made.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", F.col("r").alias("replacement"))).alias("edits"))
    none = F.array().cast("array<struct<start:int,end:int,replacement:string>>")
    return docs.select("doc_id", "text").join(edits, "doc_id", "left").select("doc_id", splice(F.col("text"), F.coalesce("edits", none)).alias("text"))


def rendered_rows(sanitized: DataFrame, mode: str) -> DataFrame:
    """(doc_id, text): each sanitized row in a mode. All of it is in the row, so nothing is shuffled; `rendered` is for spans that were changed."""
    made = lambda s: replacement(mode, s["entity_type"], s["value"], s["token"], s["ordinal"])
    edits = F.transform(placed(), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), made(s).alias("replacement")))
    return sanitized.select("doc_id", splice(F.col("text"), edits).alias("text"))


def mapping(spans: DataFrame, mode: str) -> DataFrame:
    """(doc_id, replacement, value): each replacement's value where it first stands."""
    made = spans.withColumn("replacement", replacement(mode, F.col("entity_type"), F.col("value"), F.col("token"), F.col("ordinal")))
    return made.groupBy("doc_id", "replacement").agg(F.min_by("value", "start").alias("value"))
