"""Entity resolution: mentions of one entity in a document. It needs nothing beyond the row, so it runs where the spans are, without a shuffle."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.lexicon import DEFAULT, Lexicon
from spanloom.functions.rex import arrow_pass, struct_lists
from spanloom.schemas import ENTITY_SQL, SPAN_ARROW

_BLANKS = re.compile(r"\s+")
_SEPARATORS = re.compile(r"[\s\-.()]")
ENTITY = {
    "entity_type": pa.string(),
    "entity_key": pa.string(),
    "canonical": pa.string(),
    "idx": pa.int32(),
    "first": pa.int32(),
    "confidence": pa.float64(),
    "members": pa.list_(pa.struct(list(SPAN_ARROW.items()))),
}


def norm_value(entity_type: Column, value: Column) -> Column:
    """What makes two values one: by type, without case, blanks or separators that don't count."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return (
        F.when(entity_type.isin("EMAIL", "URL"), F.lower(v))
        .when(entity_type.isin("IBAN", "CREDIT_CARD", "PHONE"), F.regexp_replace(v, r"(?U)[\s\-.()]", ""))
        .otherwise(F.regexp_replace(F.lower(v), r"(?U)\s+", " "))
    )


def norm(kind: str, value: str) -> str:
    """norm_value of one value."""
    if kind in ("EMAIL", "URL"):
        return value.strip().lower()
    if kind in ("IBAN", "CREDIT_CARD", "PHONE"):
        return _SEPARATORS.sub("", value)
    return _BLANKS.sub(" ", value.strip().lower())


def name_parts(value: str, lexicon: Lexicon = DEFAULT) -> list[str]:
    """Lower-case parts of a name without a leading honorific, dots at their ends removed."""
    words = value.split()
    if len(words) > 1 and words[0].lower().removesuffix(".") in lexicon.titles:
        words = words[1:]
    return [w.lower().strip(".") for w in words]


def document_entities(spans: list[dict], lexicon: Lexicon = DEFAULT) -> list[dict]:
    """Entities of one document in the order of first appearance: entity_type, entity_key, canonical, idx, first, confidence, members.

    Persons of two parts and more are keyed by their full name. A one-part mention takes the key of the only full name of
    its document that has the part; with none or several it is its own entity. canonical: the longest surface,
    full names before parts, the earliest on a tie. idx: order of first appearance within the type, from 1.
    """
    parts = [name_parts(s["value"], lexicon) if s["entity_type"] == "PERSON" else None for s in spans]
    owners: dict[str, set[str]] = defaultdict(set)
    for own in parts:
        if own and len(own) > 1:
            for part in own:
                owners[part].add("f:" + " ".join(own))
    groups: dict[tuple[str, str], list[tuple[dict, bool]]] = defaultdict(list)
    for span, own in zip(spans, parts, strict=True):
        partial = own is not None and len(own) < 2
        if own is None:
            key = "v:" + norm(span["entity_type"], span["value"])
        elif not partial:
            key = "f:" + " ".join(own)
        else:
            full = owners.get(own[0] if own else "", ())
            key = next(iter(full)) if len(full) == 1 else "p:" + " ".join(own)
        groups[span["entity_type"], key].append((span, partial))
    out, counts = [], defaultdict(int)
    ordered = sorted((min(s["start"] for s, _ in own) if len(own) > 1 else own[0][0]["start"], key, kind) for (kind, key), own in groups.items())
    for _, key, kind in ordered:
        mentions = groups[kind, key]
        counts[kind] += 1
        best, members = mentions[0][0], [s for s, _ in mentions]
        if len(mentions) > 1:
            best = max(mentions, key=lambda m: (len(m[0]["value"]), not m[1], -m[0]["start"]))[0]
            members.sort(key=lambda s: (s["start"], s["seq"]))
        out.append(
            {
                "entity_type": kind,
                "entity_key": key,
                "canonical": best["value"],
                "idx": counts[kind],
                "first": members[0]["start"],
                "confidence": max(s["confidence"] for s in members),
                "members": members,
            }
        )
    return out


def entity_column(spans: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The entities of a row's array<SPAN>; null spans have none."""

    @arrow_pass(f"array<{ENTITY_SQL}>")
    def made(lists: pa.Array) -> pa.Array:
        found = (document_entities(own or [], lexicon) for own in lists.to_pylist())
        return struct_lists(([tuple(e.values()) for e in own] for own in found), ENTITY)

    return made(spans)


def entities(docs: DataFrame, spans: str = "resolved", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(doc_id, entity_type, entity_key, canonical, idx, first, confidence, members) of every entity of each row."""
    return docs.select("doc_id", F.inline(entity_column(F.col(spans), lexicon)))
