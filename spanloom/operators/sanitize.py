"""Sanitising: entities to tokens, edits, propagation of known surfaces, and a final sweep.

All of it happens within a document, so it is one Arrow pass over the document row without a shuffle. Only a registry of
tokens that documents share needs exchanges: entities go out for it, and a document's tokens come back.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Collection, Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.lexicon import DEFAULT, Lexicon
from spanloom.functions.rex import Match, arrow_pass, splice, spliced, struct_lists, whole_hits
from spanloom.operators.detect import Detectors, span_of
from spanloom.operators.kernel import NAME_WORD, disjoint
from spanloom.operators.leakscan import scan
from spanloom.operators.policy import KEEP, TOKENIZE, Policy
from spanloom.operators.resolve import document_entities
from spanloom.operators.tokens import REDACTED, TOKEN_FINDER, token_of
from spanloom.schemas import SPAN_ARROW, SPANS_SQL

# Shortest surface and name part that propagate, confidence of a propagated shared part and vault value.
LEAST_SURFACE, LEAST_PART, PART_CONFIDENCE, VAULT_CONFIDENCE = 2, 3, 0.5, 0.9

EDIT = {"start": pa.int32(), "end": pa.int32(), "replacement": pa.string(), "confidence": pa.float64()}
ENTRY = {"token": pa.string(), "entity_type": pa.string(), "value": pa.string(), "action": pa.string()}
ACTED = {
    "entity_type": pa.string(),
    "canonical": pa.string(),
    "idx": pa.int32(),
    "action": pa.string(),
    "replacement": pa.string(),
    "confidence": pa.float64(),
    "members": pa.list_(pa.struct(list(SPAN_ARROW.items()))),
}
RESULT = {
    "sanitized": pa.string(),
    "entities": pa.list_(pa.struct(list(ACTED.items()))),
    "edits": pa.list_(pa.struct(list(EDIT.items()))),
    "vault": pa.list_(pa.struct(list(ENTRY.items()))),
    "swept_count": pa.int32(),
    "num_tokenized": pa.int32(),
    "num_redacted": pa.int32(),
}
ACTED_SQL = f"struct<entity_type:string,canonical:string,idx:int,action:string,replacement:string,confidence:double,members:{SPANS_SQL}>"
VAULT_SQL = "array<struct<token:string,entity_type:string,value:string,action:string>>"
RESULT_SQL = (
    f"struct<sanitized:string,entities:array<{ACTED_SQL}>,edits:array<struct<start:int,end:int,replacement:string,confidence:double>>,"
    f"vault:{VAULT_SQL},swept_count:int,num_tokenized:int,num_redacted:int>"
)
#: What a registry is asked for: an entity's type and value, or a part of a name that several persons share.
ASKED = {"entity_type": pa.string(), "canonical": pa.string(), "first": pa.int32()}
ASKED_SQL = "struct<entity_type:string,canonical:string,first:int>"
LATE = 2**31 - 1


def registry_norm(value: str) -> str:
    """What the registry compares: lower case, blanks collapsed."""
    return re.sub(r"\s+", " ", value.strip(" ").lower())


def name_words(canonical: str, lexicon: Lexicon = DEFAULT) -> list[str]:
    """Words of a person's name that may stand for the person alone; none unless the name has a title or two real words."""
    words = NAME_WORD.findall(canonical)
    real = [w for w in words if w.lower() not in lexicon.titles]
    if len(real) == len(words) < 2:
        return []
    return list(dict.fromkeys(w for w in real if len(w) >= LEAST_PART and w.lower() not in lexicon.never_alone))


def free_hits(text: str, entities: list[dict], surfaces: Collection[str]) -> Iterator[Match]:
    """Whole-word places of the surfaces that no mention of an entity touches."""
    base = sorted((m["start"], m["end"]) for e in entities for m in e["members"])
    starts = [s for s, _ in base]
    for s, e, value in whole_hits(text, surfaces):
        at = bisect_right(starts, s) - 1
        if not (at >= 0 and base[at][1] > s) and not (at + 1 < len(base) and starts[at + 1] < e):
            yield s, e, value


def finished(text: str, edits: Iterable[tuple[int, int, str]], vault: Iterable[tuple[str, str]]) -> tuple[str, int]:
    """The text with its ordered edits and after the sweep, where a tokenised value of (token, value) that still stands as a whole word
    gives way to its first token; and the number of those."""
    first: dict[str, str] = {}
    for token, value in vault:
        if len(value) >= LEAST_SURFACE:
            first.setdefault(value, token)
    out = spliced(text, edits)
    left = [(s, e, first[v]) for s, e, v in whole_hits(out, first)]
    return spliced(out, left), len(left)


@dataclass(frozen=True)
class Sanitizer:
    """The steps over one document; picklable, so that it goes to the workers once."""

    policy: Policy
    use_names: bool = True
    lexicon: Lexicon = DEFAULT
    provider: Callable[[str], list[dict]] | None = None

    def acted(self, text: str, detectors: Detectors) -> list[dict]:
        """Entities that the policy doesn't keep, with their action, in the order of first appearance."""
        found = [span_of(k, f) for k, f in enumerate(detectors(text))]
        out = []
        for e in document_entities(disjoint(text, found, self.use_names, self.lexicon, self.provider), self.lexicon):
            if (action := self.policy.action_for(e["entity_type"])) != KEEP:
                e["action"] = action
                out.append(e)
        return out

    def parts(self, entities: list[dict]) -> dict[str, dict[str, dict]]:
        """Parts of persons' names, with the entities that have them by their replacements; the first to appear comes first."""
        out: dict[str, dict[str, dict]] = {}
        for e in entities:
            if e["entity_type"] == "PERSON":
                for part in name_words(e["canonical"], self.lexicon):
                    out.setdefault(part, {}).setdefault(e["replacement"], e)
        return out

    def asked(self, text: str, detectors: Detectors) -> list[tuple]:
        """What the registry has to know of a document: its entities, then the shared parts of names that stand alone in it."""
        entities = [{**e, "replacement": e["entity_key"]} for e in self.acted(text, detectors)]
        surfaces = self.surfaces(entities, {}, [])
        alone = dict.fromkeys(v for _, _, v in free_hits(text, entities, surfaces) if surfaces[v][0] is None)
        return [*((e["entity_type"], e["canonical"], e["first"]) for e in entities), *(("PERSON", v, LATE) for v in alone)]

    def surfaces(self, entities: list[dict], tokens: dict[tuple[str, str], str], earlier: list[tuple[str, str]]) -> dict[str, tuple[str | None, float, str | None]]:
        """surface to (replacement, confidence, token): what propagates in a document. A null replacement marks a name part
        that several persons share; it has its token from the registry, if there is one, or gets one when it turns up.

        A surface belongs to the entity that appears first. A part of one person stands for the person unless it is
        itself a surface; values of earlier documents come after that, shared parts last.
        """
        out: dict[str, tuple[str | None, float, str | None]] = {}
        for e in entities:
            members = e["members"]
            for surface in sorted({m["value"] for m in members} | {e["canonical"]}) if len(members) > 1 else (e["canonical"],):
                if len(surface) >= LEAST_SURFACE:
                    out.setdefault(surface, (e["replacement"], e["confidence"], None))
        parts = self.parts(entities)
        for part, owners in parts.items():
            if len(owners) == 1:
                (replacement, e), = owners.items()
                out.setdefault(part, (replacement, e["confidence"], None))
        for surface, replacement in sorted(earlier):
            out.setdefault(surface, (replacement, VAULT_CONFIDENCE, None))
        for part in parts:
            if part not in out:
                out[part] = None, PART_CONFIDENCE, tokens.get(("PERSON", registry_norm(part))) if tokens else None
        return out

    def edited(self, text: str, detectors: Detectors, tokens: dict[tuple[str, str], str] | None = None, earlier: list[tuple[str, str]] = ()) -> tuple:
        """(entities, edits, vault, (tokenized, redacted) shared name parts that turn up): entities as dicts, ordered edits as tuples of
        EDIT, vault entries by token."""
        tokens = tokens or {}
        entities = self.acted(text, detectors)
        for e in entities:
            shared = tokens.get((e["entity_type"], registry_norm(e["canonical"]))) if tokens else None
            e["replacement"] = (shared or token_of(e["entity_type"], e["idx"])) if e["action"] == TOKENIZE else REDACTED
        edits = [(m["start"], m["end"], e["replacement"], m["confidence"]) for e in entities for m in e["members"]]
        surfaces = self.surfaces(entities, tokens, earlier)
        vault = {e["replacement"]: (e["entity_type"], e["canonical"], e["action"]) for e in entities if e["action"] == TOKENIZE}
        person = self.policy.action_for("PERSON")
        last = max((e["idx"] for e in entities if e["entity_type"] == "PERSON"), default=0)
        minted: dict[str, str] = {}
        for s, e, value in free_hits(text, entities, surfaces):
            replacement, confidence, token = surfaces[value]
            if replacement is None:
                if value not in minted:
                    minted[value] = (token or token_of("PERSON", last + len(minted) + 1)) if person == TOKENIZE else REDACTED
                    if person == TOKENIZE:
                        vault.setdefault(minted[value], ("PERSON", value, person))
                replacement = minted[value]
            elif replacement != REDACTED and replacement not in vault:  # a token of another document, used here
                vault[replacement] = (TOKEN_FINDER.match(replacement)[1], value, TOKENIZE)
            edits.append((s, e, replacement, confidence))
        edits.sort()
        return entities, edits, vault, (len(minted), 0) if person == TOKENIZE else (0, len(minted))

    def __call__(self, text: str | None, detectors: Detectors, tokens: dict[tuple[str, str], str] | None = None, earlier: list[tuple[str, str]] = ()) -> tuple:
        """A row of RESULT: entities as dicts, edits and vault entries as tuples."""
        whole = text or ""
        entities, edits, vault, (more, hidden) = self.edited(whole, detectors, tokens, earlier)
        sanitized, swept = finished(whole, (x[:3] for x in edits), ((token, value) for token, (_, value, _) in vault.items()))
        entries = [(token, *entry) for token, entry in vault.items()]
        n = sum(e["action"] == TOKENIZE for e in entities)
        return (
            None if text is None else sanitized,
            entities,
            edits,
            entries,
            swept,
            n + more,
            len(entities) - n + hidden,
        )


def entity_lists(rows: Iterable[list[dict]]) -> pa.Array:
    """One list of ACTED for each row of entities."""
    places, flat = [0], []
    for own in rows:
        flat += own
        places.append(len(flat))
    plain = [pa.array([e[f] for e in flat], t) for f, t in ACTED.items() if f != "members"]
    member = itemgetter(*SPAN_ARROW)
    members = struct_lists(([member(m) for m in e["members"]] for e in flat), SPAN_ARROW)
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays([*plain, members], list(ACTED)))


def result_column(rows: list[tuple]) -> pa.Array:
    """Rows of RESULT as a column, each field from flat values: dicts of dicts would take longer than the search."""
    made = {"entities": entity_lists, "edits": lambda c: struct_lists(c, EDIT), "vault": lambda c: struct_lists(c, ENTRY)}
    columns = zip(*rows, strict=True) if rows else [()] * len(RESULT)
    return pa.StructArray.from_arrays([made[f](c) if f in made else pa.array(c, t) for c, (f, t) in zip(columns, RESULT.items(), strict=True)], list(RESULT))


def earlier_values(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, surface, replacement) of tokenised values that a document may hold and that first stood in an earlier one.

    An as-of join: equal on all words of the value, by a hash of them, and the document where it first stood before this
    one. A document gives the runs of words of the lengths that values have; there are few lengths, so a
    common word brings no candidates beyond the values that it is. Propagation looks for the value itself.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    known = entities.where(F.length("canonical") >= LEAST_SURFACE)
    known = known.groupBy("replacement").agg(F.min_by("canonical", F.struct("doc_id", "first")).alias("surface"), F.min("doc_id").alias("first_doc"))
    known = known.withColumn("words", words(F.col("surface"))).where(F.size("words") > 0)
    known = known.select("replacement", "surface", "first_doc", F.size("words").alias("n"), F.xxhash64(F.array_join("words", " ")).alias("run"))
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # numbers of words, not values
    own = docs.select(F.col("doc_id"), words(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    runs = [F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda k, n=n: F.xxhash64(F.array_join(F.slice("w", k, n), " "))) for n in lengths]
    none = F.array().cast("array<bigint>")
    each = [F.when(F.size("w") >= n, r).otherwise(none) for n, r in zip(lengths, runs, strict=True)]
    held = own.select("doc_id", F.explode(F.array_distinct(F.concat(none, *each))).alias("run"))
    return held.join(known, (held["run"] == known["run"]) & (known["first_doc"] < held["doc_id"])).select("doc_id", "surface", "replacement")


def shared_results(docs: DataFrame, sanitizer: Sanitizer, detectors: Detectors, shared_tokens: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, text, r) with tokens of a registry over all documents.

    Documents are searched once for the registry and once for their edits; nothing of them is written in between.
    """

    @arrow_pass(f"array<{ASKED_SQL}>")
    def asked(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct(list(ASKED.items())))
        return pa.array([[dict(zip(ASKED, x, strict=True)) for x in sanitizer.asked(t or "", detectors)] for t in texts.to_pylist()], kind)

    found = docs.select("doc_id", F.inline(asked(F.col("text"))))
    registry = shared_tokens(found)
    norm = F.regexp_replace(F.lower(F.trim("canonical")), r"(?U)\s+", " ")
    held = found.withColumn("norm", norm).join(registry.select("entity_type", "norm", "token"), ["entity_type", "norm"])
    tokenized = [t for t in sorted({*sanitizer.policy.actions, "PERSON"}) if sanitizer.policy.action_for(t) == TOKENIZE]
    acted = F.lit(True) if sanitizer.policy.default == TOKENIZE else F.col("entity_type").isin(*tokenized)
    values = held.where(acted).select("doc_id", "canonical", "first", F.col("token").alias("replacement"))
    tokens = held.groupBy("doc_id").agg(F.collect_set(F.struct("entity_type", "norm", "token")).alias("tokens"))
    before = earlier_values(docs, values).groupBy("doc_id").agg(F.collect_set(F.struct("surface", "replacement")).alias("earlier"))

    @arrow_pass(RESULT_SQL)
    def made(texts: pa.Array, tokens: pa.Array, earlier: pa.Array) -> pa.Array:
        rows = []
        for t, own, old in zip(texts.to_pylist(), tokens.to_pylist(), earlier.to_pylist(), strict=True):
            known = {(x["entity_type"], x["norm"]): x["token"] for x in own or ()}
            rows.append(sanitizer(t, detectors, known, [(x["surface"], x["replacement"]) for x in old or ()]))
        return result_column(rows)

    joined = docs.select("doc_id", "text").join(tokens, "doc_id", "left").join(before, "doc_id", "left")
    return joined.select("doc_id", "text", made("text", "tokens", "earlier").alias("r"))


def sanitize(
    docs: DataFrame,
    policy: Policy,
    *,
    use_names: bool = True,
    lexicon: Lexicon = DEFAULT,
    provider: Callable[[str], list[dict]] | None = None,
    run_leak_scan: bool = True,
    shared_tokens: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """doc_id, text, sanitized, entities, edits, vault, counters and leak report of every row of `docs` (doc_id, text).

    A row is a document. Null text stays null and has no entity. shared_tokens: from (doc_id, entity_type, canonical, first)
    to a registry, for tokens that are the same in all documents; without it tokens count from 1 in each document, and
    nothing is shuffled.
    """
    sanitizer, detectors = Sanitizer(policy, use_names, lexicon, provider), Detectors(policy.recognizers)

    @arrow_pass(RESULT_SQL)
    def made(texts: pa.Array) -> pa.Array:
        return result_column([sanitizer(t, detectors) for t in texts.to_pylist()])

    if shared_tokens:
        rows = shared_results(docs, sanitizer, detectors, shared_tokens)
    else:
        rows = docs.select("doc_id", "text", made("text").alias("r"))
    out = rows.select("doc_id", "text", "r.*")
    return scan(out, policy.recognizers) if run_leak_scan else out


def vault_of(sanitized: DataFrame) -> DataFrame:
    """(doc_id, token, entity_type, value, action, occurrences): the table that is kept apart from the texts."""
    places = F.transform(F.filter("edits", lambda e: e["replacement"] == F.col("v")["token"]), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))
    return sanitized.select("doc_id", "edits", F.explode("vault").alias("v")).select("doc_id", "v.*", places.alias("occurrences"))


def entity_report(sanitized: DataFrame) -> DataFrame:
    """One row for each entity: type, idx, replacement, occurrences among the edits, confidence in hundredths, half-even."""
    e = sanitized.select("doc_id", "edits", F.explode("entities").alias("e"))
    count = F.when(F.col("e.action") == TOKENIZE, F.size(F.filter("edits", lambda x: x["replacement"] == F.col("e")["replacement"]))).otherwise(F.size("e.members"))
    return e.select("doc_id", "e.entity_type", "e.idx", "e.canonical", "e.action", "e.replacement", count.cast("long").alias("occurrences"), F.bround("e.confidence", 2).alias("confidence"))


def preview(sanitized: DataFrame, block: str = "█") -> DataFrame:
    """The text with every edit as blocks of its length."""
    edits = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.repeat(F.lit(block), e["end"] - e["start"]).alias("replacement")))
    return sanitized.select("doc_id", splice(F.col("text"), edits).alias("preview"))
