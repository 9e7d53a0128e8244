"""Detectors: text to array<SPAN> in one linear Arrow pass with every pattern compiled once; nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import patterns as P
from spanloom.functions.places import PLACES
from spanloom.functions.rex import Match, arrow_pass, automaton, struct_lists, whole_hits
from spanloom.functions.validators import date_ok, iban_ok, luhn_ok, phone_ok
from spanloom.operators.recognizers import Recognizer
from spanloom.schemas import SPAN_ARROW, SPANS_SQL

BLOCKING = 0.85
Found = tuple[int, int, str, str, float, str]
DIGIT = re.compile(r"\d")


def initials_ok(value: str) -> bool:
    return value.isupper() and value not in P.INITIALS_STOP


#: Confidence of a detector's spans.
CONFIDENCE = {name: confidence for name, _, confidence, _, _ in P.SIMPLE} | {"iban": 0.99, "card_luhn": 0.97, "card_format": 0.6, "phone": 0.6, "labelled_id": 0.85, "gazetteer": 0.52}

#: What a match of a pattern must also be.
TESTS: dict[str, Callable[[str], bool]] = {"date": date_ok, "initials": initials_ok}


def matches(pattern: re.Pattern, text: str, test: Callable[[str], bool] | None = None) -> Iterator[Match]:
    """Places of the pattern, or of its first group where it has one."""
    group = 1 if pattern.groups else 0
    for m in pattern.finditer(text):
        if test is None or test(m[group]):
            yield *m.span(group), m[group]


def ibans(start: re.Pattern, whole: re.Pattern, text: str) -> Iterator[Match]:
    """Valid candidates at every start; those that begin inside one already found are skipped."""
    at = 0
    for m in start.finditer(text):
        found = whole.match(text, m.start()) if m.start() >= at else None
        if found and iban_ok(found[1]):
            at = found.end(1)
            yield *found.span(1), found[1]


def card_numbers(run: re.Pattern, part: re.Pattern, card: re.Pattern, text: str) -> Iterator[Match]:
    """Runs of digits that are as long as a card number. In a longer run each part without separators that is a number by itself comes
    first, so that it takes no digits of its neighbours; groups of digits are looked for in what is between."""
    for m in run.finditer(text):
        if sum(map(str.isdigit, m[0])) <= P.MOST_CARD_DIGITS:
            yield *m.span(), m[0]
            continue
        at = m.start()
        for own in (*part.finditer(text, *m.span()), None):
            for group in card.finditer(text, at, own.start() if own else m.end()):
                yield *group.span(), group[0]
            if own:
                yield *own.span(), own[0]
                at = own.end()


def span_of(seq: int, f: Found) -> dict:
    """A found span with its number, by the names of SPAN."""
    return {"seq": seq, "start": f[0], "end": f[1], "entity_type": f[2], "value": f[3], "confidence": f[4], "detector": f[5]}


class Detectors:
    """The wanted detectors over one text at a time: all, or those that `only` names, or whose spans have the least confidence.

    Recognizers count in any case, as far as their confidence does.
    """

    def __init__(self, recognizers: Sequence[Recognizer] = (), places: Sequence[str] | None = PLACES, only: Sequence[str] | None = None, least: float = 0.0):
        self.recognizers, self.places = tuple(r for r in recognizers if r.confidence >= least), tuple(places or ())
        self.only, self.least = only, least

    def wants(self, name: str) -> bool:
        return (self.only is None or name in self.only) and CONFIDENCE[name] >= self.least

    @cached_property
    def plain(self) -> list[tuple]:
        """(name, type, confidence, pattern, its group, string that a text must hold, whether it must hold a digit, test, whether it has hints, hint, hint words)."""
        out = []
        for name, kind, confidence, source, need in P.SIMPLE:
            if self.wants(name):
                pattern = re.compile(source)
                out.append((name, kind, confidence, pattern, 1 if pattern.groups else 0, need or "", name not in P.WITHOUT_DIGITS, TESTS.get(name), name in self.hints, *self.hints.get(name, (None, ()))))
        return out

    @cached_property
    def hints(self) -> dict[str, tuple[Callable | None, list[str]]]:
        return {name: (re.compile(P.HINTS[name]).search if name in P.HINTS else None, P.HINT_WORDS.get(name, [])) for name in (*P.HINTS, *P.HINT_WORDS)}

    def may_have(self, name: str, text: str, low: str) -> bool:
        """Whether the detector may find anything in the text, whose folded form is `low`."""
        hint, words = self.hints.get(name, (None, ()))
        if (hint is None and not words) or (hint is not None and hint(text) is not None):
            return True
        for w in words:
            if w in low:
                return True
        return False

    @cached_property
    def compiled(self) -> dict[str, re.Pattern]:
        return {"start": re.compile(P.IBAN_START), "whole": re.compile(P.IBAN_WHOLE), "card": re.compile(P.CARD), "run": re.compile(P.DIGIT_RUN), "part": re.compile(P.CARD_PART), "phone": re.compile(P.PHONE), "labelled": re.compile(P.LABELLED)}

    @cached_property
    def gazetteer(self):
        return automaton(self.places) if self.wants("gazetteer") else None

    @cached_property
    def custom(self) -> list[tuple[Recognizer, re.Pattern]]:
        return [(r, r.compiled()) for r in self.recognizers]

    def __call__(self, text: str) -> list[Found]:
        """(start, end, type, value, confidence, detector) in the order of emission."""
        out: list[Found] = []
        digits, low = DIGIT.search(text) is not None, P.folded(text)
        for name, kind, confidence, pattern, group, need, numeric, test, hinted, hint, words in self.plain:
            if (numeric and not digits) or need not in text:
                continue
            if hinted and (hint is None or hint(text) is None):  # as in may_have
                for w in words:
                    if w in low:
                        break
                else:
                    continue
            for m in pattern.finditer(text):
                v = m[group]
                if test is None or test(v):
                    s, e = m.span(group)
                    out.append((s, e, kind, v, confidence, name))
        if digits:
            out += self._numbers(text, low)
        out += ((s, e, "LOCATION", v, CONFIDENCE["gazetteer"], "gazetteer") for s, e, v in whole_hits(text, self.gazetteer))
        for r, pattern in self.custom:
            group = r.group or 0
            spans = ((*m.span(group), m[group]) for m in pattern.finditer(text))
            out += ((s, e, r.entity_type, v, float(r.confidence), f"custom:{r.name}") for s, e, v in spans if v)
        return out

    def _numbers(self, text: str, low: str) -> Iterator[Found]:
        """Checked and labelled numbers."""
        of = self.compiled
        if self.wants("iban"):
            for s, e, v in ibans(of["start"], of["whole"], text):
                yield s, e, "IBAN", v, CONFIDENCE["iban"], "iban"
        cards = [name for name in ("card_luhn", "card_format") if self.wants(name)]
        for s, e, v in card_numbers(of["run"], of["part"], of["card"], text) if cards else ():
            name = "card_luhn" if luhn_ok(v) else "card_format"
            if name in cards:
                yield s, e, "CREDIT_CARD", v, CONFIDENCE[name], name
        if self.wants("phone"):
            for s, e, v in matches(of["phone"], text, phone_ok):
                yield s, e, "PHONE", v, CONFIDENCE["phone"], "phone"
        if self.wants("labelled_id") and self.may_have("labelled_id", text, low):
            for m in of["labelled"].finditer(text):
                label = P.LABEL.match(m[0])[0].lower()
                yield *m.span(1), P.LABEL_TYPES.get(label, "ACCOUNT_ID"), m[1].strip(), CONFIDENCE["labelled_id"], "labelled_id"


def spans_column(text: Column, detectors: Detectors) -> Column:
    """array<SPAN> of the text, numbered in the order of emission; null text gives an empty one."""

    @arrow_pass(SPANS_SQL)
    def spans(texts: pa.Array) -> pa.Array:
        found = (detectors(t or "") for t in texts.to_pylist())
        return struct_lists(([(k, *f) for k, f in enumerate(own)] for own in found), SPAN_ARROW)

    return spans(text)


def detect(docs: DataFrame, recognizers: Sequence[Recognizer] = (), places: bool = True, only: Sequence[str] | None = None, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with array<SPAN> of all native detectors, or of those named in `only`, and of the recognizers. Null text gives no spans."""
    return docs.withColumn(out, spans_column(F.col(text), Detectors(recognizers, PLACES if places else None, only)))


def blocking(docs: DataFrame, recognizers: Sequence[Recognizer] = (), threshold: float = BLOCKING, text: str = "text", out: str = "fresh") -> DataFrame:
    """Spans of deterministic and custom detectors of at least `threshold`."""
    return docs.withColumn(out, spans_column(F.col(text), Detectors(recognizers, None, least=threshold)))
