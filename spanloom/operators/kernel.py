"""The two steps that are sequential within a document: name runs, and overlap resolution with remainders.

Both run in one Arrow pass over the document rows; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.lexicon import DEFAULT, Lexicon
from spanloom.functions.rex import arrow_pass, struct_lists
from spanloom.schemas import SPAN_ARROW, SPANS_SQL

# A name word, lower-case words that mark common words, longest run, digits and letters that a remainder needs.
NAME_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]{2})|-(?=[^\W\d_]))*")
LOWER_WORD = re.compile(r"[a-zà-öø-ÿ][a-zà-öø-ÿ']{1,}")
LONGEST_RUN = 5
DIGIT_TYPES, LEAST_DIGITS, LEAST_ALNUM = {"PHONE", "CREDIT_CARD"}, 4, 2
BLANKS = [{"".join(b) for b in product(" \t", repeat=n)} for n in (1, 2, 3)]
PLAIN_GAP = frozenset().union(*BLANKS[:2])
TITLE_GAP = frozenset(dot + b for own in BLANKS for b in own for dot in ("", "."))
#: Words whose kind a worker remembers.
MOST_KINDS = 100_000
SENTENCE_BEFORE = re.compile(r"(?:^|[.!?…\n\r])[ \t]*\Z")



class Word(NamedTuple):
    start: int
    end: int
    text: str
    bare: str
    capital: bool
    title: bool
    particle: bool


def words_of(text: str, lexicon: Lexicon) -> list[Word | None]:
    """The words of a text; None stands for one or more words that are in no run, being neither capital nor title nor particle."""
    kinds, out, make = lexicon.kinds, [], tuple.__new__
    plain = True
    for m in NAME_WORD.finditer(text):
        w = m[0]
        kind = kinds.get(w)
        if kind is None:
            if len(kinds) >= MOST_KINDS:
                kinds.clear()
            low = w.lower()
            kind = kinds[w] = (low, w[0].isupper(), low in lexicon.titles, low in lexicon.particles)
        low, capital, title, particle = kind
        if capital or title or particle:
            s, e = m.span()
            out.append(make(Word, (s, e, w, low, capital, title, particle)))
            plain = False
        elif not plain:
            out.append(None)
            plain = True
    return out


def name_runs(text: str, words: list[Word | None]) -> Iterator[list[Word]]:
    """Runs of at most LONGEST_RUN words that belong together, without particles at their ends."""
    n = len(words)

    def goes_on(k: int) -> bool:
        if k >= n or (word := words[k]) is None:
            return False
        last = words[k - 1]
        gap = text[last.end : word.start] if word.start - last.end <= 4 else ""
        if gap not in PLAIN_GAP and not (last.title and gap in TITLE_GAP):
            return False
        if word.capital:
            return True
        after = words[k + 1] if k + 1 < n else None
        return word.particle and after is not None and (after.capital or after.particle) and after.start - word.end <= 2 and text[word.end : after.start] in PLAIN_GAP

    k = 0
    while k < n:
        stop = k + 1
        if (word := words[k]) is not None and (word.capital or word.title):
            while stop - k < LONGEST_RUN and goes_on(stop):
                stop += 1
            run = words[k:stop]
            while len(run) > 1 and run[-1].particle:
                run = run[:-1]
            yield run
        k = stop


def judged(text: str, run: list[Word], common: set[str], lexicon: Lexicon) -> tuple[str, int, int] | None:
    """(entity type, start, end) of a run, or none."""
    if len(run) == 1 and ((w := run[0]).title or w.bare in lexicon.non_names):
        return None
    spelled = [w.text for w in run if not w.title and len(w.text) > 1]
    if spelled and spelled[0].isupper() and all(map(str.isupper, spelled)):
        return None  # a heading or an acronym
    bare = {w.bare for w in run}
    if not bare.isdisjoint(lexicon.org_words) and bare - lexicon.non_names - lexicon.org_words:
        return "ORGANIZATION", run[0].start, run[-1].end
    first, last = 0, len(run)
    while first < last and not run[first].title and run[first].bare in lexicon.non_names:
        first += 1
    while last > first and run[last - 1].bare in lexicon.non_names:
        last -= 1
    names = [w for w in run[first:last] if not w.title]
    if not names:
        return None
    if len(names) == 1 and not run[first].title:
        w = names[0]
        opens = w.text.lower() in lexicon.openers and SENTENCE_BEFORE.search(text[max(0, w.start - 200) : w.start] if w.start > 200 else text[: w.start])
        if len(w.text) < 2 or w.text in lexicon.stopwords or w.text.lower() in common or opens:
            return None
    return "PERSON", names[0].start, names[-1].end


def names(text: str, lexicon: Lexicon = DEFAULT) -> list[dict]:
    """Spans of persons and organisations by capitalisation."""
    common = set(LOWER_WORD.findall(text))
    out = []
    for run in name_runs(text, words_of(text, lexicon)):
        found = judged(text, run, common, lexicon)
        if found:
            kind, s, e = found
            out.append({"start": s, "end": e, "entity_type": kind, "value": text[s:e], "confidence": 0.5 if kind == "PERSON" else 0.55, "detector": "ner_heur"})
    return out


class Cover:
    """Disjoint covered ranges, ordered."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> list[tuple[int, int]]:
        """Parts of [start, end) that nothing covers."""
        out, at, k = [], start, bisect_left(self.ends, start + 1)
        while k < len(self.starts) and self.starts[k] < end:
            if self.starts[k] > at:
                out.append((at, self.starts[k]))
            at = max(at, self.ends[k])
            k += 1
        if at < end:
            out.append((at, end))
        return out

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def remainder(span: dict, start: int, end: int) -> dict | None:
    """What of a span is worth keeping in [start, end): its core from letter or digit to letter or digit."""
    part = span["value"][start - span["start"] : end - span["start"]]
    inner = [k for k, c in enumerate(part) if c.isalnum()]
    if not inner:
        return None
    core = part[inner[0] : inner[-1] + 1]
    enough = sum(map(str.isdigit, core)) >= LEAST_DIGITS if span["entity_type"] in DIGIT_TYPES else len(inner) >= LEAST_ALNUM
    return {**span, "start": start + inner[0], "end": start + inner[-1] + 1, "value": core, "detector": span["detector"] + ":remainder"} if enough else None


def resolve_overlaps(spans: list[dict]) -> list[dict]:
    """Disjoint spans in order: by confidence band (half-even tenths), then width, then confidence, then place, then emission.

    A span that loses a part keeps what is left of it.
    """
    cover, kept = Cover(), []
    for span in sorted(spans, key=lambda s: (-round(s["confidence"] * 10), s["start"] - s["end"], -s["confidence"], s["start"])):
        s, e = span["start"], span["end"]
        if s >= e:
            continue
        free = cover.free(s, e)
        if free == [(s, e)]:
            mine = [span]
        else:
            mine = [r for a, b in free if (r := remainder(span, a, b))] if len(span["value"]) == e - s else []
        for r in mine:
            cover.add(r["start"], r["end"])
        kept += mine
    return sorted(kept, key=lambda s: s["start"])


def on_lines(text: str, limit: int) -> Iterator[tuple[int, str]]:
    """(place, part) of a text in parts of at most `limit` characters, cut after line feeds where a part has one."""
    at = 0
    while at < len(text):
        end = min(at + limit, len(text))
        if end < len(text):
            end = text.rfind("\n", at, end) + 1 or end
        yield at, text[at:end]
        at = end


def asked(provider: Callable[[str], list[dict]], text: str, limit: int) -> list[dict]:
    """A model's spans of a text that may be longer than the model takes. A span that isn't in its text raises ValueError."""
    out = []
    for at, part in on_lines(text, limit):
        for s in provider(part):
            if not 0 <= s["start"] < s["end"] <= len(part):
                raise ValueError(f"a model's span from {s['start']} to {s['end']} in a text of {len(part)} characters")
            out.append({**s, "start": s["start"] + at, "end": s["end"] + at})
    return out


def disjoint(text: str, found: list[dict], use_names: bool = True, lexicon: Lexicon = DEFAULT, provider: Callable[[str], list[dict]] | None = None, provider_chars: int = 900_000) -> list[dict]:
    """All spans of one text, numbered, after names are added and overlaps resolved."""
    if use_names:
        found = [*found, *(asked(provider, text, provider_chars) if provider else []), *names(text, lexicon)]
    return [{**s, "seq": k} for k, s in enumerate(resolve_overlaps(found))]


def resolved(
    docs: DataFrame, use_names: bool = True, lexicon: Lexicon = DEFAULT, provider: Callable[[str], list[dict]] | None = None, text: str = "text", spans: str = "spans", out: str = "resolved", provider_chars: int = 900_000
) -> DataFrame:
    """`docs` with array<SPAN> of all spans after names are added and overlaps resolved; null text has no name, null spans are none.

    provider: an optional model, text to spans, whose spans come before the heuristic's; it gets at most provider_chars at once.
    """

    @arrow_pass(SPANS_SQL)
    def made(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), lists.to_pylist(), strict=True)
        kept = (disjoint(t or "", own or [], use_names, lexicon, provider, provider_chars) for t, own in rows)
        return struct_lists(([tuple(s[f] for f in SPAN_ARROW) for s in own] for own in kept), SPAN_ARROW)

    return docs.withColumn(out, made(F.col(text), F.col(spans)))


def detected(docs: DataFrame, detectors: Callable[[str], list[tuple]], use_names: bool = True, lexicon: Lexicon = DEFAULT, text: str = "text", out: str = "resolved") -> DataFrame:
    """`docs` with what `resolved` makes of the spans of `detectors`, in one pass: a task has one Python worker, and the spans before
    overlaps are resolved never leave it."""

    @arrow_pass(SPANS_SQL)
    def made(texts: pa.Array) -> pa.Array:
        found = ((t, [dict(zip(SPAN_ARROW, (k, *f), strict=True)) for k, f in enumerate(detectors(t))]) for t in (t or "" for t in texts.to_pylist()))
        kept = (disjoint(t, own, use_names, lexicon) for t, own in found)
        return struct_lists(([tuple(s[f] for f in SPAN_ARROW) for s in own] for own in kept), SPAN_ARROW)

    return docs.withColumn(out, made(F.col(text)))
