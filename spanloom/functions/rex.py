"""Matches with their places, and text edits, as columns: one linear Arrow pass over the texts of a batch.

Places are code points from 0; ends are exclusive. Patterns are Python's. Only the texts and what is looked for go to the
worker, so the other columns of a row stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.schemas import MATCH_SQL

Match = tuple[int, int, str]
MATCHES = {"start": pa.int32(), "end": pa.int32(), "value": pa.string()}
#: Rows of a batch that are Python objects at one time.
SLICE = 500
#: Strings that are looked for without an automaton.
FEW = 16


def arrow_pass(kind: str) -> Callable[[Callable[..., pa.Array]], Callable[..., Column]]:
    """Decorator: an Arrow function as a column function that runs once, where it stands, over slices of a batch.

    It counts as nondeterministic, though it isn't: otherwise a filter on what it makes (every explode brings one) would run it a
    second time, below the step that deals a small table to all cores, so that one task made all of it.
    """

    def wrapped(made: Callable[..., pa.Array]) -> Callable[..., Column]:
        def sliced(*arrays: pa.Array) -> pa.Array:
            n = len(arrays[0])
            parts = [made(*(a.slice(k, SLICE) for a in arrays)) for k in range(0, n, SLICE)]
            return pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else made(*arrays)

        return F.arrow_udf(sliced, kind).asNondeterministic()

    return wrapped


def struct_lists(rows: Iterable[Sequence[tuple] | None], fields: dict[str, pa.DataType]) -> pa.Array:
    """One list of structs for each row; None gives null."""
    places, flat, missing = [0], [], []
    for row in rows:
        flat += row or ()
        missing.append(row is None)
        places.append(len(flat))
    columns = zip(*flat, strict=True) if flat else [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), structs, mask=pa.array(missing, pa.bool_()))


def rex(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches; null text gives null."""

    @arrow_pass(f"array<{MATCH_SQL}>")
    def matches(texts: pa.Array) -> pa.Array:
        find = re.compile(pattern).finditer
        return struct_lists((None if t is None else [(m.start(), m.end(), m[0]) for m in find(t)] for t in texts.to_pylist()), MATCHES)

    return matches(text)


def automaton(values: Iterable[str]) -> ahocorasick.Automaton | None:
    """Automaton of the strings, or none where there is none."""
    out = ahocorasick.Automaton()
    for v in values:
        if v:
            out.add_word(v, len(v))
    if not len(out):
        return None
    out.make_automaton()
    return out


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def places_of(text: str, values: Iterable[str]) -> Iterator[tuple[int, int]]:
    """(last place, length) of all places of each string, as an automaton has them."""
    find = text.find
    for v in values:
        n, at = len(v), find(v) if v else -1
        while at >= 0:
            yield at + n - 1, n
            at = find(v, at + 1)


def whole_hits(text: str, strings: ahocorasick.Automaton | Collection[str] | None) -> Iterator[Match]:
    """Whole-word places of the strings, disjoint, in order; where several begin at one place the longest counts.

    Strings that come without an automaton are looked for one by one if they are few, which takes less than to make one.
    """
    if strings is None:
        return
    if isinstance(strings, ahocorasick.Automaton):
        places = strings.iter(text)
    elif len(strings) <= FEW:
        places = places_of(text, strings)
    else:
        places = made.iter(text) if (made := automaton(strings)) else ()
    found: dict[int, int] = {}
    most = len(text)
    for last, n in places:
        start, end = last - n + 1, last + 1
        if start and ((c := text[start - 1]).isalnum() or c == "_"):
            continue
        if end < most and ((c := text[end]).isalnum() or c == "_"):
            continue
        if found.get(start, 0) < end:
            found[start] = end
    at = 0
    for start in sorted(found):
        if start >= at:
            at = found[start]
            yield start, at, text[start:at]


def whole_values(text: Column, values: Column) -> Column:
    """array<struct<start, end, value>> of the whole-word places of an array's strings in the text; null text or values give null."""

    @arrow_pass(f"array<{MATCH_SQL}>")
    def hits(texts: pa.Array, lists: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), lists.to_pylist(), strict=True)
        return struct_lists((None if t is None or v is None else list(whole_hits(t, automaton(v))) for t, v in pairs), MATCHES)

    return hits(text, values)


def quoted(value: Column) -> Column:
    """The value as a pattern that matches just it."""
    return F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def spliced(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """The text with ordered edits (start, end, replacement) put in; those that begin inside an earlier one are skipped."""
    out, at = [], 0
    for start, end, replacement in edits:
        if start >= at:
            out += text[at:start], replacement
            at = end
    out.append(text[at:])
    return "".join(out)


def splice(text: Column, edits: Column) -> Column:
    """The text with array<struct<start, end, replacement>> put in; edits that begin inside an earlier one are skipped."""
    bare = F.transform(edits, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["replacement"].alias("replacement")))

    @arrow_pass("string")
    def made(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), lists.to_pylist(), strict=True)
        return pa.array([None if t is None or own is None else spliced(t, sorted((e["start"], e["end"], e["replacement"]) for e in own)) for t, own in rows], pa.string())

    return made(text, bare)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two half-open ranges share a place."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def inside(a: Column, b: Column) -> Column:
    """Whether the first range lies in the second."""
    return (b["start"] <= a["start"]) & (a["end"] <= b["end"])
