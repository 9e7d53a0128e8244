"""Leak scan of outgoing text: known values that survive, and fresh detections outside tokens."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.rex import arrow_pass, automaton, inside, is_word, quoted
from spanloom.operators.detect import BLOCKING, Detectors
from spanloom.operators.recognizers import Recognizer
from spanloom.operators.tokens import TOKEN_FINDER, find_tokens
from spanloom.schemas import SPAN_ARROW, SPANS_SQL

REPORT = {"clean": pa.bool_(), "blocked": pa.bool_(), "residual": pa.list_(pa.struct(list(SPAN_ARROW.items()))), "leaked": pa.list_(pa.string()), "summary": pa.string()}
REPORT_SQL = f"struct<clean:boolean,blocked:boolean,residual:{SPANS_SQL},leaked:array<string>,summary:string>"
LEAST_VALUE = 2


def present_as_token(value: Column, text: Column) -> Column:
    """Whether the value stands in the text, whole on those edges where it has a word character."""
    left = F.when(value.rlike(r"(?U)^[\p{IsAlphabetic}\p{N}_]"), F.lit(r"(?<![\p{IsAlphabetic}\p{N}_])")).otherwise("")
    right = F.when(value.rlike(r"(?U)[\p{IsAlphabetic}\p{N}_]$"), F.lit(r"(?![\p{IsAlphabetic}\p{N}_])")).otherwise("")
    return F.regexp_like(text, F.concat(left, quoted(value), right))


def present(text: str, values: Iterable[str]) -> list[str]:
    """Those of the values that present_as_token finds, sorted; one pass over the text."""
    strings, found = automaton(values), set()
    for last, n in strings.iter(text) if strings else ():
        start, end = last - n + 1, last + 1
        before = start and is_word(text[start]) and is_word(text[start - 1])
        after = end < len(text) and is_word(text[last]) and is_word(text[end])
        if not before and not after:
            found.add(text[start:end])
    return sorted(found)


def report(text: str, values: Iterable[str], detectors: Detectors) -> tuple:
    """A row of REPORT. Spans inside a token, and known values of one character, don't count."""
    tokens = [m.span() for m in TOKEN_FINDER.finditer(text)]
    residual, at = [], 0
    for k, f in enumerate(sorted(detectors(text), key=lambda x: x[0])):
        while at < len(tokens) and tokens[at][1] <= f[0]:
            at += 1
        if not (at < len(tokens) and tokens[at][0] <= f[0] and f[1] <= tokens[at][1]):
            residual.append(dict(zip(SPAN_ARROW, (k, *f), strict=True)))
    leaked = present(text, (v for v in values if len(v) >= LEAST_VALUE))
    clean = not residual and not leaked
    return clean, not clean, residual, leaked, "clean" if clean else f"{len(residual)} residual spans, {len(leaked)} leaked values"


def scan(docs: DataFrame, recognizers: Sequence[Recognizer] = (), threshold: float = BLOCKING, text: str = "sanitized", vault: str | None = "vault") -> DataFrame:
    """`docs` with `leak`: struct<clean, blocked, residual, leaked, summary>. Null text is clean."""
    detectors = Detectors(recognizers, None, least=threshold)

    @arrow_pass(REPORT_SQL)
    def made(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = [report(t or "", own or (), detectors) for t, own in zip(texts.to_pylist(), lists.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(REPORT.values())], list(REPORT))

    values = F.filter(F.transform(vault, lambda v: v["value"]), lambda v: v.isNotNull()) if vault else F.array().cast("array<string>")
    return docs.withColumn("leak", made(F.col(text), values))


def verify(docs: DataFrame, policy=None, text: str = "text") -> DataFrame:
    """(doc_id, entity_type, n): entities still in a text that are in no token, whatever the policy; entities with any member in a token are left out."""
    from spanloom.operators.detect import detect
    from spanloom.operators.kernel import resolved
    from spanloom.operators.resolve import entity_column

    rows = docs.select("doc_id", F.col(text).alias("text"))
    spans = resolved(detect(rows, policy.recognizers if policy else ())).drop("spans")
    found = spans.select("doc_id", entity_column(F.col("resolved")).alias("entities"), find_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    open_ = F.filter("entities", lambda e: ~F.exists(e["members"], lambda m: F.exists("tokens", lambda t: inside(m, t))))
    return found.select("doc_id", F.inline(open_)).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))
