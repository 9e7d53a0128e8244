"""Scores of detections against gold spans, by interval joins within a document.

gold and predicted are span tables: doc_id, start, end, entity_type (gold also value and whatever it is grouped by).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.rex import arrow_pass, struct_lists

# Types that count as one another.
FAMILIES = {"DOB": "DATE", "PATIENT_ID": "GOV_ID", "CASE_ID": "GOV_ID", "ACCOUNT_ID": "GOV_ID"}


def family(entity_type: Column) -> Column:
    out = entity_type
    for name, head in FAMILIES.items():
        out = F.when(entity_type == name, head).otherwise(out)
    return out


def _touch(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(1.0)


def overlap_recall(gold: DataFrame, predicted: DataFrame, by: str | None = None) -> DataFrame:
    """([by,] n_gold, n_covered, recall): gold spans that any prediction touches; with `by` also the total, where it is null."""
    hit = gold.alias("g").join(predicted.alias("p"), _touch("g", "p"), "left_semi").withColumn("hit", F.lit(1))
    miss = gold.alias("g").join(predicted.alias("p"), _touch("g", "p"), "left_anti").withColumn("hit", F.lit(0))
    rows = hit.unionByName(miss)
    grouped = rows.rollup(by) if by else rows.groupBy()
    out = grouped.agg(F.count("*").alias("n_gold"), F.sum("hit").alias("n_covered"))
    return out.withColumn("recall", _ratio(F.col("n_covered"), F.col("n_gold")))


def overlap_precision(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(n_predicted, n_right, precision): predictions that touch any gold span."""
    hit = predicted.alias("p").join(gold.alias("g"), _touch("p", "g"), "left_semi").select(F.lit(1).alias("hit"))
    miss = predicted.alias("p").join(gold.alias("g"), _touch("p", "g"), "left_anti").select(F.lit(0).alias("hit"))
    out = hit.unionByName(miss).agg(F.count("*").alias("n_predicted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_right"))
    return out.withColumn("precision", _ratio(F.col("n_right"), F.col("n_predicted")))


def typed_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(entity_type, n_gold, n_found, n_typed, recall, type_accuracy): found by any touch, typed right within families of types."""
    pairs = gold.alias("g").join(predicted.alias("p"), _touch("g", "p"), "left")
    right = F.coalesce(F.max((family(F.col("p.entity_type")) == family(F.col("g.entity_type"))).cast("int")), F.lit(0))
    each = pairs.groupBy("g.doc_id", "g.start", "g.end", "g.entity_type").agg(F.max(F.col("p.start").isNotNull().cast("int")).alias("found"), right.alias("typed"))
    out = each.groupBy("entity_type").agg(F.count("*").alias("n_gold"), F.sum("found").alias("n_found"), F.sum("typed").alias("n_typed"))
    return out.withColumns({"recall": _ratio(F.col("n_found"), F.col("n_gold")), "type_accuracy": _ratio(F.col("n_typed"), F.col("n_found"))})


def joined_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order; those that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def coverage(spans: DataFrame) -> DataFrame:
    """(doc_id, covered): each document's spans as disjoint ranges in order."""

    @arrow_pass("array<struct<start:int,end:int>>")
    def made(lists: pa.Array) -> pa.Array:
        return struct_lists((joined_ranges((x["start"], x["end"]) for x in own) for own in lists.to_pylist()), {"start": pa.int32(), "end": pa.int32()})

    return spans.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("s")).select("doc_id", made("s").alias("covered"))


WORD, EDGES = re.compile(r"\S+"), re.compile(r"^\W+|\W+$")


def words_left(value: str, start: int, covered: list[dict], ignore: frozenset[str]) -> tuple[int, int]:
    """Words of a gold span's value, and those with a letter or digit that no range covers."""
    n = left = 0
    ends = [c["end"] for c in covered]
    for m in WORD.finditer(value):
        core = EDGES.sub("", m[0])
        if not core or core.lower() in ignore:
            continue
        n += 1
        k = bisect_right(ends, start + m.start())
        for at, char in enumerate(m[0], start + m.start()):
            while k < len(covered) and ends[k] <= at:
                k += 1
            if char.isalnum() and not (k < len(covered) and covered[k]["start"] <= at):
                left += 1
                break
    return n, left


def leaked_words(gold: DataFrame, predicted: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, start, end, n_words, n_leaked) of every gold span: its words, and those with a letter or digit that nothing covers.

    Words are runs without blanks, without punctuation at their ends; words in `ignore` don't count.
    """
    never = frozenset(ignore)

    @arrow_pass("struct<n_words:long,n_leaked:long>")
    def made(values: pa.Array, starts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = [words_left(v or "", s, own or [], never) for v, s, own in zip(values.to_pylist(), starts.to_pylist(), lists.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], ["n_words", "n_leaked"])

    joined = gold.join(coverage(predicted), "doc_id", "left")
    return joined.select("doc_id", "start", "end", made("value", "start", "covered").alias("r")).select("doc_id", "start", "end", "r.*")


def leakage(gold: DataFrame, predicted: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(n_words, n_leaked, leak_rate, n_spans, n_full, full_recall) over all gold spans that have a word."""
    each = leaked_words(gold, predicted, ignore).where("n_words > 0")
    out = each.agg(
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"),
        F.coalesce(F.sum("n_leaked"), F.lit(0)).alias("n_leaked"),
        F.count("*").alias("n_spans"),
        F.count_if(F.col("n_leaked") == 0).alias("n_full"),
    )
    return out.withColumns({"leak_rate": F.when(F.col("n_words") > 0, F.round(F.col("n_leaked") / F.col("n_words"), 6)).otherwise(0.0), "full_recall": _ratio(F.col("n_full"), F.col("n_spans"))})


def strong_identifier_leaks(gold: DataFrame, predicted: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Gold spans of strong types that aren't wholly covered: a gate wants none."""
    return leaked_words(gold.where(F.col("entity_type").isin(*types)), predicted).where("n_leaked > 0")


def fixture_benchmark(sanitized: DataFrame, fixtures: DataFrame, restored: DataFrame) -> DataFrame:
    """One row: recall and leak rate of the strings that must go, share of exact round trips, share of blocked texts."""
    secret = fixtures.select("doc_id", F.explode("must_remove").alias("secret")).join(sanitized.select("doc_id", "sanitized"), "doc_id")
    same = fixtures.select("doc_id", F.col("text").alias("original")).join(restored.select("doc_id", "text"), "doc_id")
    rows = (
        secret.select(F.lit("n_secrets").alias("what"), (~F.col("sanitized").contains(F.col("secret"))).alias("ok"))
        .unionByName(same.select(F.lit("n_docs").alias("what"), (F.col("original") == F.col("text")).alias("ok")))
        .unionByName(sanitized.select(F.lit("n_scanned").alias("what"), F.col("leak.clean").alias("ok")))
    )
    n = lambda what: F.count_if(F.col("what") == what)
    good = lambda what: F.count_if((F.col("what") == what) & F.col("ok"))
    out = rows.agg(n("n_secrets").alias("n_secrets"), good("n_secrets").alias("n_removed"), n("n_docs").alias("n_docs"), good("n_docs").alias("n_exact"), (n("n_scanned") - good("n_scanned")).alias("n_blocked"))
    return out.withColumns({"recall": _ratio(F.col("n_removed"), F.col("n_secrets")), "round_trip": _ratio(F.col("n_exact"), F.col("n_docs"))})


def wild_report(spans: DataFrame, by: str, top: int = 6) -> DataFrame:
    """(by, entity_type, value, n, place): the `top` most frequent values of each type and group. A report, so the rest is left out."""
    from pyspark.sql import Window

    counts = spans.groupBy(by, "entity_type", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy(by, "entity_type").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
