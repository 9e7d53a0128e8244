"""Restoring originals in untrusted replies: only issued tokens resolve; invented ones stay and are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.rex import rex, splice
from spanloom.operators.tokens import find_tokens

# A token with blanks and escapes inside, and what its inner part must look like then.
REGION = r"\\?\[\s*\\?\[([^\[\]]{1,64}?)\\?\]\s*\\?\]"
INNER = r"^([A-Z][A-Z_]*)_(\d{3,})$"


def _issued(vault: DataFrame, keys: list[str]) -> DataFrame:
    """One map of tokens to values for each document (or session). A token with several values stands for none of them:
    it is as if it had not been issued, so nobody's value comes back in another's place."""
    first = vault.groupBy(*keys, "token").agg(F.min("value").alias("value"), F.max("value").alias("other")).where("value = other")
    return first.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("issued"))


def _with_issued(replies: DataFrame, vault: DataFrame, keys: list[str]) -> DataFrame:
    return replies.join(_issued(vault, keys), keys, "left").withColumn("issued", F.coalesce("issued", F.create_map().cast("map<string,string>")))


def _report(rows: DataFrame, text: Column, seen: Column) -> DataFrame:
    known = F.map_keys("issued")
    return rows.select(
        *[c for c in rows.columns if c not in ("issued", "regions", "response", "seen")],
        text.alias("text"),
        F.filter(seen, lambda t: F.array_contains(known, t)).alias("restored"),
        F.filter(seen, lambda t: ~F.array_contains(known, t)).alias("invented"),
        F.array_sort(F.array_except(known, seen)).alias("dropped"),
    )


def restore_rows(rows: DataFrame) -> DataFrame:
    """Rows (response, issued: map of tokens to values, and other columns) with text, restored, invented and dropped for them."""

    def region(m: Column) -> Column:
        inner = F.translate(F.regexp_extract(m["value"], "(?U)" + REGION, 1), "\\ \t", "")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("raw"), F.when(inner.rlike("(?U)" + INNER), F.concat(F.lit("[["), inner, F.lit("]]"))).alias("token"))

    found = F.filter(F.transform(rex(F.col("response"), REGION), region), lambda r: r["token"].isNotNull())
    rows = rows.withColumn("regions", F.coalesce(found, F.array().cast("array<struct<start:int,end:int,raw:string,token:string>>")))
    edits = F.transform("regions", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.coalesce(F.try_element_at("issued", r["token"]), r["raw"]).alias("replacement")))
    return _report(rows, splice(F.col("response"), edits), F.array_distinct(F.transform("regions", lambda r: r["token"])))


def restore(replies: DataFrame, vault: DataFrame, on: str = "doc_id") -> DataFrame:
    """(on, text, restored, invented, dropped) of each reply (on, response).

    A token may have blanks inside and escaped brackets or underscores. restored and invented are in order of first
    appearance, dropped is sorted. Null replies stay null.
    """
    return restore_rows(_with_issued(replies.select(on, "response"), vault, [on]))


def validate_response(replies: DataFrame, vault: DataFrame, on: str = "doc_id") -> DataFrame:
    """The same report without a change, for tokens in their strict shape only."""
    rows = _with_issued(replies.select(on, "response"), vault, [on])
    seen = F.array_distinct(F.transform(F.coalesce(find_tokens(F.col("response")), F.array().cast("array<struct<start:int,end:int,value:string>>")), lambda m: m["value"]))
    return _report(rows.withColumn("seen", seen), F.col("response"), F.col("seen"))


def summary(restored: Column, invented: Column, dropped: Column) -> Column:
    """One line about a restored reply."""
    return F.concat_ws(
        "; ",
        F.format_string("restored %d", F.size(restored)),
        F.when(F.size(invented) > 0, F.format_string("INVENTED %d (not restored): %s", F.size(invented), F.array_join(invented, ", "))),
        F.when(F.size(dropped) > 0, F.format_string("dropped %d", F.size(dropped))),
    )


def has_anomalies(invented: Column, dropped: Column) -> Column:
    return (F.size(invented) > 0) | (F.size(dropped) > 0)
