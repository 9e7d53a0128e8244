"""Tokens: [[TYPE_NNN]], and the registry that gives an entity one token in all documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.rex import rex

# A token's shape.
TOKEN = r"\[\[([A-Z][A-Z_]*)_(\d{3,})\]\]"
REDACTED = "[REDACTED]"
TOKEN_FINDER = re.compile(TOKEN)


def make_token(entity_type: Column, index: Column) -> Column:
    """Null where the type or the index has no token."""
    return F.when(entity_type.rlike("^[A-Z][A-Z_]*$") & (index >= 1), F.format_string("[[%s_%03d]]", entity_type, index))


def token_of(entity_type: str, index: int) -> str:
    """make_token of one entity."""
    return f"[[{entity_type}_{index:03d}]]"


def parse_token(token: Column) -> Column:
    """struct<entity_type, index>, or null."""
    whole = f"^{TOKEN}$"
    return F.when(token.rlike(whole), F.struct(F.regexp_extract(token, whole, 1).alias("entity_type"), F.regexp_extract(token, whole, 2).cast("int").alias("index")))


def find_tokens(text: Column) -> Column:
    """array<struct<start, end, value>> of the tokens in a text."""
    return rex(text, TOKEN)


def registry(entities: DataFrame, order: str = "doc_id") -> DataFrame:
    """(entity_type, norm, token, first_doc): one token for each type and value over all documents, in the order of first appearance.

    Values are compared without case and with blanks collapsed. First appearances come from partial minima; ranks are
    computed in ranges of the order with running counts for each range, so no type is gathered in one task.
    """
    norm = F.regexp_replace(F.lower(F.trim("canonical")), r"(?U)\s+", " ")
    firsts = entities.groupBy("entity_type", norm.alias("norm")).agg(F.min(F.struct(F.col(order).alias("doc"), "first")).alias("at"))
    spread = firsts.repartitionByRange("entity_type", "at", "norm").withColumn("part", F.spark_partition_id())
    # Both branches below must see the same parts, so these are fixed once; the plan has no place where they could differ.
    spread = spread.persist()
    within = F.row_number().over(Window.partitionBy("part", "entity_type").orderBy("at", "norm"))
    earlier = Window.partitionBy("entity_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy("entity_type", "part").count().select("entity_type", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    ranked = spread.withColumn("n", within).join(bases, ["entity_type", "part"])
    return ranked.select("entity_type", "norm", make_token(F.col("entity_type"), F.col("base") + F.col("n")).alias("token"), F.col("at.doc").alias("first_doc"))
