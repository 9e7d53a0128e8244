"""Re-identification risk: quasi-identifiers that stay in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.rex import rex

# Categories and what shows them.
CATEGORIES = {
    "age": r"(?i)\b(?:aged\s+)?\d{1,3}[\s\-]?(?:years?[\s\-]old|-?year-?old|yo)\b",
    "occupation": (
        r"(?i)\b(?:ceo|cto|cfo|coo|founder|co-founder|president|vice[\s-]president|director|manager|head of|chief|professor|dean|surgeon|physician|"
        r"consultant|judge|magistrate|mayor|minister|senator|governor|ambassador|chairman|chairwoman|chairperson|partner|principal|superintendent|"
        r"commissioner|bishop|rabbi|imam)\b"
    ),
    "uniqueness": (
        r"(?i)\b(?:the\s+only|the\s+first|the\s+sole|sole\s+survivor|only\s+person|survived\s+the|survivor\s+of|won\s+the|awarded\s+the|holder\s+of|"
        r"famous\s+for|known\s+for|convicted\s+of|accused\s+of)\b"
    ),
    "sensitive-status": (
        r"(?i)\b(?:diagnosed\s+with|suffers?\s+from|HIV|cancer|schizophreni\w+|pregnan\w+|disab\w+|refugee|asylum|whistleblow\w+|LGBTQ?\+?)\b"
    ),
}


def findings(text: Column) -> Column:
    """array<struct<category, text, start, end>>."""
    one = lambda name, p: F.transform(rex(text, p), lambda m: F.struct(F.lit(name).alias("category"), m["value"].alias("text"), m["start"].alias("start"), m["end"].alias("end")))
    return F.concat(*[one(name, p) for name, p in CATEGORIES.items()])


def level(categories: Column) -> Column:
    """none, low, medium or high by how many categories meet; sensitive status alone is medium."""
    n = F.size(categories)
    return F.when(n == 0, "none").when(n >= 3, "high").when((n == 2) | F.array_contains(categories, "sensitive-status"), "medium").otherwise("low")


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, level, categories (sorted), findings and summary of each row; null text has none."""
    none = F.array().cast("array<struct<category:string,text:string,start:int,end:int>>")
    rows = docs.select("doc_id", F.coalesce(findings(F.col(text)), none).alias("findings"))
    rows = rows.withColumn("categories", F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["category"]))))
    words = F.when(F.size("categories") == 0, "no quasi-identifiers").otherwise(F.concat(F.lit("quasi-identifiers: "), F.concat_ws(", ", "categories")))
    return rows.select("doc_id", level(F.col("categories")).alias("level"), "categories", "findings", words.alias("summary"))
