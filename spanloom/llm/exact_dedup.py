"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they agree after deleting ASCII white space. Lengths that occur once decide their rows; of the
rest, prefix hashes that occur once within a length decide theirs; only rows that still share both are grouped by their
full hash. All groups are counted by partial sums, and what joins back is one row for each group with company, so a group
of many copies is never gathered: its rows stay where they are, and the join's large side can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialize

PREFIX = 64
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def survivors(rows: DataFrame) -> DataFrame:
    """(size, head) that several rows share, found length by length, then by prefix hash within a length.

    Rows are counted by partial sums first, so many copies of a text are one row in the join on lengths.
    """
    pairs = rows.groupBy("size", "head").agg(F.count("*").alias("n"))
    sizes = pairs.groupBy("size").agg(F.sum("n").alias("all")).where("all > 1")
    return pairs.join(sizes, "size", "left_semi").where("n > 1").select("size", "head")


def exact_groups(docs: DataFrame, carry: list[str] = (), prefix: int = PREFIX, hash_all: bool = True, ties: bool = False) -> DataFrame:
    """Each row with keep_id, group_size, kept, text_sha256 and the columns of `carry`.

    Of equal texts, the row with the most code points in the original text, then the smallest doc_id stays. Null counts as
    empty, and all empty texts are equal. A null doc_id ranks before all others and is a null keep_id. Of rows that agree in
    text and doc_id all are kept or dropped alike, as nothing tells them apart. An empty table gives an empty one.

    hash_all: text_sha256 is wanted for every row, so the one pass over the text takes it along; else it is null for
    rows decided before, and the full content is hashed for survivors alone.
    ties: adds that column, how many rows the group keeps.
    """
    names = [f"c{k}" for k in range(len(carry))]
    carried = [F.col(f"`{x}`").alias(name) for name, x in zip(names, carry, strict=True)]
    norm, sha = normalised(F.col("text")), F.sha2(normalised(F.col("text")).cast("binary"), 256)
    points = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = docs.select(F.col("doc_id").cast("long").alias("id"), points.alias("points"), F.col("text"), F.length(norm).alias("size"), F.xxhash64(F.substring(norm, 1, prefix)).alias("head"), *carried)
    kind = ["id", "points", "size", "head"]
    if hash_all:
        # Only digests are grouped; they are written once, so that no level reads the texts again.
        digests = materialize(base.select(*kind, sha.alias("full")))
        left = digests.join(survivors(digests), ["size", "head"], "left_semi")
        rows = base.select(*kind, sha.alias("full"), *names) if carry else digests
    else:
        # Written, so that the planner knows their sizes: small ones go to the texts, and texts move only to large ones.
        live = materialize(survivors(base.select("size", "head")).withColumn("hit", F.lit(True)))
        marked = base.join(live, ["size", "head"], "left").select(*kind, F.when(F.col("hit"), sha).alias("full"), *names)
        left, rows = marked.where("full is not null").select(*kind, "full"), marked
    # Orders of structs have nulls first.
    best = F.min(F.struct((-F.col("points")).alias("most"), F.col("id").alias("first"), F.col("equal").alias("ties")))
    equal = left.groupBy("size", "head", "full", "points", "id").agg(F.count("*").alias("equal"))
    groups = equal.groupBy("size", "head", "full").agg(F.sum("equal").alias("n"), best.alias("best")).where("n > 1")
    groups = materialize(groups.select("size", "head", "full", "n", "best.most", "best.first", "best.ties"))
    joined = rows.join(groups, ["size", "head", "full"], "left")
    grouped = F.col("n").isNotNull()
    mine = (F.col("points") == -F.col("most")) & F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(grouped, F.col("first")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, mine).otherwise(True).alias("kept"),
        F.col("full").alias("text_sha256"),
        *([F.coalesce(F.col("ties"), F.lit(1)).alias("ties")] if ties else []),
        *[F.col(a).alias(x) for a, x in zip(names, carry, strict=True)],
    )


def op6(docs: DataFrame) -> DataFrame:
    """Query form: keep_id, group_size, kept and text_sha256 of every document."""
    return exact_groups(docs)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS n, min((-points, doc_id)) AS best FROM t GROUP BY norm
)
SELECT t.doc_id, g.best[2] AS keep_id, g.n AS group_size, g.best[1] = -t.points AND g.best[2] = t.doc_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
