"""A corpus pipeline: toxicity, exact, near and substring deduplication, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from spanloom.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns from the labels of `docs`.

    Null and empty texts score like any other, rows with a null doc_id never train, repeated rows score alike, and an empty table
    gives an empty one.
    """
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, COLUMNS[1:]).where("score < 0.5").select(COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays; of rows that also share its doc_id, the least by the other columns.

    Null texts are equal to empty ones, and a null doc_id ranks before all others. An empty table gives an empty one.
    """
    kept = exact_dedup.exact_groups(docs.select(COLUMNS), COLUMNS[1:], hash_all=False, ties=True).where("kept")
    again = kept.where("ties > 1").groupBy("text_sha256").agg(F.min(F.struct(COLUMNS)).alias("row")).select("row.*")
    return kept.where("ties = 1").select(COLUMNS).unionByName(again)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 at least) the smallest doc_id stays, null before all others.

    Texts without a word are near copies of each other. Rows that repeat a doc_id stay or go together. An empty table gives an empty one.
    """
    docs = docs.select(COLUMNS)
    later = near_dedup.near_copies(docs).where(~F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("later_id")).distinct()
    later = materialize(later)  # its size is known then, and texts move only if it is large
    return docs.join(later, F.col("doc_id").eqNullSafe(F.col("later_id")), "left_anti").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what occurred earlier; a document of which nothing is left goes. Characters stay whole.

    Null and empty texts have nothing to lose and stay. Rows that repeat a doc_id are versions of one document. An empty table gives
    an empty one.
    """
    docs = docs.select(COLUMNS)
    cut = suffix_dedup.dedup(docs, ["lang", "source"])
    left = cut.where("n_removed = 0 or kept_text != ''").withColumn("n_chars", F.length("kept_text").cast("long"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", "n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of token ids; null and empty texts have one id. An empty table gives no piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Learned scores, hashes and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
