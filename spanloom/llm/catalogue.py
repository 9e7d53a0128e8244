"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import binpack, bpe, exact_dedup, line_crf, line_quality, packing, simhash, suffix_dedup, toxicity, url_filter
from spanloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[..., DataFrame], *more: str) -> Query:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in (name, *more)))


def op2(docs: DataFrame) -> DataFrame:
    """Query form of best-fit-decreasing packing: the matrices of every sequence, and which pieces lie in it."""
    return binpack.matrices(binpack.pack(docs, keep_ids=True, narrow=True), narrow=True)


def queries() -> dict[str, Query]:
    return {
        "op1_url_language_ratio": _over("pages", url_filter.op1),
        "op2_best_fit_packing": _over("documents", op2),
        "op3_line_quality": _over("documents", line_quality.op3),
        "op4_simhash": _over("documents", simhash.op4),
        "op5_ordered_packing": _over("documents", packing.pack),
        "op6_exact_dedup": _over("documents", exact_dedup.op6),
        "op7_toxicity": _over("documents", toxicity.op7, "labels"),
        "op8_suffix_dedup": _over("documents", suffix_dedup.op8),
        "op9_byte_bpe": _over("documents", bpe.digests),
        "op10_line_crf": _over("documents", line_crf.op10, "labels"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_quality": line_quality.ORACLE_SQL, "op6_exact_dedup": exact_dedup.ORACLE_SQL}
