"""The tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer files than cores and of so many bytes is dealt to all cores when it is read: its files may be one row group
#: each, which one task would have to take. Larger tables are never moved; their files have row groups enough.
SPREAD_FROM, SPREAD_TO = 64 << 10, 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = SPREAD_FROM <= size <= SPREAD_TO and len(rows.inputFiles()) < cores
    return rows.repartition(cores) if small else rows
