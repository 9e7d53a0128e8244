"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.scratch import drop  # noqa: F401
from spanloom.sources.scratch import materialize as write_and_read
from spanloom.sources.tables import table  # noqa: F401

#: Stands for a null id inside the operators; the rows of the input keep their null.
NULL_ID = -(2**63)


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here, and a lost
    executor costs only a new read."""
    out = write_and_read(df)
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch, where the session has Spark's default: whole documents are long, and a batch of 10,000 takes tens of
#: megabytes on both sides of every running task.
BATCH_SETTING, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: What a worker keeps between tasks, and the operator (its module) that the last task was of.
_CACHES: list[dict] = []
_LAST = [""]


def worker_cache() -> dict:
    """A dict for what a worker keeps between tasks; it is emptied when a task of another operator begins."""
    _CACHES.append({})
    return _CACHES[-1]


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(batches: Batches) -> Batches:
    """A mapper whose worker gives back what a task's arrays took: an idle worker holds its operator's caches and no more, and gives
    up those too before a task of another operator. The session's Arrow batches become shorter, unless it has a setting of its own."""
    session = SparkSession.getActiveSession()
    if session and session.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        session.conf.set(BATCH_SETTING, BATCH_ROWS)

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _LAST[0] != batches.__module__:
            _LAST[0] = batches.__module__
            for cache in _CACHES:
                cache.clear()
            _give_back()
        try:
            yield from batches(them)
        finally:
            _give_back()

    return run


def id_key(column: Column) -> Column:
    """The id as a long without nulls."""
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; such rows never train a model. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(i, text, y) of at most `bound` labelled training rows of each class, those with the smallest hash of the id.

    Rows whose id is null or held out, whose label is null, or whose text is null never train. A label that
    an id has more than once counts once, as its largest; an id that several rows have trains once, with the text of least hash.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label).cast("int").alias("y"))
        .where("i is not null and y is not null")
        .where(~held_out(F.col("i")))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
    )
    order = (F.xxhash64("i"), F.col("i"))
    chosen = marks.where("y = 1").orderBy(*order).limit(bound).unionByName(marks.where("y = 0").orderBy(*order).limit(bound))
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), "text").where("text is not null")
    # `chosen` has at most 2 x bound rows of two numbers, so it is always small enough to send to every task.
    return texts.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("i", "text", "y")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; TOKENIZER_DIR names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
