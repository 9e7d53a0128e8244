"""Sanitising a stream of documents.

Detection, overlap resolution and the leak scan keep no state between documents, so they run on a stream as they are.
Entities of a document are resolved by aggregation, which a micro-batch does within itself: a document is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.detect import detect
from spanloom.operators.kernel import resolved
from spanloom.operators.policy import Policy
from spanloom.operators.sanitize import sanitize, vault_of


def detected(stream: DataFrame, recognizers=(), use_names: bool = True) -> DataFrame:
    """A streaming (doc_id, text) with `resolved` spans; no state."""
    return resolved(detect(stream.select("doc_id", "text"), recognizers), use_names).drop("spans")


def start(stream: DataFrame, policy: Policy, texts: str, vault: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Sanitize every micro-batch and append its texts and its vault to two separate tables.

    Of blocked documents only the reports are written, beside the texts. A batch that is run again after a
    failure overwrites its own part, so nothing is written twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        made = sanitize(batch, policy).persist()
        try:
            made.where("leak.clean").select("doc_id", "sanitized").write.mode("overwrite").parquet(f"{texts}/batch={number}")
            made.where("leak.blocked").selectExpr("doc_id", "leak.summary").write.mode("overwrite").parquet(f"{texts}-blocked/batch={number}")
            vault_of(made.where("leak.clean")).write.mode("overwrite").parquet(f"{vault}/batch={number}")
            if on_batch:
                on_batch(made, number)
        finally:
            made.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
