"""Round trip through an external service: sanitize, hold back what leaks, ask, restore.

The service sees doc_id and sanitized text only; the vault joins after the call.
"""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.rex import arrow_pass
from spanloom.operators.policy import Policy
from spanloom.operators.restore import restore_rows
from spanloom.operators.sanitize import finished, sanitize
from spanloom.sources.scratch import materialize


class LeakBlocked(RuntimeError):
    """A text would leak; carries its document and report."""

    def __init__(self, doc_id, report) -> None:
        super().__init__(f"document {doc_id}: {report['summary']}")
        self.doc_id, self.report = doc_id, report


def echo(text: str) -> str:
    """The service that answers with what it got."""
    return text


def dig(value, path: str):
    """What a dotted path leads to; numbers are places in lists."""
    for step in path.split(".") if path else ():
        value = value[int(step)] if isinstance(value, list) else value[step]
    return value


@dataclass
class HttpService:
    """JSON over HTTP: `payload` makes the body of a text, `answer` is the path of the reply."""

    url: str
    payload: Callable[[str], dict] = field(default=lambda text: {"text": text})
    answer: str = "text"
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 60.0

    def __call__(self, text: str) -> str:
        body = json.dumps(self.payload(text)).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            found = dig(json.load(reply), self.answer)
        if not isinstance(found, str):
            raise ValueError(f"the reply has no text at {self.answer}")
        return found


def chat_service(url: str, key: str, model: str, system: str | None = None) -> HttpService:
    """A service that speaks the usual chat-completions protocol."""
    before = [{"role": "system", "content": system}] if system else []
    make = lambda text: {"model": model, "messages": [*before, {"role": "user", "content": text}]}
    return HttpService(url.rstrip("/") + "/chat/completions", make, "choices.0.message.content", {"Authorization": f"Bearer {key}"})


def asked(texts: DataFrame, service: Callable[[str], str]) -> DataFrame:
    """(doc_id, response) of (doc_id, sanitized)."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            made = [None if t is None else service(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "response"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "sanitized").mapInArrow(batches, f"doc_id {kind}, response string")


def kept(made: DataFrame, service: Callable[[str], str], blocked: Column, text_key: Column) -> DataFrame:
    """(doc_id, text_key, blocked, edits, places, response) of sanitized rows, where no value stands in the clear: of an issued token
    there is only the place of its value in the text."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            sent = [None if t is None else service(t) for t in batch.column("sent").to_pylist()]
            rest = [n for n in batch.schema.names if n != "sent"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(sent, pa.string())], [*rest, "response"])

    edits = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("token")))
    places = F.transform("vault", lambda v: F.struct(v["token"].alias("token"), F.instr("text", v["value"]).alias("at"), F.length(v["value"]).alias("n")))
    rows = made.select("doc_id", text_key.alias("text_key"), blocked.alias("blocked"), edits.alias("edits"), places.alias("places"), F.when(~blocked, F.col("sanitized")).alias("sent"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "sent"]
    return rows.mapInArrow(batches, ", ".join([*kinds, "response string"]))


def found_again(docs: DataFrame, kept: DataFrame, text_key: Column) -> DataFrame:
    """(doc_id, original, sanitized, blocked, issued, response): the originals and values of `kept`, from the documents."""

    @arrow_pass("struct<sanitized:string,values:array<string>>")
    def again(texts: pa.Array, edits: pa.Array, places: pa.Array) -> pa.Array:
        made, values = [], []
        for text, own, at in zip(texts.to_pylist(), edits.to_pylist(), places.to_pylist(), strict=True):
            slices = [text[p["at"] - 1 : p["at"] - 1 + p["n"]] for p in at]
            vault = zip((p["token"] for p in at), slices, strict=True)
            made.append(None if text is None else finished(text, ((e["start"], e["end"], e["token"]) for e in own), vault)[0])
            values.append(slices)
        return pa.StructArray.from_arrays([pa.array(made, pa.string()), pa.array(values, pa.list_(pa.string()))], ["sanitized", "values"])

    # Always by a merge: the written table may be small where its rows aren't.
    own = docs.select("doc_id", F.col("text").alias("original"), text_key.alias("text_key")).alias("d")
    both = own.join(kept.hint("merge").alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_key") == F.col("k.text_key")))
    rows = both.select("d.doc_id", "original", "blocked", "places", "response", again("original", "edits", "places").alias("r"))
    issued = F.map_from_arrays(F.col("places")["token"], F.col("r.values"))
    return rows.select("doc_id", "original", F.col("r.sanitized").alias("sanitized"), "blocked", issued.alias("issued"), "response")


def run(docs: DataFrame, policy: Policy, service: Callable[[str], str] = echo, *, block_on_leak: bool = True, strict: bool = False, **options) -> DataFrame:
    """(doc_id, text, sanitized, response, restored, restored_tokens, invented, dropped, blocked) of every document.

    Blocked documents aren't sent: their response is null. strict raises LeakBlocked for the first of them instead.
    """
    made = sanitize(docs, policy, **options)
    if strict and block_on_leak:
        first = made.where("leak.blocked").select("doc_id", "leak").orderBy("doc_id").head(1)
        if first:
            raise LeakBlocked(first[0]["doc_id"], first[0]["leak"].asDict())
    blocked = F.col("leak.blocked") if block_on_leak else F.lit(False)
    # Replies are written once: the service is asked once for each document, whatever reads them later. With them go the places of
    # edits and values, so that documents are searched once; neither they nor what was asked holds a value, and originals are read again.
    if options.get("provider") is None:
        text_key = F.xxhash64(F.lit(uuid.uuid4().hex), F.col("text"))
        rows = found_again(docs, materialize(kept(made, service, blocked, text_key)), text_key)
    else:  # a model's values may stand nowhere in the text, so that only a second search finds them
        replies = materialize(asked(made.where(~blocked), service))
        issued = F.map_from_entries(F.transform("vault", lambda v: F.struct(v["token"], v["value"])))
        rows = made.select("doc_id", F.col("text").alias("original"), "sanitized", blocked.alias("blocked"), issued.alias("issued")).join(replies, "doc_id", "left")
    back = restore_rows(rows.withColumn("reply", F.col("response"))).withColumnRenamed("restored", "restored_tokens")
    sent = lambda c: F.when(~F.col("blocked"), F.col(c)).alias(c)
    return back.select("doc_id", F.col("original").alias("text"), "sanitized", F.col("reply").alias("response"), F.col("text").alias("restored"), *map(sent, ("restored_tokens", "invented", "dropped")), "blocked")
