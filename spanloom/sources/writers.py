"""Sanitized documents to files, with a check of what was written; reports and review pages."""

from __future__ import annotations

import html
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.detect import BLOCKING, Detectors
from spanloom.operators.leakscan import report, scan
from spanloom.sources.pdf import pdf_bytes, wrapped  # noqa: F401
from spanloom.sources.readers import TEXT, extract


class VerificationError(RuntimeError):
    """What was written still leaks, or can't be read back."""


def verify_written(spark, path: str, vault: DataFrame | None = None, recognizers=()) -> DataFrame:
    """(doc_id, leak) of every document written to `path` that leaks."""
    back = spark.read.parquet(path).select("doc_id", F.col("text").alias("sanitized"))
    if vault is not None:
        kept = vault.groupBy("doc_id").agg(F.collect_list(F.struct("token", "entity_type", "value", "action")).alias("vault"))
        back = back.join(kept, "doc_id", "left").withColumn("vault", F.coalesce("vault", F.array().cast("array<struct<token:string,entity_type:string,value:string,action:string>>")))
        return scan(back, recognizers).where("leak.blocked").select("doc_id", "leak")
    return scan(back, recognizers, vault=None).where("leak.blocked").select("doc_id", "leak")


def write_documents(sanitized: DataFrame, path: str, *, vault: DataFrame | None = None, verify: bool = True, recognizers=()) -> None:
    """Write (doc_id, text) as Parquet, then read it back and scan it; a leak raises."""
    sanitized.select("doc_id", F.col("sanitized").alias("text")).write.mode("overwrite").parquet(path)
    if verify and (bad := verify_written(sanitized.sparkSession, path, vault, recognizers).head(1)):
        raise VerificationError(f"document {bad[0]['doc_id']}: {bad[0]['leak']['summary']}")


def docx_bytes(text: str) -> bytes:
    """A DOCX with a paragraph for each line and no metadata of a source."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    main = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    kinds = (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    )
    links = (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", kinds)
        archive.writestr("_rels/.rels", links)
        archive.writestr("word/document.xml", main)
    return out.getvalue()


def file_bytes(text: str, ext: str) -> bytes:
    """One document as a file of an extension."""
    ext = ext.lower().lstrip(".")
    if ext in ("", *TEXT):
        return text.encode("utf-8", "replace")
    if ext == "docx":
        return docx_bytes(text)
    if ext == "pdf":
        return pdf_bytes(text)
    raise ValueError(f"can't write {ext!r} files")


def checked_file(text: str, ext: str, values: list[str], detectors: Detectors) -> tuple[bytes, str | None]:
    """A document as a file of an extension, and what leaks in it when it is read back; lines of a PDF are read as one."""
    data = file_bytes(text, ext)
    back = extract(data, ext or "txt", "never")[0]
    clean, _, _, _, summary = report(back.replace("\n", " ") if ext == "pdf" else back, values, detectors)
    return data, None if clean else summary


def rendered(sanitized: DataFrame, recognizers=()) -> DataFrame:
    """(doc_id, ext, content, leaks, error) of (doc_id, sanitized, vault, ext): each document as a file, read back and scanned where it is made."""
    detectors = Detectors(recognizers, None, least=BLOCKING)
    kinds = [pa.string(), pa.binary(), pa.string(), pa.string()]

    def one(text: str | None, vault: list[dict] | None, ext: str) -> tuple:
        try:
            return ext, *checked_file(text or "", ext, [v["value"] for v in vault or ()], detectors), None
        except ValueError as wrong:  # one document that can't be such a file doesn't end the job; it is reported
            return ext, None, None, str(wrong)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            rows = [one(*(c[k].as_py() for c in batch.columns[1:])) for k in range(batch.num_rows)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "ext", "content", "leaks", "error"])

    source = sanitized.select("doc_id", "sanitized", "vault", F.lower(F.ltrim(F.col("ext"), F.lit("."))).alias("ext"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(batches, f"doc_id {kind}, ext string, content binary, leaks string, error string")


def write_file(path: str, text: str, values: list[str] = (), recognizers=(), verify: bool = True) -> None:
    """One document as a file by the extension of its path; a leak in what is read back raises before anything is written."""
    ext = os.path.splitext(path)[1].lower().lstrip(".")
    data, leaks = checked_file(text, ext, list(values), Detectors(recognizers, None, least=BLOCKING))
    if verify and leaks:
        raise VerificationError(leaks)
    with open(path, "wb") as file:
        file.write(data)


def json_report(sanitized: DataFrame) -> DataFrame:
    """(doc_id, report): counters, entities and leak report as JSON; values stay out of it."""
    entity = F.transform("entities", lambda e: F.struct(e["entity_type"].alias("type"), e["replacement"].alias("token"), e["action"].alias("action"), F.size(e["members"]).alias("mentions"), F.bround(e["confidence"], 2).alias("confidence")))
    return sanitized.select("doc_id", F.to_json(F.struct("num_tokenized", "num_redacted", entity.alias("entities"), F.col("leak.clean").alias("clean"), F.col("leak.summary").alias("leaks"))).alias("report"))


PAGE = """<!doctype html><meta charset="utf-8"><title>@@TITLE@@</title>
<style>mark{background:#fe8}mark.unsure{background:#f9a}</style>
<h1>@@TITLE@@</h1><p class="leak">@@LEAK@@</p><p class="risk">@@RISK@@</p><pre>@@BODY@@</pre>
<script type="application/json" id="spans">@@DATA@@</script>
"""


def filled(template: str, slots: dict[str, str]) -> str:
    """The template with its @@NAME@@ slots filled in one pass, so that a value is never read as a slot; a slot without a value raises KeyError."""
    return re.sub(r"@@([A-Z_]+)@@", lambda m: slots[m[1]], template)


def review_page(text: str, edits: list[dict], leak: str, risk: str, title: str = "Review", unsure: float = 0.6) -> str:
    """A page that marks every edit; data for scripts can't close its element."""
    out, at = [], 0
    for e in edits:
        out.append(html.escape(text[at : e["start"]]))
        mark = "unsure" if e["confidence"] < unsure else "sure"
        out.append(f'<mark class="{mark}" title="{html.escape(e["replacement"])}">{html.escape(text[e["start"] : e["end"]])}</mark>')
        at = e["end"]
    out.append(html.escape(text[at:]))
    data = json.dumps(edits).replace("<", "\\u003c")
    return filled(PAGE, {"TITLE": html.escape(title), "LEAK": html.escape(leak), "RISK": html.escape(risk), "BODY": "".join(out), "DATA": data})
