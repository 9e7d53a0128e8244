"""Documents from files: text, bytes by extension, DOCX, plain PDF, and hooks for other PDF readers and for image text."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources import ocr as ocr_engines
from spanloom.sources.pdf import pdf_pages

# Extensions by kind, and characters of a page below which it looks scanned.
TEXT = ("txt", "md", "text", "csv", "tsv", "log", "json")
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
DOCUMENTS = ("docx", "pdf")
OCR_MODES = ("auto", "never", "always")
SCANNED_CHARS = 16

#: (page or image bytes) to text; (pdf bytes) to the text of each page, and to an image of each page.
ImageReader = Callable[[bytes], str]
PdfReader = Callable[[bytes], list[str]]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, what isn't valid replaced."""
    return F.make_valid_utf8(content.cast("string"))


def looks_scanned(text: Column, pages: Column | int = 1) -> Column:
    """Whether a document has too few characters for its pages to have a text layer."""
    n = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    return n < SCANNED_CHARS * F.greatest(F.lit(1), pages if isinstance(pages, Column) else F.lit(pages))


def without_markers(text: Column, start: str = "*** START OF", end: str = "*** END OF") -> Column:
    """The text between the line with the first start marker and the first end marker after it; what lacks a marker isn't cut there."""
    at = F.instr(text, start)
    rest = F.when(at > 0, F.substring_index(F.substr(text, at), "\n", 1)).otherwise("")
    body = F.when(at > 0, F.substr(text, at + F.length(rest) + 1)).otherwise(text)
    stop = F.instr(body, end)
    return F.trim(F.when(stop > 0, F.substr(body, F.lit(1), stop - 1)).otherwise(body), F.lit(" \t\r\n"))


def read_text(spark: SparkSession, path: str, known_only: bool = False) -> DataFrame:
    """(path, text): one row for each file below `path`; files of unknown extension are read as text unless known_only."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = reader.load(path).select("path", "content")
    if known_only:
        rows = rows.where(extension(F.col("path")).isin(*TEXT))
    return rows.select("path", decoded(F.col("content")).alias("text"))


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX, a line each."""
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    lines = []
    for paragraph in root.iter(f"{name}p"):
        parts = {f"{name}t": lambda e: e.text or "", f"{name}tab": lambda e: "\t", f"{name}br": lambda e: "\n"}
        lines.append("".join(parts[e.tag](e) for e in paragraph.iter() if e.tag in parts))
    return "\n".join(lines)


def _scanned(text: str) -> bool:
    return len(re.sub(r"\s+", "", text)) < SCANNED_CHARS


def extract(data: bytes, ext: str, ocr: str = "auto", pdf: PdfReader | None = None, pages: Callable[[bytes], list[bytes]] | None = None, image: ImageReader | None = None) -> tuple[str, list[int]]:
    """Text of one file, and the pages (from 0) that were read from their image."""
    ext = ext.lower().lstrip(".")
    if ocr not in OCR_MODES:
        raise ValueError(f"ocr is one of {', '.join(OCR_MODES)}")
    if ext in TEXT:
        return data.decode("utf-8", "replace"), []
    if ext == "docx":
        return docx_text(data), []
    if ext in IMAGES:
        if ocr == "never":
            return "", []
        return (image or ocr_engines.reader())(data), [0]
    if ext == "pdf":
        texts = (pdf or pdf_pages)(data)
        wanted = [k for k, t in enumerate(texts) if ocr == "always" or (ocr == "auto" and _scanned(t))]
        if image is None and ocr_engines.available():
            image = ocr_engines.reader()
        if not wanted or image is None or pages is None:
            return "\n".join(texts), []
        drawn = pages(data)
        for k in wanted:
            texts[k] = image(drawn[k])
        return "\n".join(texts), wanted
    raise ValueError(f"unknown extension {ext!r}")


def read_documents(spark: SparkSession, path: str, ocr: str = "auto", **readers) -> DataFrame:
    """(path, text, ocr_pages, ocr_used, error) of every supported file below `path`; a file that fails has its error and no text."""
    kind = "path string, text string, ocr_pages array<int>, ocr_used boolean, error string"
    if ocr not in OCR_MODES:
        raise ValueError(f"ocr is one of {', '.join(OCR_MODES)}")

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            out = []
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    text, seen = extract(data, place.rpartition(".")[2], ocr, **readers)
                    out.append((place, text, seen, bool(seen), None))
                except Exception as wrong:  # one bad file doesn't end the job; it is reported
                    out.append((place, None, [], False, f"{type(wrong).__name__}: {wrong}"))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "text", "ocr_pages", "ocr_used", "error"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return rows.where(extension(F.col("path")).isin(*TEXT, *DOCUMENTS, *IMAGES)).mapInArrow(batches, kind)


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, start, end, entity_type, identifier_type): gold mentions by each document's first annotator."""
    rows = spark.read.json(path, multiLine=True, schema="doc_id string, text string, annotations map<string,struct<entity_mentions:array<struct<start_offset:int,end_offset:int,entity_type:string,identifier_type:string>>>>")
    first = F.array_min(F.map_keys("annotations"))
    mentions = rows.select("doc_id", "text", F.explode(F.element_at("annotations", first)["entity_mentions"]).alias("m"))
    return mentions.select("doc_id", "text", F.col("m.start_offset").alias("start"), F.col("m.end_offset").alias("end"), "m.entity_type", "m.identifier_type")


def read_masked(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, start, end, entity_type, value): gold spans of lines of JSON with source_text and privacy_mask."""
    rows = spark.read.json(path, schema="id string, source_text string, privacy_mask array<struct<start:int,end:int,label:string>>")
    each = rows.select(F.col("id").alias("doc_id"), F.col("source_text").alias("text"), F.explode("privacy_mask").alias("m"))
    return each.select("doc_id", "text", "m.start", "m.end", F.col("m.label").alias("entity_type"), F.substr("text", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("value"))


def read_overrides(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as file:
        return json.load(file)
