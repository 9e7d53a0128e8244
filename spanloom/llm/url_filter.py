"""URL verdicts: rules first, and for the rest the ratio of two character language models.

A rule is a host and a path; the longest rule that fits a URL decides it. URLs that rules allow or block are the accepted
and rejected training texts. Each class gets a variable-order Markov model of its host and path: counts of
strings of up to ORDER + 1 characters over a small alphabet, smoothed by Witten and Bell's interpolation, which
backs off to shorter contexts as a context is less known. A URL's score is the difference of the two log-likelihoods for
each character. The threshold comes from scores of all training URLs, each made by a model that hasn't seen it (two
folds), and balances the two error rates.

The models are tables over SYMBOLS ** (ORDER + 1) cells, so what is broadcast is bounded whatever the number of URLs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import tidy

ORDER = 3
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789.-/_%"
#: Start, the alphabet, anything else.
SYMBOLS = len(ALPHABET) + 2
BINS, SPAN = 4096, 16.0
ALLOW, BLOCK = "allow", "block"
# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty if the url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, like `net/`, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


_CODES = np.full(256, SYMBOLS - 1, np.int64)
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)
_CODES[np.frombuffer(_UPPER.encode(), np.uint8)] = _CODES[np.frombuffer(_LOWER.encode(), np.uint8)]


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the strings of order + 1 symbols that end at each byte of the texts, and whose text each is."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    flat = np.zeros(int(sizes.sum()) + order * len(raw), np.int64)  # zeros: start
    owner = np.repeat(np.arange(len(raw)), sizes)
    place = np.arange(len(owner)) + order * (owner + 1)
    flat[place] = _CODES[np.frombuffer(b"".join(raw), np.uint8)]
    code = np.zeros(len(owner), np.int64)
    for k in range(order, -1, -1):
        code = code * SYMBOLS + flat[place - k]
    return code, owner


def log_probabilities(counts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log P(last symbol | the `order` before it) of each code, by Witten-Bell interpolation over all shorter contexts."""
    table = counts.astype(np.float64).reshape((SYMBOLS,) * (order + 1))
    out = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for k in range(order + 1):
        own = table.sum(axis=tuple(range(order - k)))
        total, kinds = own.sum(axis=-1, keepdims=True), np.count_nonzero(own, axis=-1, keepdims=True)
        weight = np.divide(total, total + kinds, out=np.zeros_like(total), where=total > 0)
        share = np.divide(own, total, out=np.zeros_like(own), where=total > 0)
        out = weight * share + (1 - weight) * out
    return np.log(out).reshape(-1).astype(np.float32)


def score(texts: list[str], ratio: np.ndarray) -> np.ndarray:
    """Mean difference of the log-likelihoods for each character; 0 for an empty text."""
    code, owner = grams(texts)
    n = np.bincount(owner, minlength=len(texts))
    return np.bincount(owner, weights=ratio[code], minlength=len(texts)) / np.maximum(n, 1)


class UrlModel:
    """Difference of log-probabilities by code, and the threshold from which a URL is allowed."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold


def _counts(train: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Counts by (verdict, fold); at most SYMBOLS ** (ORDER + 1) rows of each come to the driver."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            code, owner = grams(batch.column(0).to_pylist())
            part = np.array([2 * (v == BLOCK) + f for v, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)
            keys, n = np.unique(code * 4 + part[owner], return_counts=True) if len(code) else (code, code)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["k", "n"])

    made = train.select("text", "verdict", "fold").mapInArrow(tidy(batches), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    keys, n = made.column("k").to_numpy(), made.column("n").to_numpy()
    out = {}
    for part, key in enumerate([(ALLOW, 0), (ALLOW, 1), (BLOCK, 0), (BLOCK, 1)]):
        own = keys % 4 == part
        out[key] = np.bincount(keys[own] // 4, weights=n[own], minlength=SYMBOLS ** (ORDER + 1))
    return out


def fit(rows: DataFrame) -> UrlModel:
    """Model from all rows (text, verdict), rows without a verdict left out; without a class every URL is allowed."""
    train = rows.where("verdict is not null and text != ''").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    counts = _counts(train)
    whole = {v: counts[v, 0] + counts[v, 1] for v in (ALLOW, BLOCK)}
    if not whole[ALLOW].any() or not whole[BLOCK].any():
        return UrlModel(np.zeros(SYMBOLS ** (ORDER + 1), np.float32), 0.0)
    other = [log_probabilities(counts[ALLOW, 1 - f]) - log_probabilities(counts[BLOCK, 1 - f]) for f in (0, 1)]

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            texts, folds = batch.column(0).to_pylist(), np.array(batch.column(2).to_pylist(), np.int64)
            made = np.where(folds == 0, score(texts, other[0]), score(texts, other[1]))
            bins = np.clip(((made + SPAN) / (2 * SPAN) * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bins, pa.int64())], ["verdict", "bin"])

    # At most two times BINS rows.
    seen = train.select("text", "verdict", "fold").mapInArrow(tidy(batches), "verdict string, bin long").groupBy("verdict", "bin").count().collect()
    histogram = {v: np.zeros(BINS) for v in (ALLOW, BLOCK)}
    for r in seen:
        histogram[r["verdict"]][r["bin"]] = r["count"]
    lost = np.append(0, np.cumsum(histogram[ALLOW])) / histogram[ALLOW].sum()  # accepted below each edge
    passed = 1 - np.append(0, np.cumsum(histogram[BLOCK])) / histogram[BLOCK].sum()
    errors = lost + passed
    best = np.flatnonzero(errors == errors.min())
    threshold = (best[0] + best[-1]) / 2 / BINS * 2 * SPAN - SPAN
    return UrlModel(log_probabilities(whole[ALLOW]) - log_probabilities(whole[BLOCK]), float(threshold))


def judge(pages: DataFrame, rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    Null urls and urls without :// have an empty host and path, no rule, and score 0. A null page_id passes unchanged;
    repeated rows get equal verdicts. An empty table gives an empty one, and any model is fitted on `pages` if none is given.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.concat("host", "path").alias("text"))
    model = model or fit(rows)
    ratio = rows.sparkSession.sparkContext.broadcast(model.ratio)  # SYMBOLS ** (ORDER + 1) numbers of four bytes

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            made = score([x or "" for x in batch.column(5).to_pylist()], ratio.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = rows.schema["page_id"].dataType.simpleString()
    scored = rows.mapInArrow(tidy(batches), f"page_id {kind}, host string, path string, rule string, verdict string, score double")
    own = F.when(F.col("score") >= model.threshold, ALLOW).otherwise(BLOCK)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")


def op1(pages: DataFrame) -> DataFrame:
    """Query form: host, path, rule and verdict of every page."""
    return judge(pages)
