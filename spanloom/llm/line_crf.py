"""Document quality from a linear-chain conditional random field over lines.

Each line has features of its own and of the lines before and after it, and a hidden label, good or bad. The field's
weights (emissions and transitions) maximise the likelihood of lines labelled by their document, on a bounded sample.
Forward-backward gives each line's marginal probability of good; their mean, weighted by the lines' lengths, is the
document's quality, and a logistic calibration turns it into the score.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import held_out, labelled_sample, tidy
from spanloom.llm.toxicity import logistic

#: Labelled texts of each class that the field is fitted on, at most. They train whole, in chains of at most CHAIN lines.
SAMPLE_DOCS = 700
CHAIN = 200
STEPS, RATE, PENALTY = 80, 0.15, 1e-3

_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s]+")
_RUNS = re.compile(r"[^\w\s]{2,}")
OWN = 12


def line_features(line: str) -> list[float]:
    """Shares and shapes of one line, each about 0 to 1."""
    words = line.split()
    n, chars = len(words), sum(map(len, words))
    if not n:
        return [0.0] * OWN
    marks = sum(map(len, _MARKS.findall(line)))
    upper = sum(map(str.isupper, words))
    again = sum(map(eq, words, words[1:]))
    runs = len(_RUNS.findall(line))
    bars = line.count("|")
    return [
        1.0,
        min(math.log1p(n) / 5, 1.5),
        marks / chars,
        min(runs / n, 1.0),
        min(line.count("!") / n, 2.0) / 2,
        upper / n,
        min(bars / n, 1.0),
        again / n,
        1 - len(set(words)) / n,
        1.0 if line.rstrip()[-1] in ".!?…:;\"'”»)" else 0.0,
        min(chars / n / 12, 2.0),
        sum(map(str.isdigit, words)) / n,
    ]


#: Lines of a text whose features are held at once when it is scored.
SCORED_LINES = 4096
WIDTH = 3 * OWN


def lines_of(text: str | None) -> Iterator[str]:
    """Lines that have a word, one at a time."""
    text, at = text or "", 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line and not line.isspace():
            yield line
        at = end + 1


def own_features(lines: Iterable[str]) -> np.ndarray:
    return np.array([line_features(x) for x in lines], np.float64).reshape(-1, OWN)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features (own, before, after) of the lines of a text."""
    none = np.zeros((min(1, len(own)), OWN))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])


def sequence(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (own, before, after) of the lines that have a word, and their lengths."""
    lines = list(lines_of(text))
    return with_neighbours(own_features(lines)), np.array([len(line) for line in lines], np.float64)


def potentials(text: str | None, emission: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of good against bad of each line, and the lines' lengths; three numbers a line are held, never a text's features."""
    shares = emission.reshape(3, OWN).T
    scores, sizes, block = [np.zeros((0, 3))], array("d"), []
    for line in lines_of(text):
        block.append(line)
        sizes.append(len(line))
        if len(block) == SCORED_LINES:
            scores.append(own_features(block) @ shares)
            block = []
    if block:
        scores.append(own_features(block) @ shares)
    each = np.concatenate(scores)
    z = each[:, 0].copy()
    z[1:] += each[:-1, 1]
    z[:-1] += each[1:, 2]
    return z, np.frombuffer(sizes, np.float64) if len(sizes) else np.zeros(0)


def marginals(z: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(good) of each line. z: score of good against bad of each line; move: 2 x 2 scores from label to label."""
    if not len(z):
        return np.zeros(0)
    e = np.exp(np.clip(z, -30, 30))
    (bb, bg), (gb, gg) = np.exp(move).tolist()
    ahead, good = array("d"), array("d")  # share of good so far in each line, from the left; from the right with what follows
    share = 0.0
    for k, v in enumerate(memoryview(e)):
        b, g = (1.0, v) if not k else ((1 - share) * bb + share * gb, ((1 - share) * bg + share * gg) * v)
        share = g / (b + g)
        ahead.append(share)
    rb = rg = 0.5
    for k in range(len(e) - 1, -1, -1):
        g, b = ahead[k] * rg, (1 - ahead[k]) * rb
        good.append(g / (g + b))
        v = e[k]
        rb, rg = bb * rb + bg * v * rg, gb * rb + gg * v * rg
        s = rb + rg
        rb, rg = rb / s, rg / s
    return np.frombuffer(good, np.float64)[::-1]


def fit_field(docs: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights by maximum likelihood with Adam. A text of more than CHAIN lines is several chains, which
    share its weight; chains are taken side by side, the longest first."""
    chains = [(x[s : s + CHAIN], v, 1 / len(x)) for x, v in docs for s in range(0, len(x), CHAIN)]
    chains.sort(key=lambda c: -len(c[0]))
    sizes = np.array([len(x) for x, _, _ in chains])
    y, each = np.array([v for _, v, _ in chains]), np.array([w for _, _, w in chains])
    flat = np.vstack([x for x, _, _ in chains])
    first = np.cumsum(sizes) - sizes
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]  # chains with over t lines
    at = [first[:n] + t for t, n in enumerate(alive)]
    weight, n_docs = np.repeat(each, sizes), sum(len(x) > 0 for x, _ in docs)  # each text counts the same
    emission, move = np.zeros(WIDTH), np.zeros((2, 2))
    slow = [np.zeros(WIDTH), np.zeros((2, 2))]
    fast = [np.zeros(WIDTH), np.zeros((2, 2))]
    labels = np.repeat(y, sizes)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y, y), (sizes - 1) * each)
    for step in range(1, STEPS + 1):
        z = np.clip(flat @ emission, -30, 30)
        e = np.column_stack([np.ones(len(z)), np.exp(z)])
        m = np.exp(move)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for t, rows in enumerate(at):
            now = e[rows] if t == 0 else (alpha[at[t - 1][: len(rows)]] @ m) * e[rows]
            alpha[rows] = now / now.sum(axis=1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(len(at) - 1, 0, -1):
            rows, before = at[t], at[t - 1][: len(at[t])]
            right = e[rows] * beta[rows]
            joint = alpha[before][:, :, None] * m[None] * right[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += (joint * weight[rows][:, None, None]).sum(axis=0)
            back = right @ m.T
            beta[before] = back / back.sum(axis=1, keepdims=True)
        post = alpha * beta
        good = post[:, 1] / post.sum(axis=1)
        gradients = [flat.T @ (weight * (labels - good)) / n_docs - PENALTY * emission, (seen - pairs) / n_docs - PENALTY * move]
        for k, g in enumerate(gradients):
            slow[k] = 0.9 * slow[k] + 0.1 * g
            fast[k] = 0.999 * fast[k] + 0.001 * g * g
            change = RATE * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.999**step)) + 1e-8)
            if k:
                move = move + change
            else:
                emission = emission + change
    return emission, move


def quality(z: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> float:
    """Mean marginal of good, weighted by length; 0 for a text without a line."""
    return float(marginals(z, move) @ sizes / sizes.sum()) if len(z) else 0.0


@dataclass
class FieldModel:
    emission: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: tuple[float, float] = (0.0, 4.0)

    def score(self, text: str | None) -> float:
        q = quality(*potentials(text, self.emission), self.move)
        return 1 / (1 + math.exp(-min(max(self.scale[0] + self.scale[1] * (q - 0.5), -30.0), 30.0)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCS) -> FieldModel:
    """Model from at most `bound` training rows of each class; without both classes one that calls every text even."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            rows = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = list(lines_of(t))
                if lines:
                    rows.append((own_features(lines).astype("<f4").tobytes(), np.array([len(x) for x in lines], "<f4").tobytes(), y))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["x", "s", "y"])

    sample = labelled_sample(docs, labels, "quality", bound)
    # At most 2 x bound texts come to the driver, as OWN + 1 short numbers for each line.
    rows = sample.orderBy("i").select("text", F.col("y").cast("long").alias("y")).mapInArrow(tidy(batches), "x binary, s binary, y long").collect()
    made = [(with_neighbours(np.frombuffer(r["x"], "<f4").reshape(-1, OWN).astype(np.float64)), np.frombuffer(r["s"], "<f4").astype(np.float64), r["y"]) for r in rows]
    marks = {y for _, _, y in made}
    if marks != {0, 1}:
        return FieldModel()
    emission, move = fit_field([(x, y) for x, _, y in made])
    q = np.array([[quality(x @ emission, s, move) - 0.5] for x, s, _ in made])
    y = np.array([y for _, _, y in made])
    w = logistic(q, y)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    w[0] += math.log(shares.get(1, 1) / shares.get(0, 1)) - math.log(y.sum() / (len(y) - y.sum()))
    return FieldModel(emission, move, (float(w[0]), float(w[1])))


def scored(docs: DataFrame, model: FieldModel) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts have no good line."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            made = pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(batches), "doc_id long, score double")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query form: held_out, score and predicted of every document.

    A null doc_id is held out. Repeated rows get equal scores; an empty table gives an empty one; without labels of both
    classes a text's score doesn't depend on its lines. Of a very long text three numbers a line are held.
    """
    made = scored(docs, fit(docs, labels))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
