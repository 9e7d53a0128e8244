"""Toxicity from a learned lexicon that also catches misspelled terms.

Fit. Words, and word beginnings of PREFIXES letters, that stand in many toxic and hardly any other of a bounded
sample of labelled texts make a lexicon with log-odds as weights. Score. Every word of a text is matched by the
intersection of its Levenshtein automaton with the lexicon's trie (one edit for terms of five letters and more; word
beginnings match exactly); digits and signs that stand for letters are read as letters. A window of words around a hit
tells quotation and talk about a word from abuse, and scales the hit. The hits' mass gives the score by logistic
regression, with the intercept set for the class shares among all training labels.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import held_out, labelled_sample, materialize, tidy, worker_cache

#: Labelled texts of each class that the model is fitted on, at most. Every term of theirs that qualifies is kept.
SAMPLE_DOCS = 6000
PREFIXES = (4, 5, 6, 7)
#: A term stands in so many toxic texts at least, and in such a share of them; so purely in toxic ones, and in
#: texts that are this much unlike each other.
MIN_SUPPORT, MIN_SHARE, MIN_PRECISION, MIN_UNLIKE = 6, 0.006, 0.75, 0.5
FUZZY_LETTERS = 5
FEW_WORDS = 40
#: Share of a hit's weight that one edit leaves (of a short term less, as other words come close to it), and that a quoted or
#: mentioned term leaves.
EDIT_SHARE, SHORT_EDIT_SHARE, SHORT_LETTERS, QUOTED_SHARE = 0.8, 0.5, 6, 0.35
WINDOW = 6
#: Weight of a made-up variant of a text in the fit, and ridge penalty for each text.
VARIANT_WEIGHT, RIDGE = 0.1, 0.0002
# Signs read as letters, quotation marks, words that speak of a word.
LEET = str.maketrans("013457@$", "oieastas")
QUOTES = "\"“”„«»‘’"
MENTIONS = frozenset("word words term terms slur slurs insult insults insulting called said says quote quoted quotes definition means meaning wrote".split())

_TOKEN = re.compile(r"[@$]?[^\W_](?:[\w@$]*[^\W_])?")


def letters(token: str) -> str:
    """Lower case, with signs that stand for letters read as letters if the token has letters too."""
    token = token.lower()
    return token if token.isalpha() or not any(map(str.isalpha, token)) else token.translate(LEET)


class Levenshtein:
    """Automaton of the strings within `edits` of a word; a state is a row of distances, those over `edits` cut off."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.edits, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], char: str) -> tuple[tuple[int, int], ...]:
        word, edits, out = self.word, self.edits, []
        known = dict(state)
        if state and state[0][0] == 0 and state[0][1] < edits:
            out.append((0, state[0][1] + 1))
        last = out[-1] if out else None
        for i, d in state:
            if i == len(word):
                break
            value = d + (word[i] != char)
            value = min(value, known.get(i + 1, edits) + 1)
            if last and last[0] == i:
                value = min(value, last[1] + 1)
            if value <= edits:
                last = (i + 1, value)
                out.append(last)
            elif last and last[0] == i and last[1] < edits:
                last = (i + 1, last[1] + 1)
                out.append(last)
        while last and last[0] < len(word) and last[1] < edits:
            last = (last[0] + 1, last[1] + 1)
            out.append(last)
        return tuple(out)

    def accepts(self, state: tuple[tuple[int, int], ...]) -> int | None:
        """Distance if the state accepts."""
        return state[-1][1] if state and state[-1][0] == len(self.word) else None


class Lexicon:
    """Trie of terms with weights; a term that ends in * stands for all words that begin with it."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.root: dict = {}
        self.back: dict = {}  # terms that may have an edit, from their ends
        halves: dict[int, tuple[set[str], set[str]]] = {}
        self.begins: dict[int, set[str]] = {}
        self.exact: set[str] = set()
        for term in terms:
            node, bare = self.root, term.rstrip("*")
            for c in bare:
                node = node.setdefault(c, {})
            n = len(bare)
            node["prefix" if term.endswith("*") else "word"] = term
            if term.endswith("*"):
                self.begins.setdefault(n, set()).add(bare)
            elif n < FUZZY_LETTERS:
                self.exact.add(bare)
            else:
                heads, tails = halves.setdefault(n, (set(), set()))
                heads.add(bare[: n // 2])
                tails.add(bare[n // 2 :])
                node = self.back
                for c in reversed(bare):
                    node = node.setdefault(c, {})
                node["word"] = term
        # By the length of a word: (length of a term's first half, minus that of its second, first halves, second halves).
        self.halves = {
            size: [(n // 2, n // 2 - n, *halves[n]) for n in (size - 1, size, size + 1) if n in halves]
            for size in {m + d for m in halves for d in (-1, 0, 1)}
        }
        self.known: dict[str, tuple[float, int] | None] = {}

    def possible(self, word: str) -> bool:
        """False for words that no term can match: one edit leaves one half of a term as it was."""
        for head, tail, heads, tails in self.halves.get(len(word), ()):
            if word[:head] in heads or word[tail:] in tails:
                return True
        return word in self.exact or any(word[:n] in them for n, them in self.begins.items())

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term for a word."""
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) > KNOWN:
                self.known.clear()
            found = self.known[word] = self._search(word)
            return found

    def _search(self, word: str) -> tuple[float, int] | None:
        best, node = None, self.root
        for c in word:
            node = node.get(c)
            if node is None:
                break
            if "prefix" in node:
                best = max(best or (0.0, 0), (self.terms[node["prefix"]], 0))
        else:
            if "word" in node:
                best = max(best or (0.0, 0), (self.terms[node["word"]], 0))
        if best:
            return best
        # One half of the term stands as it is; from where it ends, the automaton of the other half takes one edit.
        for head, tail, heads, tails in self.halves.get(len(word), ()):
            if word[:head] in heads:
                best = max(best or (0.0, 0), self._within(self.root, word[:head], word[head:]))
            if word[tail:] in tails:
                best = max(best or (0.0, 0), self._within(self.back, word[: tail - 1 : -1], word[:tail][::-1]))
        return best if best and best[0] else None

    def _within(self, trie: dict, exact: str, rest: str) -> tuple[float, int]:
        """(weight, edits) of the best term that begins with `exact` in a trie and goes on within one edit of `rest`."""
        for c in exact:
            trie = trie.get(c)
            if trie is None:
                return 0.0, 0
        best, automaton = (0.0, 0), Levenshtein(rest, 1)
        stack = [(trie, automaton.start())]
        while stack:
            node, state = stack.pop()
            term = node.get("word")
            if term and len(term) >= FUZZY_LETTERS and (d := automaton.accepts(state)):
                best = max(best, (self.terms[term] * (SHORT_EDIT_SHARE if len(term) <= SHORT_LETTERS else EDIT_SHARE), d))
            for c, below in node.items():
                if len(c) == 1 and (after := automaton.step(state, c)):
                    stack.append((below, after))
        return best


#: Words with a term's half whose match is kept in a worker.
KNOWN = 400_000
_LEXICONS: dict[int, Lexicon] = worker_cache()


def lexicon_of(terms: dict[str, float]) -> Lexicon:
    """The worker's lexicon of these terms; what it knows of words stays between tasks."""
    key = hash(tuple(sorted(terms.items())))
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(terms)
    return _LEXICONS[key]


def is_quoted(text: str, low: int, start: int, end: int, high: int) -> bool:
    """Whether [start, end) stands between quotation marks within [low, high): the last mark before it opens, the first after it closes.

    A mark opens before a letter or digit and after none, and closes after something other than white space and before no letter or
    digit. One between two letters is an apostrophe.
    """

    def kind(at: int) -> str | None:
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        if after.isalnum():
            return None if before.isalnum() else "opens"
        return "closes" if before and not before.isspace() else None

    last = next((k for at in range(start - 1, low - 1, -1) if text[at] in QUOTES and (k := kind(at))), None)
    first = next((k for at in range(end, min(high, len(text))) if text[at] in QUOTES and (k := kind(at))), None)
    return last == "opens" and first == "closes"


def hits(text: str, lexicon: Lexicon) -> Iterator[tuple[int, int, float, int]]:
    """(start, end, weight in its context, edits) of every hit."""
    tokens = [(m.start(), m.end(), letters(m[0])) for m in _TOKEN.finditer(text)]
    for k, (s, e, word) in enumerate(tokens):
        if not lexicon.possible(word) or not (found := lexicon.match(word)):
            continue
        near = tokens[max(0, k - WINDOW) : k + WINDOW + 1]
        quoted = is_quoted(text, max(0, near[0][0] - 1), s, e, near[-1][1] + 2)
        mentioned = any(w in MENTIONS for _, _, w in near)
        yield s, e, found[0] * (QUOTED_SHARE if quoted or mentioned else 1.0), found[1]


BLOCK_CHARS = 1_000_000


def all_features(texts: Iterable[str | None], lexicon: Lexicon) -> Iterator[tuple[float, float, float]]:
    """Of each text the heaviest exact hit, the heaviest one with an edit, and the log of the mass of all hits.

    Texts go in blocks: each distinct word of a block is matched once, and only texts with a hit are looked at in detail.
    """
    block: list[tuple[str, list[str]]] = []
    size = 0
    for text in texts:
        text = text or ""
        block.append((text, _TOKEN.findall(text.lower())))
        size += len(text)
        if size > BLOCK_CHARS:
            yield from _block_features(block, lexicon)
            block, size = [], 0
    yield from _block_features(block, lexicon)


def _block_features(block: list[tuple[str, list[str]]], lexicon: Lexicon) -> Iterator[tuple[float, float, float]]:
    possible, match = lexicon.possible, lexicon.match
    hit = set()
    for word in set().union(*(words for _, words in block)):
        read = word if word.isalpha() else letters(word)
        if possible(read) and match(read):
            hit.add(word)
    for text, words in block:
        found = [(w, d) for _, _, w, d in hits(text, lexicon)] if not hit.isdisjoint(words) else []
        yield max((w for w, d in found if not d), default=0.0), max((w for w, d in found if d), default=0.0), math.log1p(sum(w for w, _ in found))


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    return next(all_features([text], lexicon))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40, weight: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of a ridge logistic regression, the intercept first, by Newton's method."""
    weight = np.ones(len(x)) if weight is None else weight
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    terms: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (-3.0, 0.5, 0.5, 0.5)

    def scores(self, texts: Iterable[str | None], lexicon: Lexicon) -> Iterator[float]:
        for figures in all_features(texts, lexicon):
            z = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], figures, strict=True))
            yield 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

    def score(self, text: str | None, lexicon: Lexicon) -> float:
        return next(self.scores([text], lexicon))


def _terms(text: str | None) -> set[str]:
    words = {letters(w) for w in _TOKEN.findall(text or "")}
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


def likeness(terms: list[str]) -> int:
    """A number that near copies of a text nearly always share: of its longest words, or of all if they are few."""
    words = [t for t in terms if not t.endswith("*")]
    return zlib.crc32(" ".join(words if len(words) < FEW_WORDS else heapq.nsmallest(3, words, key=lambda t: (-len(t), t))).encode())


def learned_terms(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """Weights of the chosen terms; a term whose shorter beginning is chosen is left out.

    A beginning that is nearly always that of one word gives way to the word, which also matches with an edit.
    """
    out: dict[str, float] = {}
    alone: dict[str, int] = {}
    for term, (a, _) in counts.items():
        for n in PREFIXES if not term.endswith("*") else ():
            alone[f"{term[:n]}*"] = max(alone.get(f"{term[:n]}*", 0), a)
    rate = lambda a, n: (a + 0.5) / (n + 1)
    weight = lambda t: math.log(rate(counts[t][0], toxic) / rate(counts[t][1], other))
    for term in sorted(counts, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        bare = term.rstrip("*")
        if len(bare) < 3 or any(f"{bare[:n]}*" in out for n in PREFIXES if n < len(bare)):
            continue
        if term.endswith("*") and alone.get(term, 0) >= 0.9 * counts[term][0]:
            continue
        out[term] = weight(term)
    return out


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCS) -> ToxicityModel:
    """Model from at most `bound` training rows of each class; without both classes a model that finds nothing."""
    sample = materialize(labelled_sample(docs, labels, "toxic", bound))
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return ToxicityModel()

    def terms(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            made, marks, kinds = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(_terms(text))
                made += own
                marks += [y] * len(own)
                kinds += [likeness(own)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array(marks, pa.int64()), pa.array(kinds, pa.int64())], ["term", "y", "kind"])

    rows = sample.select("text", "y").mapInArrow(tidy(terms), "term string, y long, kind long")
    # Near copies count once: a term is as frequent in toxic texts as there are unlike texts among them.
    counted = rows.groupBy("term").agg(F.count_distinct(F.when(F.col("y") == 1, F.col("kind"))).alias("a"), F.sum("y").alias("all"), F.sum(1 - F.col("y")).alias("b"))
    share = F.col("a") / toxic / (F.col("a") / toxic + F.col("b") / other)
    pure = (share >= 0.9) & (F.col("a") >= MIN_PRECISION * (F.col("a") + F.col("b") * min(1.0, toxic / other * 8)))
    chosen = counted.where((F.col("a") >= max(MIN_SUPPORT, MIN_SHARE * toxic)) & (F.col("a") >= MIN_UNLIKE * F.col("all")) & pure)
    # Terms of at most 2 x bound texts, each in MIN_SUPPORT of them at least: their number is bounded by the sample.
    rows = chosen.orderBy("term").collect()
    terms_ = learned_terms({r["term"]: (r["a"], r["b"]) for r in rows}, toxic, other)
    if not terms_:
        return ToxicityModel()

    def figures(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(terms_)
        for batch in them:
            made = list(all_features(batch.column(0).to_pylist(), lexicon))
            cols = [pa.array([m[k] for m in made], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(1)], ["a", "b", "c", "y"])

    table = sample.select("text", F.col("y").cast("long").alias("y")).mapInArrow(tidy(figures), "a double, b double, c double, y long").toArrow()
    x = np.column_stack([table.column(k).to_numpy() for k in range(3)])
    y = table.column(3).to_numpy()
    # Toxic texts stand in once more with all their terms misspelled, still toxic, and once with all of them quoted, not toxic:
    # the sample has hardly any such texts, and the score must tell them apart.
    hit = x[(y == 1) & (x[:, 0] > 0)]
    mass = lambda share: np.log1p(np.expm1(hit[:, 2]) * share)
    misspelled = np.column_stack([np.zeros(len(hit)), hit[:, :2].max(axis=1) * EDIT_SHARE, mass(EDIT_SHARE)])
    quoted = np.column_stack([hit[:, :2] * QUOTED_SHARE, mass(QUOTED_SHARE)])
    more = np.full(2 * len(hit), VARIANT_WEIGHT)
    w = logistic(
        np.vstack([x, misspelled, quoted]),
        np.concatenate([y, np.ones(len(hit)), np.zeros(len(hit))]),
        penalty=len(x) * RIDGE,
        weight=np.concatenate([np.ones(len(x)), more]),
    )
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    shares = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    w[0] += math.log(shares.get(1, toxic) / shares.get(0, other)) - math.log(toxic / other)
    return ToxicityModel(terms_, tuple(float(v) for v in w))


def scored(docs: DataFrame, model: ToxicityModel, carry: list[str] = ()) -> DataFrame:
    """(id, score) of every row and the columns of `carry`; null texts score as empty ones. The model's terms are those of a bounded sample."""
    more = [x for x in carry if x != "text"]
    names = [f"c{k}" for k in range(len(more))]
    kept = ["text"] if "text" in carry else []

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(model.terms)
        for batch in them:
            made = pa.array(list(model.scores((t.as_py() for t in batch.column(1)), lexicon)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(1)] if kept else []), *batch.columns[2:], made], ["id", *kept, *names, "score"])

    carried = [F.col(f"`{x}`").alias(n) for n, x in zip(names, more, strict=True)]
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), *carried)
    kinds = "".join(f", {n} {source.schema[n].dataType.simpleString()}" for n in (*kept, *names))
    made = source.mapInArrow(tidy(batches), f"id long{kinds}, score double")
    place = dict(zip(more, names, strict=True)) | {"text": "text"}
    return made.select(F.col("id").alias("doc_id"), *[F.col(place[x]).alias(x) for x in carry], "score")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query form: held_out, score and predicted of every document.

    A null doc_id is held out. Repeated rows get equal scores; an empty table gives an empty one; without labels of both
    classes every score is that of an untrained model, below one half.
    """
    made = scored(docs, fit(docs, labels))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
