"""Order-preserving packing by dynamic programming.

Documents stay in the order of their ids. A window of at most CAPACITY ids ends at a document's or a sentence's end; the
cuts minimise padding plus a penalty for each cut inside a document. With best(j) the least cost up to boundary j,

    best(i) = penalty(i) + min over j with i - j <= CAPACITY of best(j) + CAPACITY - (i - j),

so the inner minimum slides over best(j) + j and a monotone queue gives it in amortised constant time. Only a sentence
of over CAPACITY ids, which no window holds, gets boundaries inside, every GAP ids and at a higher penalty. Documents are
dealt by ranges of ids; each range is solved in blocks whose open end goes on into the next block, and the range's
last window is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import tidy, tokenizer_path
from spanloom.llm.word_ids import VOCABULARY, word_ids

CAPACITY = 4096
#: Cost, in padding ids, of a cut at a sentence's end and at no end at all.
SENTENCE_CUT, FORCED_CUT = 4, 12
GAP = 48
#: Ids solved at once.
BLOCK = 1 << 19


def best_cuts(ends: list[int], penalty: list[int], capacity: int = CAPACITY) -> list[int]:
    """The chosen boundaries, ascending, the last one always among them.

    ends: boundaries, ascending and over 0, at most `capacity` apart; penalty: cost of a cut at each.
    """
    place, cost, back = [0, *ends], [0], [0]
    queue: deque[tuple[int, int]] = deque()  # (best + place, index), both ascending
    for i in range(1, len(place)):
        key = cost[-1] + place[i - 1]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i - 1))
        least = place[i] - capacity
        while place[queue[0][1]] < least:
            queue.popleft()
        value, j = queue[0]
        cost.append(value + capacity - place[i] + penalty[i - 1])
        back.append(j)
    out, i = [], len(place) - 1
    while i:
        out.append(place[i])
        i = back[i]
    return out[::-1]


def powers_of_two(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def with_gaps_cut(ends: np.ndarray, penalty: np.ndarray, capacity: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries with extra ones every `gap` ids where neighbours are more than `capacity` apart."""
    starts = np.append(0, ends[:-1])
    far = np.flatnonzero(ends - starts > capacity)
    if not len(far):
        return ends, penalty
    extra = np.concatenate([np.arange(starts[k] + gap, ends[k], gap) for k in far])
    places = np.concatenate([ends, extra])
    costs = np.concatenate([penalty, np.full(len(extra), FORCED_CUT)])
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


class Packer:
    """Documents in order to pieces: (document, start, length, crc32, document's ids, sequence, offset, padded length)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, block: int = BLOCK):
        self.capacity, self.block, self.sequence = capacity, max(block, 2 * capacity), first_sequence
        self.docs: list[tuple] = []  # (document, ids of it before this part, all its ids, ids)
        self.ends: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc, ids: np.ndarray, ends: np.ndarray) -> Iterator[list[tuple]]:
        """Take in a document, a very long one in parts; gives the pieces that are settled by then."""
        for s in range(0, len(ids), self.block):
            part = ids[s : s + self.block]
            own = ends[np.searchsorted(ends, s, side="right") : np.searchsorted(ends, s + len(part), side="right")]
            costs = np.full(len(own), SENTENCE_CUT)
            if s + len(part) == len(ids):
                costs[-1] = 0
            elif not len(own) or own[-1] < s + len(part):
                own, costs = np.append(own, s + len(part)), np.append(costs, FORCED_CUT)
            self.docs.append((doc, s, len(ids), part))
            self.ends.append(own - s + self.size)
            self.costs.append(costs)
            self.size += len(part)
            if self.size >= self.block:
                yield self.solve(False)

    def solve(self, last: bool) -> list[tuple]:
        if not self.size:
            return []
        ends, costs = with_gaps_cut(np.concatenate(self.ends), np.concatenate(self.costs), self.capacity, min(GAP, self.capacity))
        cuts = best_cuts(ends.tolist(), costs.tolist(), self.capacity)
        if last:
            begin = cuts[-2] if len(cuts) > 1 else 0
            cuts[-1:] = (begin + np.cumsum(powers_of_two(cuts[-1] - begin))).tolist()
        else:
            cuts = cuts[: max(1, len(cuts) - 2)]  # the last windows may change with what follows
        done = cuts[-1]
        out = self._pieces(cuts)
        docs, at, rest = self.docs, 0, []
        for doc, before, whole, ids in docs:
            skip = max(0, min(len(ids), done - at))
            at += len(ids)
            if skip < len(ids):
                rest.append((doc, before + skip, whole, ids[skip:]))
        ends, costs = np.concatenate(self.ends), np.concatenate(self.costs)
        open_ = ends > done
        self.docs, self.ends, self.costs, self.size = rest, [ends[open_] - done], [costs[open_]], self.size - done
        return out

    def _pieces(self, cuts: list[int]) -> list[tuple]:
        out, at, k, begin = [], 0, 0, 0
        for doc, before, whole, ids in self.docs:
            inside = 0
            while inside < len(ids) and k < len(cuts):
                n = min(len(ids) - inside, cuts[k] - at)
                part = ids[inside : inside + n]
                fill = cuts[k] - begin
                padded = fill if fill & (fill - 1) == 0 else self.capacity
                out.append((doc, before + inside, n, zlib.crc32(part.astype("<u4", copy=False)), whole, self.sequence, at - begin, padded))
                inside += n
                at += n
                if at == cuts[k]:
                    begin, k, self.sequence = at, k + 1, self.sequence + 1
            if k == len(cuts):
                break
        return out


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` ids, in the order of doc_id.

    Null and empty texts have one id, END. A null doc_id comes first; rows that repeat a doc_id are packed one
    after the other. An empty table gives an empty one. Texts are encoded once; what is shuffled is the text.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = word_ids(path), Packer(TaskContext.get().partitionId() << 40, capacity, block)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], list(COLUMNS))

        for batch in them:
            for doc, (ids, ends) in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                for rows in packer.add(doc, ids, ends):
                    yield out(rows)
        rows = packer.solve(True)
        if rows:
            yield out(rows)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The bounds of the ranges are drawn from doc_id alone, so that this pass reads no text.
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(tidy(batches), ", ".join(f"{c} long" for c in COLUMNS))
