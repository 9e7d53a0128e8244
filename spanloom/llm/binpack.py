"""Token-id output: best-fit-decreasing packing, and packed matrices.

A document of more than CAPACITY ids is split losslessly into full pieces and one rest. Best fit decreasing needs
only lengths, and lengths are few: the plan is made on the histogram of piece lengths (at most CAPACITY counts), with
bins of equal remaining capacity held as ranges of sequence ids and a segment tree over capacities that finds the
tightest fit. A row of the plan places a whole range of equally long pieces, so its size follows the number of
lengths, not of pieces. Pieces find their places by length and rank.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, tidy, tokenizer_path
from spanloom.llm.word_ids import VOCABULARY, word_ids

CAPACITY = 4096
#: Ids of pieces, and sequences with their matrices, that a task gives out at once.
OUT_IDS = 1 << 20
SEQUENCES = 128


class CapacityTree:
    """Segment tree over remaining capacities: how many bins are below each node."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, n: int) -> None:
        k = self.width + room
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least `least` that a bin has."""
        k = self.width + least
        if self.count[k]:
            return least
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.width
            k >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank from, rank to, pieces for each sequence, first sequence, offset) of best fit decreasing.

    The piece of rank r, from the row's first rank, goes to sequence first + (r - from) // pieces at
    offset + (r - from) % pieces * length.
    """
    rooms: dict[int, deque[tuple[int, int]]] = {}
    tree, out, opened = CapacityTree(capacity), [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            rooms.setdefault(room, deque()).append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids doesn't fit")
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = rooms[room].popleft()
                tree.add(room, -n)
            each = room // length
            used = min(n, -(-left // each))
            took = min(left, used * each)
            out.append((length, rank, rank + took, each, first, capacity - room))
            full, rest = divmod(took, each)
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            if used < n:
                rooms.setdefault(room, deque()).appendleft((first + used, n - used))
                tree.add(room, n - used)
            rank += took
            left -= took
    return out


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids by planes of equally significant bytes, compressed."""
    planes = np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return _PACK.compress(planes)


def unpacked_ids(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPACK.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, narrow: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, local rank of the length in the task[, ids]) of all documents.

    ids are little-endian unsigned 32-bit numbers; narrow: as packed_ids has them.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = word_ids(path), TaskContext.get().partitionId(), Counter()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "local", *["ids"] * keep_ids]

        def out(rows: list[tuple], blobs: list[bytes]) -> pa.RecordBatch:
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([*cols, *[pa.array(blobs, pa.binary())] * keep_ids], names)

        for batch in them:
            rows, blobs, size = [], [], 0
            for doc, (ids, _) in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                ids = ids.astype("<u4", copy=False)
                for s in range(0, len(ids), capacity):
                    part = ids[s : s + capacity]
                    n = len(part)
                    rows.append((doc, s, n, zlib.crc32(part), len(ids), task, seen[n]))
                    seen[n] += 1
                    if keep_ids:
                        blobs.append(packed_ids(part) if narrow else part.tobytes())
                size += len(ids)
                if size > OUT_IDS:
                    yield out(rows, blobs)
                    rows, blobs, size = [], [], 0
            if rows:
                yield out(rows, blobs)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, local long"
    return source.mapInArrow(tidy(batches), schema + ", ids binary" * keep_ids)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, narrow: bool = False) -> DataFrame:
    """Each piece with its sequence_id and offset; sequences hold at most `capacity` ids.

    Null and empty texts have one id, the closing one. Null doc_ids and repeated rows are pieces like any other; an empty
    table gives an empty one.
    """
    made = materialize(pieces(docs, vocabulary, capacity, keep_ids, narrow))
    counts = made.groupBy("length", "task").agg((F.max("local") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that the planner knows its size: a small one goes to the pieces, and pieces move only to a large one.
    bases = materialize(counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    # At most `capacity` rows come to the driver, whatever the number of documents.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    length, low, each, first, offset = (table[:, k] for k in (0, 1, 3, 4, 5))
    scale = np.int64(1) << np.int64(48)
    keys = length * scale + low

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            n, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            at = np.searchsorted(keys, n * scale + rank, side="right") - 1
            more = rank - low[at]
            cols = [c for c, x in zip(batch.columns, batch.schema.names, strict=True) if x != "rank"]
            names = [x for x in batch.schema.names if x != "rank"]
            new = [pa.array(first[at] + more // each[at], pa.int64()), pa.array(offset[at] + more % each[at] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *new], [*names, "sequence_id", "offset"])

    ranked = made.join(bases, ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids, (F.col("base") + F.col("local")).alias("rank"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return ranked.mapInArrow(tidy(batches), f"{schema}, sequence_id long, offset long")


def matrices(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0, narrow: bool = False) -> DataFrame:
    """One row for each sequence of pack(..., keep_ids=True, narrow=narrow): input_ids, cu_seqlens (from 0 up to the ids used), position_ids,
    and for each segment its doc_id and its start in the document.

    The first three are little-endian unsigned 32-bit numbers in binary; input_ids and position_ids have `capacity` of them. Positions
    start again with every piece. A sequence has at most `capacity` ids, so a group is always small.
    """
    names = ["sequence_id", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "starts"]
    kinds = [pa.binary()] * 3 + [pa.list_(pa.int64())] * 2

    def row(parts: list[dict]) -> tuple:
        ids, places, cuts = np.full(capacity, pad, "<u4"), np.zeros(capacity, "<u4"), [0]
        for x in parts:
            s, n = x["offset"], x["length"]
            ids[s : s + n] = unpacked_ids(x["ids"]) if narrow else np.frombuffer(x["ids"], "<u4")
            places[s : s + n] = np.arange(n)
            cuts.append(s + n)
        return ids.tobytes(), np.array(cuts, "<u4").tobytes(), places.tobytes(), [x["doc_id"] for x in parts], [x["start"] for x in parts]

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in them:
            for at in range(0, whole.num_rows, SEQUENCES):
                batch = whole.slice(at, SEQUENCES)
                rows = map(row, batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True), kinds)], names)

    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id", "start")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    schema = "sequence_id long, input_ids binary, cu_seqlens binary, position_ids binary, doc_ids array<long>, starts array<long>"
    return grouped.mapInArrow(tidy(batches), schema)


def write_matrices(docs: DataFrame, path: str, vocabulary: str | None = None, capacity: int = CAPACITY, pad: int = 0) -> None:
    """Pack `docs` and write the matrices as Parquet, one row for each sequence."""
    matrices(pack(docs, vocabulary, capacity, keep_ids=True, narrow=True), capacity, pad, narrow=True).write.mode("overwrite").parquet(path)
