"""Byte-level BPE by corpus-level merge replay.

1. Documents go in blocks. A block's text is cut into chunks that hold whole words of the tokenizer's pattern, and is written
   as numbers of its distinct chunks; the distinct chunks themselves are dealt to buckets by their hash.
2. A bucket gets a chunk of the corpus once from each block that has it and takes up each distinct one once. Their words become one
   corpus of symbols, with an inverted index from the rank of a symbol pair to the places where it stands. Ranks are
   replayed in order over all words at once; a merge touches only its two neighbours, whose new pairs enter the index.
   Words are independent of each other, so this gives each word what a merge loop over that word alone gives.
3. Ids go back to the blocks, whose texts are put together from them by array gathers.

What is shuffled is packed: one row for a block and bucket, one row for a block's texts; a block's numbers move once. A task holds one block, or a bucket's
distinct chunks up to KNOWN; memory grows with neither the corpus nor its vocabulary. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.chunks import APOSTROPHE, LETTER, OTHER, SPACE, Known, binaries, changes, classes, parts, ragged
from spanloom.llm.common import tidy, tokenizer_path, worker_cache

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct chunks whose ids a bucket keeps.
KNOWN = 1_000_000
#: Bytes of text in a block, bytes of chunks that a bucket takes up at once, and words replayed at once.
BLOCK_BYTES = 16_000_000
WINDOW_BYTES = 32_000_000
REPLAY_WORDS = 200_000
#: Bytes of a chunk that choose its bucket.
HASHED_BYTES = 32


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


#: Ids are below this power of two, so a pair of them is one number.
SHIFT = 21


class MergeReplay:
    """Word encoder over a rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        # By id: the token's bytes, and the id in decimals with a comma.
        ids = range(max(self.bytes) + 1)
        self.raw = pa.array([self.bytes.get(i) for i in ids], pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in ids], pa.large_binary())
        # Every pair of tokens whose bytes make a token, with that token's rank.
        self.pairs = {ranks[t[:k]] << SHIFT | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    def encode(self, words: Iterable[bytes]) -> list[list[int]]:
        """Ids of each word. A word that is a token itself is that token."""
        whole_of, single, rank_of = self.ranks.get, self.single, self.pairs.get
        out: list[list[int]] = []
        symbol: list[int] = []  # words one after the other, each closed by -1
        owner: list[int] = []
        begins: list[int] = []
        for w in words:
            whole = whole_of(w)
            if whole is not None or not w:
                out.append([whole] if w else [])
                continue
            begins.append(len(symbol))
            owner += [len(out)] * (len(w) + 1)
            symbol += [single[b] for b in w]
            symbol.append(-1)
            out.append([])
        before, after = list(range(-1, len(symbol) - 1)), list(range(1, len(symbol) + 1))
        index: dict[int, list[int]] = {}
        for p, (a, b) in enumerate(zip(symbol, symbol[1:], strict=False)):
            if a >= 0 and b >= 0 and (r := rank_of(a << SHIFT | b)) is not None:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
        heap = list(index)
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            r = pop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            waiting: set[int] = set()
            later: list[int] = []
            for p in places:
                x, q = symbol[p], after[p]
                if x < 0 or (y := symbol[q]) < 0 or rank_of(x << SHIFT | y) != r:
                    continue  # a neighbour has changed since
                if waiting and owner[p] in waiting:
                    later.append(p)
                    continue
                n, o = after[q], before[p]
                symbol[p], symbol[q] = r, -2
                after[p], before[n] = n, p
                y = symbol[n]
                if y >= 0 and (new := rank_of(r << SHIFT | y)) is not None:
                    if new in index:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        push(heap, new)
                    if new < r:  # that pair comes first in this word
                        waiting.add(owner[p])
                if o >= 0 and (y := symbol[o]) >= 0 and (new := rank_of(y << SHIFT | r)) is not None:
                    if new in index:
                        index[new].append(o)
                    else:
                        index[new] = [o]
                        push(heap, new)
                    if new < r:
                        waiting.add(owner[p])
            if later:
                index[r] = later
                push(heap, r)
        for p in begins:
            ids = out[owner[p]]
            while symbol[p] >= 0:
                ids.append(symbol[p])
                p = after[p]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers under 2^32 by planes of equally significant bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(packed: bytes) -> np.ndarray:
    """What `squeezed` took, as 64-bit numbers."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in the texts data[at[k] : at[k + 1]] where a match of the pattern begins for certain.

    Besides the changes of class, that is white space after anything else, and the beginning of a text.
    """
    kind = classes(data)
    begins = changes(kind)
    space, before = kind[1:] == SPACE, kind[:-1]
    begins[1:] |= space & (before >= LETTER) & (before <= APOSTROPHE)
    # After another character white space begins a match unless that character may be white space itself.
    odd = np.flatnonzero(space & (before == OTHER) & (data[:-1] >= 0x80)) + 1
    two, three = data[np.maximum(odd - 2, 0)], data[np.maximum(odd - 3, 0)]
    blank = (two == 0xC2) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    begins[odd[~blank]] = True
    begins[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(begins)


_WEIGHTS = np.random.default_rng(20240611).integers(0, 2**63, (HASHED_BYTES, 256), dtype=np.uint64) | np.uint64(1)


def buckets_of(chunks: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each chunk by its first bytes; equal chunks have equal ones."""
    data, at = parts(chunks)
    if not len(chunks):
        return np.zeros(0, np.int64)
    run, total = ragged(at[:-1], np.minimum(np.diff(at), HASHED_BYTES))
    column = np.arange(len(run)) - np.repeat(total[:-1], np.diff(total))
    mixed = np.add.reduceat(_WEIGHTS[column, data[run]], total[:-1])
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


#: A bucket's chunks of a block (later their ids): bytes and sizes. The texts of a block, with bucket = number of buckets: chunk
#: numbers, chunks of each text, bucket of each chunk by number, and the texts' doc_ids.
PACKED_SQL = "block long, bucket int, body binary, sizes binary, buckets binary, ids array<long>"
_PACKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary()), ("sizes", pa.binary()), ("buckets", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PACKED.types, strict=True)], schema=_PACKED)


class _Blocks:
    """Documents to packed blocks."""

    def __init__(self, buckets: int, block: int):
        self.buckets, self.block = buckets, block

    def __call__(self, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 24, 0  # a place in the input
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        for batch in them:
            data, at = parts(batch.column(1))
            first, n = 0, batch.num_rows
            while first < n:
                last = max(first + 1, int(np.searchsorted(at, at[first] + self.block - size, side="right")) - 1)
                held.append((batch.column(0).slice(first, last - first).to_pylist(), data[at[first] : at[last]], np.diff(at[first : last + 1])))
                size += int(at[last] - at[first])
                if size >= self.block or last < n:
                    yield self._settle(held, number)
                    number, held, size = number + 1, [], 0
                first = last
        if held:
            yield self._settle(held, number)

    def _settle(self, held: list, number: int) -> pa.RecordBatch:
        ids = [i for own, _, _ in held for i in own]
        data = np.concatenate([x for _, x, _ in held])
        at = np.concatenate([[0], np.cumsum(np.concatenate([x for _, _, x in held]))])
        starts = chunk_starts(data, at) if len(data) else np.zeros(0, np.int64)
        numbered = binaries(data, starts).dictionary_encode()
        codes = numbered.indices.to_numpy()
        # Frequent chunks get small numbers, which pack well.
        by_use = np.argsort(-np.bincount(codes, minlength=len(numbered.dictionary)), kind="stable")
        rank = np.empty(len(by_use), np.int64)
        rank[by_use] = np.arange(len(by_use))
        chunks = numbered.dictionary.take(pa.array(by_use))
        bucket = buckets_of(chunks, self.buckets)
        order = np.argsort(bucket, kind="stable")
        body, place = parts(chunks.take(pa.array(order)))
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        rows = [
            (number, k, zstandard.ZstdCompressor(level=1).compress(body[place[s] : place[e]].tobytes()), squeezed(np.diff(place[s : e + 1])), None, None)
            for k, (s, e) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False))
            if s < e
        ]
        # A block is named by its place and its chunks, so ids never meet texts of another cut.
        name = hashlib.blake2b(number.to_bytes(8, "little") + b"".join(x[2] for x in rows), digest_size=8).digest()
        number = int.from_bytes(name, "little", signed=True)
        rows = [(number, *x[1:]) for x in rows]
        rows.append((number, self.buckets, squeezed(rank[codes]), squeezed(np.diff(np.searchsorted(starts, at))), squeezed(bucket), ids))
        return _packed(rows)


class _Replayed:
    """Chunks ordered by bucket to ids; each distinct chunk of a bucket is replayed once."""

    def __init__(self, path: str, pattern: str, known: int = KNOWN):
        self.path, self.pattern, self.most = path, pattern, known

    def __call__(self, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, split = replayer(self.path), regex.compile(self.pattern).findall
        known, current, held, size = Known(), None, [], 0
        for batch in them:
            for block, bucket, body, sizes in zip(*(batch.column(k) for k in range(4)), strict=True):
                bucket = bucket.as_py()
                if held and (bucket != current or size > WINDOW_BYTES):
                    yield self._ids(held, current, known, replay, split)
                    held, size = [], 0
                if bucket != current:
                    known, current = Known(), bucket
                data = zstandard.ZstdDecompressor().decompress(body.as_py())
                held.append((block.as_py(), data, spread(sizes.as_py())))
                size += len(data)
        if held:
            yield self._ids(held, current, known, replay, split)

    def _ids(self, held: list, bucket: int, known: Known, replay: MergeReplay, split: Callable) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(x for _, x, _ in held), np.uint8)
        sizes = np.concatenate([x for _, _, x in held])
        numbered = binaries(data, np.cumsum(sizes) - sizes).dictionary_encode()
        names = numbered.dictionary.to_pylist()
        if len(known.code) + len(names) > self.most:
            known.forget()
        new = [x for x in names if x not in known.code]
        for s in range(0, len(new), REPLAY_WORDS):
            some = new[s : s + REPLAY_WORDS]
            words = [split(x.decode()) for x in some]
            made = replay.encode([w.encode() for own in words for w in own])
            counts = np.array([len(x) for x in made], np.int64)
            edges = np.cumsum([len(own) for own in words])
            known.add(some, np.array([i for x in made for i in x], np.uint32), np.diff(np.concatenate([[0], np.cumsum(counts)])[edges], prepend=0))
        codes = np.array([known.code[x] for x in names], np.int64)[numbered.indices.to_numpy()]
        run, total = ragged(known.start[codes], known.size[codes])
        ids, counts, rows, at = known.flat[run], known.size[codes], [], 0
        for block, _, own in held:
            end = at + len(own)
            rows.append((block, bucket, squeezed(ids[total[at] : total[end]]), squeezed(counts[at:end]), None, None))
            at = end
        return _packed(rows)


class _Assembled:
    """Texts of blocks with the ids of their chunks to what `result` makes of (doc_ids, ids, bounds of the texts)."""

    def __init__(self, result: Callable[[list, np.ndarray, np.ndarray], pa.RecordBatch]):
        self.result = result

    def __call__(self, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for row in range(batch.num_rows):
                body, sizes, buckets, ids, parts_ = (batch.column(x)[row].as_py() for x in ("body", "sizes", "buckets", "ids", "parts"))
                order = np.argsort(spread(buckets), kind="stable")
                parts_ = sorted(parts_ or [], key=lambda x: x["bucket"])
                flat = np.concatenate([np.zeros(0, np.int64), *(spread(x["body"]) for x in parts_)])
                sized = np.concatenate([np.zeros(0, np.int64), *(spread(x["sizes"]) for x in parts_)])
                if len(sized) != len(order):
                    raise RuntimeError("the ids of a block are of another cut of the input; its rows came in another order when they were read again")
                size, start = np.empty((2, len(order)), np.int64)
                size[order], start[order] = sized, np.cumsum(sized) - sized
                codes = spread(body)
                run, total = ragged(start[codes], size[codes])
                bounds = total[np.concatenate([[0], np.cumsum(spread(sizes))])]
                yield self.result(ids, flat[run], bounds)


_REPLAYERS: dict[str, MergeReplay] = worker_cache()


def replayer(path: str) -> MergeReplay:
    """The worker's replay of a vocabulary file."""
    if path not in _REPLAYERS:
        _REPLAYERS[path] = MergeReplay(read_ranks(path))
    return _REPLAYERS[path]


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encoded(docs: DataFrame, path: str, pattern: str, result: Callable, schema: str, block: int, known: int = KNOWN) -> DataFrame:
    """The three steps; `result` makes a block's rows.

    Blocks and chunks come from one exchange, which both branches read: neither a filter nor a pruned column may go
    below it, so the filters hold a term that the optimizer can't move, and every column is asked for.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = source.mapInArrow(tidy(_Blocks(buckets, block)), PACKED_SQL).repartition(buckets, "block")
    bucket = F.col("bucket") + F.rand(0) * 0
    chunks = made.where(bucket < buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    ids = chunks.mapInArrow(tidy(_Replayed(path, pattern, known)), PACKED_SQL)
    ids = ids.groupBy("block").agg(F.collect_list(F.struct("bucket", "body", "sizes")).alias("parts"))
    return made.where(bucket >= buckets).join(ids, "block", "left").mapInArrow(tidy(_Assembled(result)), schema)


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, block: int = BLOCK_BYTES, known: int = KNOWN) -> DataFrame:
    """(doc_id, ids): token ids of each whole text, one row for each input row; null and empty texts have none."""

    def result(doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], ["doc_id", "ids"])

    return _encoded(docs, vocabulary or tokenizer_path(VOCABULARY), pattern or _pattern(), result, "doc_id long, ids array<int>", block, known)


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); null ids are none."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replayer(path)
        for batch in them:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(tidy(batches), "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: ids encoded, then decoded by the rank table.

    Null and empty texts have no ids, and the digests of no bytes. Repeated rows and null ids give a row each; an empty
    table gives an empty one. A very long text is held whole by one task at a time.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)

    def joined(table: pa.Array, ids: pa.Array, bounds: np.ndarray, drop: int) -> list[str]:
        data, at = parts(table.take(ids))
        view = memoryview(np.ascontiguousarray(data))
        edges = at[bounds].tolist()
        return [hashlib.sha256(view[s : max(s, e - drop)]).hexdigest() for s, e in zip(edges, edges[1:], strict=False)]

    def result(doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        own = replayer(path)
        at = pa.array(ids)
        cols = [
            pa.array(doc_ids, pa.int64()),
            pa.array(np.diff(bounds), pa.int64()),
            pa.array(joined(own.decimals, at, bounds, 1), pa.string()),
            pa.array(joined(own.raw, at, bounds, 0), pa.string()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, path, pattern or _pattern(), result, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", block)
