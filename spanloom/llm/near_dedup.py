"""Near copies by similarity: texts whose sets of word shingles have a Jaccard similarity of LEAST at least.

SimHash goes first: fingerprints of the same shingles, linked within its radius by the tiled exact comparison of `simhash`. What
that radius can't reach (at J = 0.8 fingerprints differ in about ten of 64 bits, and up to nineteen) comes from sketches.

Method. A text is the set of its shingles' 64-bit hashes; texts with equal sets are one node. A sketch of BANDS keys, each
of ROWS minima of the set, deals nodes to buckets, so two nodes of similarity J share one with probability 1 - (1 - J^ROWS)^BANDS:
at J = 0.8 three pairs in a million are missed, fewer above. Nothing is linked by its fingerprint or its sketch: each link is
confirmed on the whole sets.
Every node is first compared with the smallest end of its buckets; then, in each bucket, with the smallest and the largest one, where
they are in different components. The nodes of buckets that still have several components are compared with each other on
their sets, by tiles: common shingles are counted for all pairs of two tiles at once, and only links come out, never the pairs.
So a large group costs a few comparisons a node, and a passage that many texts share makes work but no rows. Links
within a component need no test, as they would change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import drop, id_key, materialize, tidy
from spanloom.llm.simhash import components, majority
from spanloom.llm.simhash import links as links_within

SHINGLE_WORDS = 5
LEAST = 0.8
SEED = 42
BANDS = 32
ROWS = 5
#: Shingles that are hashed at once for the minima.
COUNT_ROWS = 512
#: Sets that are made in one batch of results.
OUT_ROWS = 256
#: Sets and shingles in a tile of a bucket; a shingle of more sets than MANY is counted by a product of matrices of so many columns.
TILE_SETS, TILE_SHINGLES = 1024, 1 << 18
MANY, MATRIX_COLUMNS = 16, 1024

_DRAW = np.random.default_rng(SEED)
_TIMES = _DRAW.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _DRAW.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the `words`-word shingles in order; none if there is no word.

    A-Z are lower-cased; words are runs without ASCII white space; fewer words than `words` make one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64))


def node(found: np.ndarray) -> int:
    """One number for a set of shingles."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS bucket keys of a set of shingles; none if it is empty."""
    if not len(found):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), COUNT_ROWS):
        np.minimum(least, (found[None, at : at + COUNT_ROWS] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ part) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of shingles; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())


def sketches(docs: DataFrame, text: str, id: str, words: int) -> DataFrame:
    """(id, node, n, fp, bands): the number of the text's set, its size, SimHash and bucket keys, one row for each input row."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            nodes, sizes, marks, keys = [], [], [], []
            for x in batch.column(1):
                found = shingles(x.as_py(), words)
                nodes.append(node(found))
                sizes.append(len(found))
                marks.append(majority(found) if len(found) else 0)
                keys.append(bands(found).view(np.int64))
            flat = pa.array(np.concatenate([*keys, np.empty(0, np.int64)]), pa.int64())
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(nodes), pa.array(sizes, pa.int64()), _signed(marks), pa.ListArray.from_arrays(ends, flat)], ["id", "node", "n", "fp", "bands"])

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(tidy(batches), "id long, node long, n long, fp long, bands array<long>")


def sets(docs: DataFrame, wanted: DataFrame, text: str, id: str, words: int) -> DataFrame:
    """(node, shingles as little-endian numbers) of the nodes of `wanted` (node, first), one row each; first is an id that has the node."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for s in range(0, batch.num_rows, OUT_ROWS):
                made = [shingles(x.as_py(), words) for x in batch.column(0)[s : s + OUT_ROWS]]
                yield pa.RecordBatch.from_arrays([_signed([node(x) for x in made]), pa.array([x.astype("<u8").tobytes() for x in made], pa.binary())], ["node", "shingles"])

    source = docs.select(id_key(F.col(id)).alias("first"), F.col(text).cast("string").alias("text"))
    chosen = source.join(wanted.select("first"), "first", "left_semi").select("text")
    made = chosen.mapInArrow(tidy(batches), "node long, shingles binary").join(wanted.select("node"), "node", "left_semi")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a similarity of `least` at least."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            x, y = batch.column(2), batch.column(3)
            near = [jaccard(*(np.frombuffer(v[k].as_buffer(), "<u8") for v in (x, y))) >= least for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left = known.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = known.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(batches), "a long, b long")


def alike(x: str, y: str, least: float) -> Column:
    """Whether sets of two sizes can be that similar."""
    return F.least(x, y) / F.greatest(x, y) >= least


def mixed(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """(key, node, n, root, low, high) of the keys of `rows` (key, node, n) whose nodes are in several components; low and high are a key's ends."""
    placed = rows.join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    end = F.struct("node", "n", "root")
    ends = placed.groupBy("key").agg(F.min(end).alias("low"), F.max(end).alias("high"), F.min("root").alias("r"), F.max("root").alias("s"))
    return placed.join(ends.where("r != s").drop("r", "s"), "key")


def with_ends(rows: DataFrame, tied: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of the nodes with both ends of their keys, across components."""
    open_ = mixed(rows, tied)
    low = open_.where((F.col("root") != F.col("low.root")) & alike("n", "low.n", least)).select(F.col("low.node").alias("a"), F.col("node").alias("b"))
    high = open_.where((F.col("root") != F.col("high.root")) & alike("n", "high.n", least)).select(F.col("node").alias("a"), F.col("high.node").alias("b"))
    return low.unionByName(high)


def linked(sets_: list[np.ndarray], root: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Places (i, j) of sets of that similarity in different components; enough of them to span what they connect.

    Common shingles are counted for all pairs at once: those of many sets by products of 0/1 matrices, the others pair by pair.
    """
    count = len(sets_)
    sizes = np.array([len(x) for x in sets_], np.int64)
    owner = np.repeat(np.arange(count), sizes)
    _, code, df = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    owner, df_of = owner[order], df[code[order]]  # the owners of a shingle stand together
    common = np.zeros((count, count), np.float32)
    many = df_of > MANY
    column = np.unique(code[order][many], return_inverse=True)[1]
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, MATRIX_COLUMNS):
        own = (column >= s) & (column < s + MATRIX_COLUMNS)
        part = np.zeros((count, MATRIX_COLUMNS), np.float32)
        part[owner[many][own], column[own] - s] = 1
        common += part @ part.T
    pairs = [np.zeros(0, np.int64)]
    for d in range(2, MANY + 1):
        owners = owner[df_of == d].reshape(-1, d)  # ascending in each row
        pairs += [owners[:, i] * count + owners[:, j] for i in range(d) for j in range(i + 1, d)]
    few = np.bincount(np.concatenate(pairs), minlength=count * count).reshape(count, count)
    common += few + few.T
    either = sizes[:, None] + sizes[None, :] - common
    near = (common >= least * either - 1e-6) & (root[:, None] != root[None, :])
    out, seen = [], np.zeros(count, bool)
    for first in range(count):
        stack = [] if seen[first] else [first]
        seen[stack] = True
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(near[i] & ~seen).tolist():
                out.append((i, j))
                seen[j] = True
                stack.append(j)
            same = np.flatnonzero((root == root[i]) & ~seen)
            seen[same] = True
            stack += same.tolist()
    return out


def _runs(them: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """(nodes, roots, sets) of each run of rows that agree in the first three columns; the rows come ordered by them."""
    key, held = None, ([], [], [])
    for batch in them:
        keys = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
        for (*now, node_, root), data in zip(keys, batch.column(5), strict=True):
            if now != key:
                if len(held[0]) > 1:
                    yield held
                key, held = now, ([], [], [])
            for into, value in zip(held, (node_, root, np.frombuffer(data.as_buffer(), "<u8").copy()), strict=True):
                into.append(value)
    if len(held[0]) > 1:
        yield held


def compared(rows: DataFrame, tied: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the nodes of each key of `rows` (key, node, n), but for its ends, across components.

    A key's nodes are dealt to tiles of at most about TILE_SETS sets and TILE_SHINGLES shingles, and every pair of tiles is a group of its
    own, so a key with many nodes is spread over many tasks and none holds more than two tiles.
    """

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, roots, found in _runs(them):
            out = linked(found, np.array(roots, np.int64), least)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in out], pa.int64()) for k in range(2)], ["a", "b"])

    inner = mixed(rows, tied).where("node != low.node and node != high.node").select("key", "node", "n", "root")
    tiles = F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    sized = inner.groupBy("key").agg(tiles.alias("tiles"), F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("key", "tiles")
    dealt = inner.join(sized, "key").withColumn("t", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"), "node", "root").join(known, "node")
    dealt = dealt.select("key", "x", "y", "node", "root", "shingles").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node")
    return dealt.mapInArrow(tidy(batches), "a long, b long").distinct()


def near_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = SHINGLE_WORDS, least: float = LEAST) -> DataFrame:
    """(id, node, component): one row for each input row; component is the smallest id reachable through near copies.

    Empty or null texts are equal to each other. Rows with a null id take part; null ranks before all other ids, so it is the
    component of what it reaches. Repeated rows get equal results; an empty table gives an empty one.
    """
    marked = materialize(sketches(docs, text, id, words))
    # The least id of a node; nulls are first in structs.
    nodes = marked.groupBy("node").agg(F.min(F.struct("id")).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    # Nodes of one fingerprint meet its least node; fingerprints within the radius meet by their least nodes.
    marks = nodes.where("n > 0").select("node", "fp", id_key(F.col("first.id")).alias("first"))
    heads = marks.groupBy("fp").agg(F.min(F.struct("node", "first")).alias("head"))
    head = lambda fp: heads.select(F.col("fp").alias(fp), F.col("head").alias(f"h{fp}"))
    same = marks.join(heads, "fp").where("node != head.node").select("head", F.struct("node", "first").alias("tail"))
    linked = links_within(marks).join(head("a"), "a").join(head("b"), "b").select(F.col("ha").alias("head"), F.col("hb").alias("tail"))
    close = materialize(same.unionByName(linked))
    rows = nodes.select("node", "n", id_key(F.col("first.id")).alias("first"), F.explode("bands").alias("bucket"))
    ends = (F.min(F.struct("node", "n")).alias("low"), F.max(F.struct("node", "n")).alias("high"))
    # Buckets of one node link nothing. Their counts come from partial sums. Tables that are joined with all texts or all buckets
    # are written first, so that the planner knows their sizes and moves the others only to large ones.
    shared = materialize(rows.groupBy("bucket").agg(F.count("*").alias("count"), *ends).where("count > 1").drop("count"))
    live = materialize(rows.join(shared, "bucket"))
    wanted = materialize(live.select("node", "first").unionByName(close.select("head.*")).unionByName(close.select("tail.*")).distinct())
    known = materialize(sets(docs, wanted, text, id, words))
    # First what SimHash links, and one comparison for each node, with the smallest of its buckets' ends: a large group of copies
    # shares that one.
    end = F.min(F.struct("low.node", "low.n")).alias("end")
    once = live.where((F.col("node") != F.col("low.node")) & alike("n", "low.n", least)).groupBy("node").agg(end)
    once = once.select(F.col("end.node").alias("a"), F.col("node").alias("b")).unionByName(close.select(F.col("head.node").alias("a"), F.col("tail.node").alias("b")))
    first = materialize(confirmed(once, known, least))
    tied = components(first)
    # Then both ends of each bucket, across components.
    rows = live.select(F.col("bucket").alias("key"), "node", "n")
    links = materialize(first.unionByName(confirmed(with_ends(rows, tied, least), known, least)))
    tied = components(links)
    # Nodes of buckets that still have several components are compared on their sets, tile by tile; only links come out.
    last = materialize(links.unionByName(compared(rows, tied, known, least)))
    tied = components(last)
    drop(close, shared, live, wanted, known, first, links, last)
    merged = nodes.select("node", "first").join(tied, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    roots = merged.groupBy("root").agg(F.min("first").alias("component"))
    named = merged.join(roots, "root").select("node", F.col("component.id").alias("component"))
    return marked.select("id", "node").join(named, "node").select("id", "node", "component")
