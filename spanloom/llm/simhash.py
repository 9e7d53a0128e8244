"""SimHash near-duplicates: fingerprints of word shingles, linked exactly within a Hamming radius.

Method. Every text gets a 64-bit fingerprint. Distinct fingerprints are dealt to buckets by all pairs of five
bit blocks: two fingerprints that differ in at most three bits agree on at least two of five blocks, so each link
shows in some bucket. A bucket is compared exactly in tiles with exclusive-or and bit counts; its rows are ordered by
population count and tile pairs whose counts differ by more than the radius are skipped. A bucket of more than
TILE_ROWS fingerprints is dealt to pairs of tiles of near population counts, in separate groups, so that no task holds more than two tiles.
Each group reports a spanning forest of its links, not all pairs; components come from star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import drop, materialize, tidy

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: (shift, width) of the five bit blocks of a fingerprint.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints in one tile of a hot bucket, and side of the compared squares within it.
TILE_ROWS = 4096
SQUARE = 256
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of some 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_ROWS):
        part = hashes[at : at + COUNT_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the `words`-word shingles, repeats included; zero if there is no word.

    A-Z are lower-cased; words are runs without ASCII white space; fewer words than `words` make one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(found) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long, one row for each input row."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            values = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(batches), "id long, fp long")


def forest(values: np.ndarray, radius: int = RADIUS, side: int = SQUARE) -> list[tuple[int, int]]:
    """Links (a, b) that span the components of distinct uint64 `values` at `radius` bits, found tile by tile."""
    counts = np.bitwise_count(values)
    order = np.argsort(counts, kind="stable")
    values, counts = values[order], counts[order].astype(np.int64)
    root = np.arange(len(values))
    links = []
    for i in range(0, len(values), side):
        left = values[i : i + side]
        last = counts[min(i + side, len(values)) - 1]
        for j in range(i, len(values), side):
            if counts[j] - last > radius:
                break
            right = values[j : j + side]
            near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
            if not near.any():
                continue
            while True:
                open_ = near & (root[i : i + side, None] != root[None, j : j + side])
                at = int(open_.argmax())
                a, b = divmod(at, len(right))
                if not open_[a, b]:
                    break
                links.append((int(left[a]), int(right[b])))
                root[root == root[j + b]] = root[i + a]
    return links


def _groups(them: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Fingerprints of each run of rows that agree in the first `width` columns; the rows come ordered by them."""
    key, held = None, []
    for batch in them:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)])
        fps = batch.column(width).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)], strict=True):
            if key is not None and tuple(keys[s]) == key:
                held.append(fps[s:e])
            else:
                if held:
                    yield np.concatenate(held)
                key, held = tuple(keys[s]), [fps[s:e]]
    if held:
        yield np.concatenate(held)


def _forests(width: int, radius: int):
    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def out() -> pa.RecordBatch:
            made = [np.array(x, dtype=np.uint64).view(np.int64) for x in (a, b)]
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], ["a", "b"])

        for group in _groups(them, width):
            for x, y in forest(np.unique(group), radius):
                a.append(x)
                b.append(y)
            if len(a) > 50_000:
                yield out()
        if a:
            yield out()

    return batches


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints that span every component at `radius` (at most 3) bits."""
    if not 0 <= radius <= 3:
        raise ValueError("the block pairs are complete for a radius of 0 to 3")
    pairs = [(x, y) for x in range(5) for y in range(x + 1, 5)]
    part = lambda k: F.shiftrightunsigned("fp", BLOCKS[k][0]).bitwiseAND((1 << BLOCKS[k][1]) - 1)
    keys = F.array(*[F.lit(n << 32) + F.shiftleft(part(x), 13) + part(y) for n, (x, y) in enumerate(pairs)])
    rows = fps.select("fp").distinct().select("fp", F.explode(keys).alias("bucket"))
    # Counts of buckets come from partial sums; buckets of one fingerprint have no link and go no further.
    sizes = rows.groupBy("bucket").count().where("count > 1")
    rows = materialize(rows.join(sizes, "bucket"))
    cold = rows.where(F.col("count") <= TILE_ROWS).select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")
    # A hot bucket's tiles have one population count each, dealt by a hash where that has too many rows. Only pairs of tiles whose
    # counts differ by the radius at most are made, and a row goes to its tile's pairs alone.
    hot = rows.where(F.col("count") > TILE_ROWS).select("bucket", "fp", F.bit_count("fp").cast("long").alias("pop"))
    levels = hot.groupBy("bucket", "pop").agg(F.ceil(F.count("*") / TILE_ROWS).alias("n"))
    tile = lambda pop, part: pop * F.lit(1 << 32) + part
    other = levels.select("bucket", F.col("pop").alias("pop2"), F.col("n").alias("n2"))
    near = levels.join(other, "bucket").where((F.col("pop") <= F.col("pop2")) & (F.col("pop2") <= F.col("pop") + radius))
    near = near.select("bucket", "pop", "pop2", "n2", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    near = near.select("bucket", tile(F.col("pop"), F.col("part")).alias("x"), "pop2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("part2"))
    near = near.select("bucket", "x", tile(F.col("pop2"), F.col("part2")).alias("y")).where("x <= y")
    dealt = hot.join(levels, ["bucket", "pop"]).select("bucket", "fp", tile(F.col("pop"), F.pmod(F.xxhash64("fp"), F.col("n"))).alias("t"))
    left = dealt.withColumnRenamed("t", "x").join(near, ["bucket", "x"]).select("bucket", "x", "y", "fp")
    right = dealt.withColumnRenamed("t", "y").join(near.where("x < y"), ["bucket", "y"]).select("bucket", "x", "y", "fp")
    pairs_ = left.unionByName(right).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "fp")
    return cold.mapInArrow(tidy(_forests(1, radius)), "a long, b long").unionByName(pairs_.mapInArrow(tidy(_forests(3, radius)), "a long, b long")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node of its component.

    Star contraction: large stars tie each node's larger neighbours to its smallest neighbour, small stars tie its
    smaller ones; both keep connectivity, and the rows settle as stars around the roots after a logarithmic
    number of rounds. Smallest neighbours come from partial minima, so a node with many links is no hot group.
    """
    high = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    for _ in range(rounds):
        both = high.unionByName(high.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        last, high = high, materialize(small)
        drop(last)
        now = high.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return high.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(high.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): one row for each input row; component is the smallest id reachable through links.

    Empty or null texts have fingerprint zero and link like any other. Rows with a null id take part; null ranks before
    all other ids, so it is the component of what it reaches. Repeated rows get equal results; an empty table gives an empty one.
    """
    marked = materialize(fingerprints(docs, text, id, words))
    lowest = marked.groupBy("fp").agg(F.min(F.struct("id")).alias("first"))  # nulls are first in structs
    tied = components(links(marked, radius))
    merged = lowest.join(tied, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = merged.groupBy("root").agg(F.min("first").alias("component"))
    named = merged.select("fp", "root").join(roots, "root").select("fp", F.col("component.id").alias("component"))
    return marked.join(named, "fp").select("id", "fp", "component")


def op4(docs: DataFrame) -> DataFrame:
    """Query form: doc_id, fingerprint as 16 hex digits, component_id."""
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), hex_.alias("fingerprint"), F.col("component").alias("component_id"))
