"""Removal of byte strings that occurred earlier in the corpus, by deep-shallow suffix sorting.

A byte goes if some LENGTH-byte string that covers it also starts earlier: in a document of smaller id, or earlier
in the same one. All strings are judged on the input.

How the suffixes are dealt out. Each LENGTH-byte window has an anchor: the GRAM-byte string in it with the least
hash (leftmost on a tie). Equal windows have equal anchors at equal places, so windows meet under their anchor's hash.
An anchor's windows in one document are one run, and one row: hash, context hash (all bytes its windows
cover), place. Three levels decide the windows:

1. Inside a task, and then under the anchor's hash over all tasks: of rows with the same context, only the first in the
   corpus can hold a first occurrence; all windows of the others go. A task ships one row of each context at most, so
   a passage in a third of all documents reaches its group once a task, not once a document.
2. Anchors with one context are done. Of the others, one row for each context ships its bytes (at most
   2 * LENGTH - GRAM) to the anchor's group; an anchor with more than HOT_CONTEXTS contexts ships its windows under
   their own hashes instead, which spread over all tasks.
3. There the suffixes that start windows are sorted deep-shallow: multikey quicksort on 8-byte characters to
   SHALLOW bytes, then a blind trie for each remaining group of long common prefixes. Suffixes that agree in LENGTH
   bytes are one leaf, whose earliest one stays.

Removed byte ranges go to their documents by a join on the id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import id_key, materialize, tidy

LENGTH = 100
GRAM = 32
SHALLOW = 48
HOT_CONTEXTS = 1024
#: Bytes of text hashed at once, and windows sorted at once; a group of anchors is never split.
BLOCK = 1 << 18
#: Anchor rows that a task of level 1 decides together, and documents that are put together in one batch of results.
HOLD_ROWS = 100_000
OUT_ROWS = 1000
SORT_WINDOWS = 1 << 17

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 2**64)
_BYTES = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Anchor runs of the windows in a buffer of concatenated texts."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK):
        if not 0 < gram <= length:
            raise ValueError("the gram is at least 1 and at most the length")
        self.length, self.gram, self.block = length, gram, block
        n = block + 2 * length
        self.up, self.down = _powers(_MUL, n + 1), _powers(_INV, n)

    def _part(self, data: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of a block: first window, last window and anchor of each run, with anchor and context hashes. usable: of each window."""
        length, gram = self.length, self.gram
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.down[:n], out=total[1:])
        grams = _mixed((total[gram:] - total[:-gram]) * self.up[: n - gram + 1])
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        width, step = length - gram + 1, 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        anchor = (least & _LOW).astype(np.int64)
        start = np.empty(len(anchor), bool)
        start[:1] = True
        start[1:] = (anchor[1:] != anchor[:-1]) | ~usable[:-1]
        first = np.flatnonzero(start & usable)
        stop = start | ~usable
        edges = np.append(np.flatnonzero(stop), len(anchor))
        last = edges[np.searchsorted(edges, first, side="right")] - 1
        at = anchor[first]
        shape = ((at - first) * (4 * length) + (last - first)).astype(np.uint64)
        context = _mixed((total[last + length] - total[first]) * self.up[first] + _mixed(shape + np.uint64(1)))
        return first, last, at, grams[at].view(np.int64), context.view(np.int64)

    def of(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(first, last, anchor, hash, context) in places of `data`, whose texts end at `ends` (ascending)."""
        length = self.length
        for lo in range(0, len(data) - length + 1, self.block):
            part = data[lo : lo + self.block + length - 1]
            if len(part) < length:
                break
            windows = np.arange(lo, lo + len(part) - length + 1)
            end = ends[np.searchsorted(ends, windows, side="right")]
            usable = windows + length <= end
            if usable.any():
                first, last, at, h, c = self._part(part, usable)
                yield first + lo, last + lo, at + lo, h, c


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


ROWS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("at", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.int8())])
#: kind: an anchor's row; windows that go; a request for an anchor's bytes; the same, by window.
ANCHOR, GONE, WANTED, WANTED_HOT = 0, 1, 2, 3
ROWS_SQL = "h long, c long, doc long, tag int, at long, lo int, hi int, kind byte"


def _batch(h, c, doc, tag, at, lo, hi, kind) -> pa.RecordBatch:
    arrays = [np.asarray(x).astype(t.to_pandas_dtype()) for x, t in zip((h, c, doc, tag, at, lo, hi, kind), ROWS.types, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, ROWS.types, strict=True)], schema=ROWS)


def _gone(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch | None:
    """Windows that go, neighbouring runs of a document joined; spread by the document."""
    if not len(doc):
        return None
    order = np.lexsort((first, tag, doc))
    doc, tag, first, last = doc[order], tag[order], first[order], last[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (first[1:] > last[:-1] + 1))
    s = np.flatnonzero(new)
    hi = np.maximum.reduceat(last, s)
    at = first[s]
    return _batch(_mixed(doc[s].view(np.uint64)).view(np.int64), np.zeros(len(s)), doc[s], tag[s], at, np.zeros(len(s)), hi - at, np.full(len(s), GONE))


class _Mapper:
    """Texts to anchor rows; repeats of a context within some batches are decided here."""

    def __init__(self, length: int, gram: int, hold: int = HOLD_ROWS):
        self.length, self.gram, self.hold = length, gram, hold

    def __call__(self, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, size = Anchors(self.length, self.gram), [], 0
        for batch in them:
            for rows in self._rows(anchors, batch):
                held.append(rows)
                size += len(rows[0])
                if size >= self.hold:
                    yield from self._settle(held)
                    held, size = [], 0
        if held:
            yield from self._settle(held)

    def _rows(self, anchors: Anchors, batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        texts = batch.column(1)
        if not batch.num_rows:
            return
        kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        _, places, bytes_ = texts.buffers()
        if bytes_ is None:
            return
        ends = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(bytes_, np.uint8)[: ends[-1]]
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        tags = batch.column(2).to_numpy(zero_copy_only=False)
        begins, ends = ends[:-1], ends[1:]
        live = np.flatnonzero(ends > begins)
        for first, last, at, h, c in anchors.of(data, ends[live]):
            k = live[np.searchsorted(ends[live], first, side="right")]
            yield [h, c, ids[k], tags[k], at - begins[k], first - at, last - at]

    def _settle(self, held: list) -> Iterator[pa.RecordBatch]:
        h, c, doc, tag, at, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, doc, c, h))
        h, c, doc, tag, at, lo, hi = (x[order] for x in (h, c, doc, tag, at, lo, hi))
        lead = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        s = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        later = (doc != doc[s]) | (at != at[s])
        equal = ~lead & ~later  # the same place of a repeated row: its own copy of the leading row
        out = _gone(doc[later], tag[later], at[later] + lo[later], at[later] + hi[later])
        if out is not None:
            yield out
        keep = lead | (equal & (tag != tag[s]))
        yield _batch(*(x[keep] for x in (h, c, doc, tag, at, lo, hi)), np.full(int(keep.sum()), ANCHOR))


class _Grouper:
    """Anchor rows ordered by (h, c, doc, at), those of a hash together: decides repeated contexts, asks for the bytes of the rest."""

    def __init__(self, hot: int):
        self.hot = hot

    def __call__(self, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.h = self.c = self.first = None
        self.leads: list[tuple] = []
        self.wide, self.out = False, []
        for batch in them:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            gone = cols[7] == GONE
            if gone.any():
                yield batch.filter(pa.array(gone))
                cols = [x[~gone] for x in cols]
            h = cols[0]
            if not len(h):
                continue
            same = h[1:] == h[:-1]
            alone = ~(np.append(False, same) | np.append(same, False))
            alone[0] = alone[-1] = False  # neighbours may stand in other batches
            for row in zip(*(x[~alone].tolist() for x in cols), strict=True):
                self._row(row)
            if len(self.out) > 20_000:
                yield self._flush()
        self._end()
        if self.out:
            yield self._flush()

    def _row(self, row: tuple) -> None:
        h, c, doc, _, at = row[:5]
        if h != self.h:
            self._end()
            self.h, self.wide = h, False
        elif c == self.c:
            if (doc, at) != self.first:
                self.out.append((*row[:7], GONE))
                return
        self.c, self.first = c, (doc, at)
        if self.wide:
            self.out.append((*row[:7], WANTED_HOT))
            return
        self.leads.append(row)
        if len(self.leads) > self.hot:
            self.wide = True
            self.out += [(*x[:7], WANTED_HOT) for x in self.leads]
            self.leads = []

    def _end(self) -> None:
        if len({x[1] for x in self.leads}) > 1:
            self.out += [(*x[:7], WANTED) for x in self.leads]
        self.leads = []

    def _flush(self) -> pa.RecordBatch:
        h, c, doc, tag, at, lo, hi, kind = (np.array(x, dtype=np.int64) for x in zip(*self.out, strict=True))
        self.out = []
        g = kind == GONE
        at, lo, hi = np.where(g, at + lo, at), np.where(g, 0, lo), np.where(g, hi - lo, hi)
        return _batch(h, c, doc, tag, at, lo, hi, kind)


#: n windows that start in bytes, the first at `at`; none: that window goes.
BYTES_SQL = "h long, doc long, tag int, at long, n int, bytes binary"


class _Extract:
    """Documents with their requests to the bytes asked for: one row for an anchor's run, or for each window of a hot anchor."""

    def __init__(self, length: int):
        self.length = length

    def __call__(self, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rows = self.length, []
        earliest: dict[int, tuple] = {}  # of the windows of hot anchors, by their hash
        for batch in them:
            for doc, tag, text, wanted in zip(*(batch.column(k) for k in range(4)), strict=True):
                doc, tag, data = doc.as_py(), tag.as_py(), (text.as_py() or "").encode()
                for w in wanted.as_py():
                    lo, hi = w["at"] + w["lo"], w["at"] + w["hi"]
                    if w["kind"] == WANTED:
                        rows.append((w["h"], doc, tag, lo, hi - lo + 1, data[lo : hi + length]))
                        continue
                    for s in range(lo, hi + 1):
                        piece = data[s : s + length]
                        own = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)
                        row, known = (own, doc, tag, s, 1, piece), earliest.get(own)
                        if known is None:
                            earliest[own] = row
                        elif known[5] != piece or known[1:4:2] == row[1:4:2]:
                            rows.append(row)
                        else:  # of equal windows in one task only the earliest goes on; the others are decided
                            earliest[own], late = (row, known) if row[1:4:2] < known[1:4:2] else (known, row)
                            rows.append((late[1], *late[1:4], 0, b""))
                if len(earliest) > 30_000:
                    rows += earliest.values()
                    earliest = {}
                if len(rows) > 5_000:
                    yield self._out(rows)
                    rows = []
        rows += earliest.values()
        if rows:
            yield self._out(rows)

    @staticmethod
    def _out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "doc", "tag", "at", "n", "bytes"])


class BlindTrie:
    """Strings of one length by the places where they differ; equal strings share a leaf."""

    def __init__(self, length: int):
        self.length, self.root = length, None

    def add(self, text: bytes, item: int) -> list[int]:
        """Put in a string; gives the items of its leaf, this one last."""
        if self.root is None:
            self.root = (text, [item])
            return self.root[1]
        node = self.root
        while len(node) == 3:  # (depth, branches, any leaf below)
            node = node[1].get(text[node[0]]) or node[2]
        known = node[0]
        if known == text:
            node[1].append(item)
            return node[1]
        differ = int.from_bytes(known, "big") ^ int.from_bytes(text, "big")
        depth = self.length - (differ.bit_length() + 7) // 8
        leaf = (text, [item])
        above, node = None, self.root
        while len(node) == 3 and node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        if len(node) == 3 and node[0] == depth:
            node[1][text[depth]] = leaf
            return leaf[1]
        some = node[2] if len(node) == 3 else node
        inner = (depth, {known[depth]: node, text[depth]: leaf}, some)
        if above is None:
            self.root = inner
        else:
            above[1][text[above[0]]] = inner
        return leaf[1]

    def ordered(self) -> Iterator[list[int]]:
        """Items of the leaves in the order of their strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def equal_suffixes(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> Iterator[np.ndarray]:
    """Index arrays of the suffixes of a group (`start` in `data`) that agree in `length` bytes, two and more.

    Multikey quicksort on characters of 8 bytes narrows the groups down to `shallow` bytes; what still ties goes
    to blind tries, whose leaves are the answer.
    """
    shallow = min(shallow, length) // 8 * 8
    live = np.arange(len(start))
    group = np.unique(group, return_inverse=True)[1] if len(group) else group
    for depth in range(0, shallow, 8):
        word = np.zeros(len(live), np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | data[start[live] + depth + k].astype(np.uint64)
        order = np.lexsort((word, group))
        live, group, word = live[order], group[order], word[order]
        new = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))[: len(live)]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        live, group = live[many], group[many]
    raw = data.tobytes()
    cuts = _runs(group)
    at = start[live].tolist()
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(live)], strict=True) if len(live) else ():
        trie = BlindTrie(length - shallow)
        for k in range(s, e):
            trie.add(raw[at[k] + shallow : at[k] + length], k)
        for leaf in trie.ordered():
            if len(leaf) > 1:
                yield live[leaf]


class _Sort:
    """Bytes ordered by h: windows that go."""

    def __init__(self, length: int, shallow: int):
        self.length, self.shallow = length, shallow

    def __call__(self, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for batch in them:
            if not batch.num_rows:
                continue
            held.append(batch)
            windows += int(np.sum(batch.column(4).to_numpy(zero_copy_only=False)))
            if windows > SORT_WINDOWS:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                h = whole.column(0).to_numpy(zero_copy_only=False)
                cut = int(_runs(h)[-1])  # the last group may go on
                if cut:
                    out = self._windows(whole.slice(0, cut))
                    if out is not None:
                        yield out
                    whole = whole.slice(cut)
                held, windows = [whole], int(np.sum(whole.column(4).to_numpy(zero_copy_only=False)))
        if held:
            out = self._windows(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            if out is not None:
                yield out

    def _windows(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        h, doc, tag, at, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        pieces = batch.column(5)
        places = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        w_doc, w_tag, w_at = doc[row], tag[row], at[row] + step
        gone = np.zeros(len(row), bool)
        known = n == 0
        for same in equal_suffixes(data, places[row] + step, h[row], self.length, self.shallow):
            first = min(zip(w_doc[same].tolist(), w_at[same].tolist(), strict=True))
            gone[same] = (w_doc[same] != first[0]) | (w_at[same] != first[1])
        w_doc, w_tag, w_at = (np.concatenate([x[gone], y[known]]) for x, y in ((w_doc, doc), (w_tag, tag), (w_at, at)))
        return _gone(w_doc, w_tag, w_at, w_at)


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_CONTEXTS, shallow: int = SHALLOW) -> DataFrame:
    """(doc, tag, at, hi): runs of windows that also occur earlier, from first start `at` to last start at + hi.

    docs: (doc, text, tag); doc without nulls, tag tells apart rows of one doc.
    """
    texts = docs.select("doc", "text", "tag")
    rows = texts.mapInArrow(tidy(_Mapper(length, gram)), ROWS_SQL)
    rows = rows.repartition("h").sortWithinPartitions("h", "c", "doc", "at").mapInArrow(tidy(_Grouper(hot)), ROWS_SQL)
    found = materialize(rows)
    wanted = (
        found.where(F.col("kind").isin(WANTED, WANTED_HOT))
        .groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("h", "at", "lo", "hi", "kind")).alias("wanted"))
    )
    pieces = texts.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "wanted").mapInArrow(tidy(_Extract(length)), BYTES_SQL)
    sorted_ = pieces.repartition("h").sortWithinPartitions("h", "doc", "at").mapInArrow(tidy(_Sort(length, shallow)), ROWS_SQL)
    deep = materialize(sorted_.select("doc", "tag", "at", "hi"))
    return found.where(F.col("kind") == GONE).select("doc", "tag", "at", "hi").unionByName(deep)


def spans(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs [start, end) of window runs (first start, last start minus first)."""
    out: list[list[int]] = []
    for at, more in sorted(ranges):
        end = at + more + length
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return [(s, e) for s, e in out]


def kept_text(data: bytes, cuts: list[tuple[int, int]]) -> str:
    """What is left as text; a character stays whole if any of its bytes stays."""
    out, at = [], 0
    for s, e in cuts:
        while s < len(data) and data[s] & 0xC0 == 0x80:
            s += 1  # the tail of a character whose head stays
        while e > 0 and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1  # the head of a character whose tail stays
        if e > s:
            out.append(data[at:s])
            at = e
    out.append(data[at:])
    return b"".join(out).decode("utf-8")


RESULT_SQL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


class _Apply:
    def __init__(self, length: int, text: bool):
        self.length, self.text = length, text

    def __call__(self, them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in them:
            for first in range(0, whole.num_rows, OUT_ROWS):
                yield self._made(whole.slice(first, OUT_ROWS))

    def _made(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        made: list[tuple] = []
        for text, ranges in zip(batch.column("_text"), batch.column("_ranges"), strict=True):
            text, ranges = text.as_py(), ranges.as_py()
            data = (text or "").encode()
            cuts = spans([(x["at"], x["hi"]) for x in ranges or ()], self.length)
            at, left = 0, []
            for s, e in cuts:
                left.append(data[at:s])
                at = e
            left.append(data[at:])
            digest = hashlib.sha256()
            for x in left:
                digest.update(x)
            kept = None if text is None or not self.text else kept_text(data, cuts)
            made.append((len(data), sum(e - s for s, e in cuts), len(cuts), digest.hexdigest(), kept))
        cols = [batch.column(k) for k in range(batch.num_columns - 2)]
        names = batch.schema.names[: len(cols)]
        new = [pa.array(x, t) for x, t in zip(zip(*made, strict=True) if made else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([*cols, *new], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def dedup(docs: DataFrame, carry: list[str] = (), keep_text: bool = True, length: int = LENGTH, **options) -> DataFrame:
    """Each row of `docs` (doc_id, text) with n_bytes, n_removed, n_spans, kept_sha256 and kept_text, and the columns of `carry`.

    A null text is empty (its kept_text stays null). Texts under `length` bytes lose nothing. A null doc_id ranks before
    all others. Rows that repeat a doc_id are versions of one document: the same place in another version is not
    earlier, so equal rows lose the same bytes. An empty table gives an empty one; carried columns pass unchanged.
    """
    carried = [F.col(f"`{x}`").alias(f"c{k}") for k, x in enumerate(carry)]
    base = docs.select(F.col("doc_id").alias("id"), id_key(F.col("doc_id")).alias("doc"), F.col("text").cast("string").alias("text"), *carried)
    base = base.withColumn("tag", (F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)) - F.lit(1 << 31)).cast("int"))
    gone = repeated_windows(base, length, **options).groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "hi")).alias("_ranges"))
    joined = base.join(gone, ["doc", "tag"], "left").select("id", *[f"c{k}" for k in range(len(carry))], F.col("text").alias("_text"), "_ranges")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    made = joined.mapInArrow(tidy(_Apply(length, keep_text)), f"{schema}, {RESULT_SQL}")
    names = [F.col(f"c{k}").alias(x) for k, x in enumerate(carry)]
    return made.select(F.col("id").alias("doc_id"), *names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def op8(docs: DataFrame) -> DataFrame:
    """Query form: the figures and the digest of what is left, for every document."""
    return dedup(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
