"""Token ids of whole texts by a `tokenizers` file, fast on repeated words.

The vocabulary lower-cases, drops white space and cuts where `chunks` says, so a text's ids are those of its chunks.
Chunks are found and numbered by numpy and Arrow; each distinct one is encoded once and kept, and a text's ids come
from array gathers. Unknown words of letters are encoded together in one text: each gives ids of which only the last one
ends a word.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from spanloom.llm.chunks import LETTER, SPACE, Known, binaries, changes, classes, parts, ragged
from spanloom.llm.common import worker_cache

#: Distinct chunks kept in a worker.
KNOWN = 600_000
#: Bytes of text whose chunks are numbered together; a longer text is a block of its own.
BLOCK_BYTES = 1_000_000
#: Id that ends every document.
END = 2
VOCABULARY = "word_bpe_49k.json"
SENTENCE_ENDS = tuple(x.encode() for x in ".!?…。！？")
CLOSERS = "\"'”’»)]"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class WordIds(Known):
    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), known
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.ends = np.zeros(0, bool)

    def _store(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray, ends: list[bool] | bool) -> None:
        to = self.add(chunks, ids, sizes)
        self.ends = np.concatenate([self.ends, np.zeros(len(self.start) - len(self.ends), bool)])
        self.ends[to] = ends

    def _separately(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        made = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = [t.rstrip(CLOSERS).encode().endswith(SENTENCE_ENDS) for t in texts]
        self._store(chunks, np.array([i for x in made for i in x], np.uint32), np.array([len(x) for x in made], np.int64), ends)

    def _learn(self, new: list[bytes], word: list[bool]) -> None:
        words, odd = [], []
        for chunk, plain in zip(new, word, strict=True):
            (words if plain else odd).append(chunk)
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                self._store(words, ids, np.diff(ends, prepend=0), False)
            else:
                self._separately(words)
        if odd:
            self._separately(odd)

    def _codes(self, chunks: pa.Array) -> np.ndarray:
        """Numbers of distinct chunks, all of them known from now on."""
        names = chunks.to_pylist()
        found = np.array(list(map(self.code.get, names, [-1] * len(names))), np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            if len(self.code) + len(new) > self.known:
                self.forget()
                new = np.arange(len(names))
            data, at = parts(chunks)
            word = np.logical_and.reduceat(classes(data) == LETTER, at[:-1])
            self._learn([names[k] for k in new.tolist()], word[new].tolist())
            found[new] = [self.code[names[k]] for k in new.tolist()]
        return found

    def encode(self, column: pa.Array | list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text of a string array or list its ids with END, as uint32, and the counts of ids after which a sentence ends,
        ascending, the last at the end. A null is an empty text.

        A text that holds one of the file's own special strings is left to the tokenizer as a whole.
        """
        data, at = parts(column if isinstance(column, pa.Array) else pa.array(column, pa.string()))
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, side="right")) - 1)
            yield from self._block(data[at[first] : at[last]], at[first : last + 1] - at[first])
            first = last

    def _block(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        raw = data.tobytes()
        whole = {}
        if any(x in raw for x in self.special):
            for k, (s, e) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
                if any(raw.find(x, s, e) >= 0 for x in self.special):
                    whole[k] = np.array([*self.tokenizer.encode(raw[s:e].decode(), add_special_tokens=False).ids, END], np.uint32)
        kind = classes(data)
        black = kind != SPACE
        begins = changes(kind) & black
        begins[1:] |= black[1:] & ~black[:-1]
        edge = at[:-1][at[:-1] < at[1:]]
        begins[edge] = black[edge]
        starts = np.flatnonzero(begins)
        # White space goes, so that chunks fill the bytes.
        seen = np.zeros(len(data) + 1, np.int32)
        np.cumsum(black, dtype=np.int32, out=seen[1:])
        close = _LOWER[data[black]]
        if len(starts):
            numbered = binaries(close, seen[starts]).dictionary_encode()
            codes = self._codes(numbered.dictionary)[numbered.indices.to_numpy()]
        else:
            codes = np.zeros(0, np.int64)
        run, total = ragged(self.start[codes], self.size[codes])
        ids = self.flat[run]
        # A sentence ends after a chunk that closes one and stands before white space, and at line feeds.
        stop = np.append(starts[1:], len(data))
        stop = np.minimum(stop, at[np.searchsorted(at, starts, side="right")])
        size = seen[stop] - seen[starts]
        feeds = np.flatnonzero(data == 10)
        cuts = (self.ends[codes] & (stop - starts > size)) | (np.searchsorted(feeds, stop) > np.searchsorted(feeds, starts))
        cuts = total[1:][cuts]
        cuts = cuts[np.append(True, cuts[1:] > cuts[:-1])[: len(cuts)]]
        bounds = total[np.searchsorted(starts, at)].tolist()
        low, high = np.searchsorted(cuts, bounds[:-1], side="right").tolist(), np.searchsorted(cuts, bounds[1:], side="left").tolist()
        for k, (s, e, a, b) in enumerate(zip(bounds, bounds[1:], low, high, strict=False)):
            if k in whole:
                yield whole[k], np.array([len(whole[k])])
            else:
                yield np.append(ids[s:e], np.uint32(END)), np.append(cuts[a:b] - s, e - s + 1)


_KEPT: dict[str, WordIds] = worker_cache()


def word_ids(path: str) -> WordIds:
    """The worker's encoder for a vocabulary file."""
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]
