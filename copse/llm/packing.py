"""Sum-of-squares packing of tokenised documents into windows of equal size.

Each partition packs its documents online. Full windows are cut from a long document first; its rest is placed at the fill level
that minimises the sum of squares of the counts of partly filled windows, counts that a level array holds. What is still partly
filled when the partition ends, or when more than `most_open` windows are open, is closed by cutting the pieces of the emptiest
windows into the gaps of the fullest, so that at most one window of a partition is padded.

Partitions are packed apart, without a shuffle: sequence_id carries the partition's number above 33 bits. A retried task packs the
same rows again in the same order, provided that its input is a scan or a written table.

Defined results: a null or empty text is its end token alone. Repeated rows are packed each by itself. Null ids are kept. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.texts import batch, map_batches

CAPACITY = 2048
END_TOKEN = 1
#: Chunks whose ids a worker's cache holds, half of them those last used; only speed depends on it.
CACHE_CHUNKS = 300_000

#: White space on which str.split and the tokenizer might differ, and signs that make a text unfit for splitting.
_ODD_CODES = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)
_ODD = re.compile("[" + "".join(map(chr, _ODD_CODES)) + "]")
#: A sign before a comma or a stop: the tokenizer keeps runs of signs together, so such texts are not parted there.
_RUN = re.compile(r"(?:[^\w\s]|_)[.,]")
#: Of UTF-8: bytes that odd white space has, signs of ASCII and bytes beyond it, commas and stops. What they rule out needs no pattern.
_MAY_BE_ODD = np.isin(np.arange(256), (*range(0x1C, 0x20), *{chr(c).encode()[0] for c in _ODD_CODES if c >= 0x80}))
_MAY_RUN = np.array([c >= 128 or not (chr(c).isalnum() or chr(c).isspace()) for c in range(256)])
_PART = np.isin(np.arange(256), (44, 46))


class ChunkTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's on whole texts.

    For a tokenizer that lower-cases, drops white space, never joins over it and keeps letters and signs apart
    (`word_bpe_49k.json`), a text's ids are those of its white-space chunks in order, commas and stops may be chunks of their own,
    and Latin-1 texts may be lower-cased first. Chunks are looked up in a cache and only new ones are tokenised, many in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, text: str | None) -> list[str] | None:
        """Chunks that can be tokenised apart; None if the text has to be tokenised whole."""
        if not text:
            return []
        codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if _MAY_BE_ODD[codes].any() and _ODD.search(text):
            return None
        try:
            text.encode("latin-1")
            if "<|" not in text:  # special tokens keep their case
                text = text.lower()
        except UnicodeEncodeError:
            pass
        at = np.flatnonzero(_PART[codes[1:]])
        return (text if _MAY_RUN[codes[at]].any() and _RUN.search(text) else text.replace(",", " ,").replace(".", " .")).split()

    def _learn(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Chunks of letters alone are one piece each: their ids end where a token ends a word. Others are tokenised each by itself."""
        words, others = [], []
        for c in new:
            (words if c.isalpha() else others).append(c)
        runs = [words[i : i + 512] for i in range(0, len(words), 512)]
        for part, found in zip(runs, self._ids([" ".join(part) for part in runs]), strict=True):
            stops = (np.flatnonzero(self.ends[found]) + 1) * 4
            if len(stops) == len(part):
                whole, ends = found.tobytes(), stops.tolist()
                yield from zip(part, [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True)
            else:
                others += part
        yield from zip(others, (x.tobytes() for x in self._ids(others)), strict=True)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _know(self, wanted: set[str]) -> None:
        """Puts the ids of every chunk wanted into the newer half of the cache. Those there already are passed over as a set."""
        chunks, older, new = self.chunks, self.older.get, []
        for w in wanted.difference(chunks):
            x = older(w)
            if x is None:
                new.append(w)
            else:
                chunks[w] = x
        chunks.update(self._learn(new))

    def rest(self) -> None:
        """Halves the cache between tasks: idle workers hold little."""
        self.older = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        self._know(set().union(*(c for c in split if c)))
        ids = self.chunks.__getitem__
        out = [self.whole(t) if c is None else b"".join(map(ids, c)) for t, c in zip(texts, split, strict=True)]
        if len(self.chunks) > CACHE_CHUNKS // 2:  # chunks that were not used since the cache was half full go first
            self.older, self.chunks = self.chunks, {}
        return out


class Packer:
    """Places pieces online; emit(window, pieces) gets every closed window once. A piece is (document, start, ids)."""

    def __init__(self, capacity: int = CAPACITY, most_open: int = 4096):
        self.capacity, self.most_open = capacity, most_open
        self.levels = np.zeros(capacity + 1, np.int64)  # partly filled windows by fill level
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def add(self, doc, ids: bytes) -> Iterator[list]:
        """Yields the windows that this document closes."""
        cap, n = self.capacity, len(ids) // 4
        full = n // cap * cap
        for at in range(0, full, cap):
            yield [(doc, at, ids[4 * at : 4 * (at + cap)])]
        if n > full:
            yield from self._place((doc, full, ids[4 * full :]), n - full)

    def _place(self, piece: tuple, size: int) -> Iterator[list]:
        cap, levels = self.capacity, self.levels
        # Change of the sum of squares, halved and less a constant, when a window of level h takes the piece; level 0 opens one.
        change = levels[size:] - levels[: cap + 1 - size] + 0.5
        change[-1] -= 0.5  # a window that becomes full is counted no more
        change[1:][levels[1 : cap + 1 - size] == 0] = np.inf
        change[0] = levels[size]
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        if level == 0:
            window = []
        else:
            window = self.open[level].pop()
            levels[level] -= 1
            self.n_open -= 1
        window.append(piece)
        if level + size == cap:
            yield window
            return
        self.open.setdefault(level + size, []).append(window)
        levels[level + size] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            yield from self.drain()

    def drain(self) -> Iterator[list]:
        """Closes all open windows, at most one of them not full."""
        held = [(level, window) for level in sorted(self.open, reverse=True) for window in self.open[level]]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        i, j = 0, len(held) - 1
        windows, fill = [w for _, w in held], [f for f, _ in held]
        while i < j:
            if fill[i] == self.capacity:
                yield windows[i]
                i += 1
                continue
            doc, start, ids = windows[j].pop()
            take = min(self.capacity - fill[i], len(ids) // 4)
            windows[i].append((doc, start, ids[: 4 * take]))
            fill[i] += take
            fill[j] -= take
            if len(ids) > 4 * take:
                windows[j].append((doc, start + take, ids[4 * take :]))
            if not windows[j]:
                j -= 1
        if held:
            yield windows[i]


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def pack(docs: DataFrame, tokenize: Callable[[], Callable[[list], list[bytes]]], *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    tokenize: makes a worker's function from texts to ids as bytes.
    """
    tail = np.array([end_token], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = tokenize(), Packer(capacity)
        sequence = TaskContext.get().partitionId() << 33

        def rows(windows) -> Iterator[tuple]:
            nonlocal sequence
            for window in windows:
                offset = 0
                for (doc, total), start, ids in window:
                    yield doc, start, len(ids) // 4, ids, total, sequence, offset
                    offset += len(ids) // 4
                sequence += 1

        def sent(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return batch(_NAMES, *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)))

        for b in batches:
            found = []
            ids = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            for doc, got in zip(ids, encode(texts), strict=True):
                found += rows(packer.add((doc, len(got) // 4 + 1), got + tail))
            if found:
                yield sent(found)
        if found := list(rows(packer.drain())):
            yield sent(found)
        if hasattr(encode, "rest"):
            encode.rest()

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text"), work, _SCHEMA)


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> Callable[[], ChunkTokenizer]:
    """For pack: the worker's own tokenizer, kept with its caches from task to task."""

    def make() -> ChunkTokenizer:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from copse.llm import packing

        if path not in packing._TOKENIZERS:
            packing._TOKENIZERS[path] = ChunkTokenizer(path)
        return packing._TOKENIZERS[path]

    return make


def packing_report(docs: DataFrame, path: str, **options) -> DataFrame:
    """One row per piece with the checksum of its ids in place of the ids."""
    return pack(docs, chunk_tokenizer(path), **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
