"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by shingle width and by size (neighbouring bounds differ by a quarter), and every partition has its own
MinHash index with one row per band. Of a document, only shingles that some item of the partition has can count, so the windows
that are searched run over those, in document order: 1.5 times the partition's largest item wide, half of it apart, so any run as
long as an item lies whole in a window. An item of which a share of 0.8 is present has a Jaccard similarity above 0.38 with its
window; with 48 functions it is missed with a probability below 1e-9. Candidates are verified against the whole document.

Documents are read once per block of items and never shuffled. Items go to the workers in blocks of at most `block_items` rows, so
a benchmark of any size is searched with bounded memory.

Defined results: null texts count as empty; items without words match nothing. Items of fewer words than a shingle are looked for
as one run of all their words. Repeated documents are each reported; repeated items are reported by their ids. Empty tables give
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.texts import SHINGLE, SLICE, batch, give_back, map_batches, mix, shingle_hashes, small_batches, word_runs

FUNCTIONS = 48
PERCENT = 80
BLOCK_ITEMS = 20_000
_GATE_BITS = 20
_SEEDS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64))


def signatures(h: np.ndarray) -> np.ndarray:
    """The values of every function at every shingle: shingles x FUNCTIONS."""
    return mix(h[:, None] ^ _SEEDS[None, :])


@dataclass
class Partition:
    """Items of one width whose sizes lie under one bound."""

    width: int
    upper: int
    items: np.ndarray  # positions in the block
    sets: list[np.ndarray]
    universe: np.ndarray  # sorted
    gate: np.ndarray  # by the top bits of a hash: some item has such a shingle
    values: np.ndarray  # FUNCTIONS x items, each row sorted
    order: np.ndarray

    def candidates(self, hits: np.ndarray) -> np.ndarray:
        """Positions in items whose minimum some window of the hits shares."""
        step = max(1, self.upper // 2)
        low = np.minimum.reduceat(signatures(hits), np.arange(0, len(hits), step), axis=0)
        spans = [low]
        for i in (1, 2):
            shifted = np.full_like(low, np.iinfo(np.uint64).max)
            shifted[: len(low) - i] = low[i:]
            spans.append(shifted)
        low = np.minimum.reduce(spans)
        found = []
        for k in range(FUNCTIONS):
            seen = np.unique(low[:, k])
            a, b = np.searchsorted(self.values[k], seen), np.searchsorted(self.values[k], seen, side="right")
            found += [self.order[k, x:y] for x, y in zip(a[b > a], b[b > a], strict=True)]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def words_of_each(texts: pa.Array) -> list[np.ndarray]:
    words, bounds = word_runs(texts)
    return np.split(words, bounds[1:-1]) if len(texts) else []


def partitions(texts: list[str | None], width: int = SHINGLE) -> list[Partition]:
    by: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, words in enumerate(words_of_each(pa.array(texts, pa.large_string()))):
        if not len(words):
            continue
        s = np.unique(shingle_hashes(words, width))
        bound = 1
        while bound < len(s):
            bound = max(bound + 1, bound * 5 // 4)
        by.setdefault((min(width, len(words)), bound), []).append((i, s))
    out = []
    for (w, upper), members in sorted(by.items(), key=lambda x: x[0]):
        sets = [s for _, s in members]
        universe = np.unique(np.concatenate(sets))
        gate = np.zeros(1 << _GATE_BITS, bool)
        gate[(universe >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True
        sig = np.array([signatures(s).min(axis=0) for s in sets]).T
        order = np.argsort(sig, axis=1, kind="stable")
        out.append(Partition(w, upper, np.array([i for i, _ in members]), sets, universe, gate, np.take_along_axis(sig, order, axis=1), order))
    return out


class Searcher:
    def __init__(self, texts: list[str | None], percent: int = PERCENT):
        self.parts, self.percent = partitions(texts), percent
        self.widths = sorted({p.width for p in self.parts})
        self.gates = {w: np.logical_or.reduce([p.gate for p in self.parts if p.width == w]) for w in self.widths}

    def find(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item position, shingles of the item, shingles present) of every item whose share in a whole text, its word hashes, reaches the percentage."""
        out = []
        for w in self.widths:
            if len(words) < w:
                continue
            h = shingle_hashes(words, w)
            h = h[self.gates[w][(h >> np.uint64(64 - _GATE_BITS)).astype(np.int64)]]
            if not len(h):
                continue
            for p in self.parts:
                if p.width != w:
                    continue
                near = h[p.gate[(h >> np.uint64(64 - _GATE_BITS)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(p.universe, near), len(p.universe) - 1)
                hits = near[p.universe[at] == near]
                if not len(hits):
                    continue
                present = np.unique(hits)
                _, first = np.unique(hits, return_index=True)
                hits = hits[np.sort(first)]
                for k in p.candidates(hits):
                    shared = int(np.isin(p.sets[k], present, assume_unique=True).sum())
                    if 100 * shared >= self.percent * len(p.sets[k]):
                        out.append((int(p.items[k]), len(p.sets[k]), shared))
        return sorted(out)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_items: int) -> Iterator[list]:
    """The items in blocks of at most block_items rows, each fetched by itself."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    n = -(-items.count() * 5 // (4 * block_items)) or 1
    for k in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted(mine.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        for i in range(0, len(rows), block_items):
            yield rows[i : i + block_items]


_SCHEMA = "doc_id long, item_id long, item_shingles long, shared long, containment double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row for every document and item found in it: doc_id, item_id, item_shingles, shared, containment."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, block_items):
        searcher, ids = Searcher([r["text"] for r in items], percent), [r["item_id"] for r in items]

        def work(batches: Iterator[pa.RecordBatch], searcher=searcher, ids=ids) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(d, ids[i], n, k, k / n) for d, words in zip(b.column(0).to_pylist(), words_of_each(b.column(1)), strict=True) for i, n, k in searcher.find(words)]
                if found:
                    kinds = [pa.int64()] * 4 + [pa.float64()]
                    yield batch([x.split()[0] for x in _SCHEMA.split(", ")], *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)))

        part = map_batches(rows, work, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], _SCHEMA) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """docs without the rows that hold an item. All columns stay; only the text goes to Python."""
    small_batches(docs.sparkSession)
    for items in _blocks(benchmark, item_col, item_text_col, block_items):
        searcher = Searcher([r["text"] for r in items], percent)

        docs = docs.where(_clean(searcher)(F.col(text_col).cast("string")))
    return docs


def _clean(searcher: Searcher):
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        parts = [text.slice(i, SLICE) for i in range(0, len(text), SLICE)]
        found = pa.array([not searcher.find(words) for part in parts for words in words_of_each(part)], pa.bool_())
        give_back()
        return found

    return clean
