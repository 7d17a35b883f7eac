"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

Every feature is cut into bins; boosting goes round the features, each time fitting a tree of few leaves over the bins of one
feature to the current gradients and adding it to that feature's lookup table. The pairs that explain most of what is left get
two-way tables, grown in the same way by trees that split one feature and then the other. A score is the logistic function of the
sum of the looked-up values, taken for a whole batch at once.

Learning takes a bounded sample of labelled rows: the `sample` labels with the smallest hashes of their ids. Should ids repeat among
the documents, at most `sample * per_label` rows are kept in all, those with the smallest hashes of id and text.

Defined results: null and empty texts have all features 0 and are scored like any text. Labels that are null are not learned
from; with no label, or only one class, the score is the smoothed share of label 1 (0.5 without labels). Null ids count as not
held out and match no label. Repeated rows are scored alike, an empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.texts import batch, map_batches, raw

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_STOPS = b".,;:!?'\"()-"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOPS)
FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "upper", "digit", "mark", "stop", "high_bytes",
    "log_lines", "distinct_lines", "mean_line", "short_lines", "ended_lines", "top_word", "marked_words", "repeat_pairs",
)


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    b = raw(text)
    words = b.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, k = len(b), len(words)
    left = lambda drop: (n - len(b.translate(None, drop))) / n
    lines = [x for x in b.split(b"\n") if x.strip()]
    kinds = set(words)
    some = max(kinds, key=len)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), float(np.log1p(k)), sum(map(len, words)) / k, float(len(some)), len(kinds) / k, left(_UPPER), left(_DIGIT), left(_MARKS), left(_STOPS),
        (n - len(b.translate(None, bytes(range(128, 256))))) / n, float(np.log1p(len(lines))), len(set(lines)) / len(lines), sum(map(len, lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), max(tally.values()) / k,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / k, 1 - pairs / max(1, k - 1) if k > 1 else 0.0,
    ]


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Vectorised bin additions over the rows of x."""
        total = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of an ordered histogram; the place is the first bin of the right side."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree over one feature's bins, grown best leaf first: the step of each bin."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        gain, at, i = max((*_best_cut(g[a:b], h[a:b], ridge), i) for i, (a, b) in enumerate(spans))
        if gain <= 1e-9:
            break
        a, b = spans.pop(i)
        spans += [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in spans:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A tree that cuts one feature, then the other on each side: gain and steps. The best first cut of both orders, looking one level ahead."""
    best, whole = (0.0, np.zeros_like(g)), g.sum() ** 2 / (h.sum() + ridge)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        up, uph = np.cumsum(gg, axis=0), np.cumsum(hh, axis=0)
        for at in range(1, len(gg)):
            sides = ((up[at - 1], uph[at - 1]), (up[-1] - up[at - 1], uph[-1] - uph[at - 1]))
            cuts = [_best_cut(sg, sh, ridge) for sg, sh in sides]
            gain = sum(sg.sum() ** 2 / (sh.sum() + ridge) + more for (sg, sh), (more, _) in zip(sides, cuts, strict=True)) - whole
            if gain <= best[0]:
                continue
            step = np.zeros_like(gg)
            for rows, (sg, sh), (_, cut) in zip((slice(0, at), slice(at, None)), sides, cuts, strict=True):
                for part in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                    step[rows, part] = -sg[part].sum() / (sh[part].sum() + ridge)
            best = (float(gain), step.T if turned else step)
    return best


def train(x: np.ndarray, y: np.ndarray, *, bins: int = 32, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, leaves: int = 4, rate: float = 0.1, ridge: float = 5.0) -> Gam:
    share = (y.sum() + 1) / (len(y) + 2)
    gam = Gam(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return gam
    wide = x.shape[1]
    gam.edges = [_cuts(x[:, j], bins) for j in range(wide)]
    gam.pair_edges = [_cuts(x[:, j], pair_bins) for j in range(wide)]
    gam.tables = [np.zeros(len(c) + 1) for c in gam.edges]
    at = [np.searchsorted(gam.edges[j], x[:, j], side="right") for j in range(wide)]
    total = np.full(len(y), gam.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(wide):
            g, h = slopes()
            n = len(gam.tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), leaves, ridge)
            gam.tables[j] += step
            total += step[at[j]]
    pair_at = [np.searchsorted(gam.pair_edges[j], x[:, j], side="right") for j in range(wide)]
    size = [len(c) + 1 for c in gam.pair_edges]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(pair_at[a] * size[b] + pair_at[b], v, size[a] * size[b]).reshape(size[a], size[b])

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h), ridge)[0], a, b) for a in range(wide) for b in range(a)), reverse=True)
    gam.pairs = [(a, b) for gain, a, b in gains[:pairs] if gain > 0]
    gam.pair_tables = [np.zeros((size[a], size[b])) for a, b in gam.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(gam.pairs):
            g, h = slopes()
            step = rate * _pair_tree(grid(a, b, g), grid(a, b, h), ridge)[1]
            gam.pair_tables[k] += step
            total += step[pair_at[a], pair_at[b]]
    return gam


def _remainder(modulus: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held: int = 1, sample: int = 12_000, per_label: int = 4, **options) -> Gam:
    """Learns label_col from at most `sample` labels, and `sample * per_label` rows, whose crc32 remainder is not `held`.

    The labels of the sample are broadcast, a size the parameter bounds; the rows are ordered by hash before they are bounded, so the
    model does not depend on the order or the number of partitions.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    picked = known.where(_remainder(modulus) != held).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("y", F.xxhash64("doc_id", "text").alias("h"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(["y", "h", "x"], b.column(0), b.column(1), pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64())))

    got = map_batches(rows, work, "y int, h long, x array<double>").orderBy("h", "y").limit(sample * per_label).toArrow()
    y = np.array(got["y"].to_pylist(), float)
    x = np.array(got["x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the same model however the rows arrive
    return train(x[order], y[order], **options)


def score(docs: DataFrame, gam: Gam, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. One narrow pass over whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(2).to_pylist()], float).reshape(b.num_rows, len(FEATURES))
            p = gam.score(x)
            yield batch(["doc_id", "held_out", "score", "predicted"], b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", (_remainder(modulus) == held).alias("held_out"), "text")
    return map_batches(rows, work, "doc_id long, held_out boolean, score double, predicted int")
