"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent in numpy.

A text's subwords are all byte runs of 2 to 4 over its letters, words being parted by one space. Their embeddings are averaged
over the whole text and a softmax names the language. A temperature fitted on held-back sample rows calibrates the probability,
and texts whose calibrated probability is under a threshold fitted there are rejected.

Learning takes a bounded sample: at most `per_language` rows of each language and `max_rows` rows in all, shared evenly among the
languages; the rows of a language are those of the smallest hashes of id and text, equal rows once. Everything is scored.

Defined results: a text that is null or has no letter gets "und" with score 0 and is rejected. With no labelled row at all, every
text gets "und". Null ids count as not held out and hash like any value. Rows without lang are scored and not learned from.
Repeated rows are treated alike, an empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.texts import batch, map_batches, raw, small_batches

BUCKET_BITS = 15
ORDERS = (2, 3, 4)
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Letters and bytes from 0x80 stay, A-Z is lower-cased, every other byte becomes a space.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(128)).lower() + bytes(range(128, 256))


def subwords(text: str | None) -> np.ndarray:
    """Bucket numbers of all subwords of a whole text."""
    flat = b" " + b" ".join(raw(text).translate(_LETTERS).split()) + b" "
    codes = np.frombuffer(flat, np.uint8).astype(np.uint32)
    out = []
    run = codes
    for order in range(2, max(ORDERS) + 1):
        run = (run[:-1] << np.uint32(8)) | codes[order - 1 :] if len(run) > 1 else run[:0]
        if order in ORDERS:
            out.append(((run * np.uint32(2654435761) + np.uint32(order * 40503)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


def counts(text: str | None) -> np.ndarray:
    return np.bincount(subwords(text), minlength=1 << BUCKET_BITS).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times output weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, text: str | None) -> np.ndarray:
        seen = np.bincount(subwords(text), minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(seen)
        n = max(1, int(seen[at].sum()))
        return softmax((seen[at].astype(np.float32) @ self.table[at] / n + self.bias)[None] / self.temperature)[0]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, rejected."""
        if not self.languages or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        p = self.probabilities(text)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], *, dims: int = 16, epochs: int = 12, rate: float = 0.5, size: int = 64, seed: int = 7, false_rejects: float = 0.001
) -> Model:
    """texts: (buckets, counts) of each row. The last fifth of a fixed shuffle is held back for the temperature and the threshold.

    The threshold rejects at most the share false_rejects of the held-back texts that are classified rightly, and never a text
    with a probability of a half or more.
    """
    languages = sorted(set(labels))
    model = Model(languages, np.zeros((1 << BUCKET_BITS, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    if not languages:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    y = np.array([languages.index(x) for x in labels])
    fit, back = order[: max(1, len(order) - len(order) // 5)], order[max(1, len(order) - len(order) // 5) :]

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), 1 << BUCKET_BITS), np.float32)
        for i, r in enumerate(rows):
            at, n = texts[r]
            x[i, at] = n / max(1, n.sum())
        return x

    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, dims)).astype(np.float32)
    out = rng.normal(0, 0.1, (dims, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    # Averages are small where a text has many subwords, so embeddings move in units of a typical bucket's share.
    scale = np.float32(200.0)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in range(0, len(fit), size):
            rows = rng.permutation(fit)[:size] if len(fit) > size else fit
            x = dense(rows)
            hidden = x @ emb
            error = softmax(hidden @ out + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back_out, back_emb = hidden.T @ error, x.T @ (error @ out.T)
            out -= step * back_out * 10
            emb -= step * back_emb * scale
            bias -= step * error.sum(axis=0)
    model.table, model.bias = (emb @ out).astype(np.float32), bias
    held = back if len(back) else fit
    logits = np.concatenate([dense(held[i : i + 256]) @ model.table + bias for i in range(0, len(held), 256)])
    grid = np.geomspace(0.02, 4, 60)
    loss = [-np.log(np.clip(softmax(logits / t)[np.arange(len(held)), y[held]], 1e-9, 1)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[held]])
    model.threshold = float(min(0.5, right[int(len(right) * false_rejects)])) if len(right) else 0.0
    return model


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def _sample_work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, n = [], []
        for t in b.column(1).to_pylist():
            c = counts(t)
            at.append(np.flatnonzero(c).astype(np.int32))
            n.append(c[at[-1]])
        yield batch(["lang", "at", "n"], b.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32())))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2, per_language: int = 600, max_rows: int = 6000) -> Model:
    """Learns from rows with a language whose crc32 remainder is not `held`. The sample's rows are bounded by the two parameters."""
    known = docs.where(F.col(lang_col).isNotNull() & (remainder(id_col, modulus) != held))
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    h = F.xxhash64(F.col(id_col), text)
    draw = F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = known.groupBy(lang.alias("lang")).agg(F.approx_count_distinct(h).alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()
    if not sizes:
        return train([], [])
    share = max(1, min(per_language, max_rows // len(sizes)))
    # About six deviations more than the share are let through at first; of those, only languages and hashes come to the driver.
    bar = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, (share + 6 * share**0.5 + 10) / max(1, r["n"]))))])
    near = known.select(lang.alias("lang"), text.alias("text"), draw.alias("draw")).where(F.col("draw") < F.element_at(bar, F.col("lang")))
    drawn: dict[str, list[float]] = {}
    for r in near.select("lang", "draw").distinct().collect():
        drawn.setdefault(r["lang"], []).append(r["draw"])
    cut = F.create_map(*[x for k, v in drawn.items() for x in (F.lit(k), F.lit(sorted(v)[:share][-1]))])
    picked = near.where(F.col("draw") <= F.element_at(cut, F.col("lang"))).dropDuplicates(["lang", "draw"]).select("lang", "text")
    rows = map_batches(picked, _sample_work, "lang string, at array<int>, n array<float>").toArrow()
    got = sorted(zip(rows["lang"].to_pylist(), rows["at"].to_numpy(), rows["n"].to_numpy(), strict=True), key=lambda r: (r[0], len(r[1]), r[1].tolist()[:50], r[2].tolist()[:50]))
    return train([(a, n) for _, a, n in got], [x for x, _, _ in got])


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected. One narrow pass over whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t) for t in b.column(2).to_pylist()]
            yield batch(
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_()),
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, modulus) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, work, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; all columns stay. Only the text goes to Python."""

    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def keeps(text: pa.Array) -> pa.Array:
        return pa.array([not model.predict(t)[2] for t in text.to_pylist()], pa.bool_())

    return docs.where(keeps(F.col(text_col).cast("string")))
