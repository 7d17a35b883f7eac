"""Forests that are too large for the driver: trees packed by the tasks that grew them, kept as a table in the shared folder.

Rows meet them in a product of chunks of rows with the table of trees, which Spark reads where it lies: a worker opens one tree at a
time for many rows, and neither the driver nor a worker holds the forest or a copy of it on its disk.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copse.operators.grow import imp_arrays, imp_lists
from copse.operators.traverse import CAT, LEAF, NUM, PLANE, Tree

#: Rows that a worker takes through a forest of packed trees at once, and nodes that it holds opened.
CHUNK, OPEN_NODES = 131_072, 100_000
PACKED = "tree int, n_nodes int, sent binary, rest binary"


def _thin(v):
    """Arrays as bytes that compress well: numbers of nodes by their differences, 8-byte numbers as 8 planes of bytes."""
    if isinstance(v, np.ndarray) and v.dtype == np.int32 and v.ndim == 1:
        return "steps", np.diff(v, prepend=np.int32(0)).astype(np.int32)
    if isinstance(v, np.ndarray) and v.dtype in (np.float64, np.int64):
        return "planes", v.shape, v.dtype.str, np.ascontiguousarray(v.reshape(-1, 1).view(np.uint8).T) if v.size else None
    return tuple(_thin(x) for x in v) if isinstance(v, tuple) else v


def _thick(v):
    if isinstance(v, tuple) and v and isinstance(v[0], str) and v[0] == "steps":
        return np.cumsum(v[1], dtype=np.int32)
    if isinstance(v, tuple) and v and isinstance(v[0], str) and v[0] == "planes":
        return np.empty(v[1], v[2]) if v[3] is None else np.ascontiguousarray(v[3].T).view(v[2]).reshape(v[1])
    return tuple(_thick(x) for x in v) if isinstance(v, tuple) else v


def _bytes(state: dict) -> bytes:
    raw = pickle.dumps({k: _thin(v) for k, v in state.items()}, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _state(data: bytes) -> dict:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return {k: _thick(v) for k, v in pickle.loads(raw).items()}


def packed(tree: Tree) -> bytes:
    state = tree.__getstate__()
    if (tree.left == np.where(tree.kind == LEAF, 0, np.arange(len(tree.kind)) + 1)).all():
        del state["left"]
    if not tree.rules.penalize_range:
        state = {k: v for k, v in state.items() if k not in ("lo", "hi")}
    return _bytes(state)


def unpacked(data: bytes) -> Tree:
    tree, state = Tree.__new__(Tree), _state(data)
    inner = state["kind"] != LEAF
    tree.__setstate__({"left": np.where(inner, np.arange(len(inner)) + 1, 0).astype(np.int32)} | state)
    if tree.imp is not None and len(tree.imp) > 2:  # as it was grown
        tree.imp = imp_arrays(tree.imp)
    return tree


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, float).view(np.int64)


def rest_of(nodes: pd.DataFrame) -> bytes:
    """What node rows have besides the packed tree. Numbers that others nearly tell are kept as the bits in which they differ from that."""
    n, lo, hi, split = (nodes[c].to_numpy(float, na_value=np.nan) for c in ("n", "lo", "hi", "split"))
    left, right = nodes["left"].to_numpy(), nodes["right"].to_numpy()
    inner, bits = left > 0, _bits(n).copy()
    bits[inner] ^= _bits(n[left[inner]] + n[right[inner]])
    more = {"n": bits, "lo": lo, "hi": _bits(hi) ^ _bits(2 * split - lo), "remainder": nodes["remainder"].to_numpy(float)}
    return _bytes(more | {"parent": nodes["parent"].to_numpy(np.int32), "cat_right": [list(v) for v in nodes["cat_right"] if v is not None]})


def _told(tree: Tree, rest: dict, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n and hi of rest_of."""
    bits, inner = rest["n"].copy(), tree.kind != LEAF
    for d in range(tree.steps, -1, -1):
        i = np.flatnonzero(inner & (tree.depth == d))
        n = bits.view(np.float64)
        bits[i] ^= _bits(n[tree.left[i]] + n[tree.right[i]])
    return bits.view(np.float64), (rest["hi"] ^ _bits(2 * split - rest["lo"])).view(np.float64)


def _frame(number: int, tree: Tree, rest: dict) -> pd.DataFrame:
    kind, n_num = tree.kind, tree.rules.n_num
    names, known = np.array(["leaf", "num", "subset", "hplane"], object)[kind], lambda v, where: np.where(where, v, np.nan)
    cats, planes, leaves = (np.flatnonzero(kind == k) for k in (CAT, PLANE, LEAF))
    names[cats[tree.cat_single[: len(cats)]]] = "single"
    lists = {c: np.full(len(kind), None, object) for c in ("cat_left", "cat_right", "terms", "imp")}
    for k, i in enumerate(cats):
        lists["cat_left"][i], lists["cat_right"][i] = np.flatnonzero(tree.cat_side[k] == 1).tolist(), rest["cat_right"][k]
    for k, i in enumerate(planes):
        lists["terms"][i] = terms = []
        for d in np.flatnonzero(tree.t_col[k] >= 0):
            c = int(tree.t_col[k, d])
            levels = [None if v != v else v for v in tree.t_cats[k, d, : tree.rules.n_levels[c - n_num]].tolist()] if c >= n_num else None
            terms.append({"col": c, "coef": float(tree.t_coef[k, d]), "mean": float(tree.t_mean[k, d]), "cats": levels, "fill": float(tree.t_fill[k, d]), "fill_new": float(tree.t_new[k, d])})
    if tree.imp is not None:
        for i, found in zip(leaves, imp_lists(*tree.imp, tree.rules.n_levels), strict=True):
            lists["imp"][i] = found
    split = known(tree.split, (kind == NUM) | (kind == PLANE))
    n, hi = _told(tree, rest, split)
    return pd.DataFrame({
        "tree": number, "node": np.arange(len(kind)), "parent": rest["parent"], "left": tree.left, "right": tree.right, "depth": tree.depth, "kind": names, "col": tree.col, "split": split,
        "cat_left": lists["cat_left"], "cat_right": lists["cat_right"], "pct_left": known(tree.pct, kind != LEAF), "score": tree.score, "n": n, "lo": rest["lo"], "hi": hi,
        "remainder": rest["remainder"], "terms": lists["terms"], "imp": lists["imp"],
    })


def opened(runs: list) -> Iterator[list[Tree]]:
    """In a worker: the trees of broadcast runs, some at a time. Of several runs none stays in memory; Spark's file of it is read again."""
    for run in runs:
        held = run.value
        if len(runs) > 1 and getattr(run, "_path", None):
            run.__dict__.pop("_value", None)
        if not held or isinstance(held[0], Tree):
            yield held
            continue
        yield from _groups(map(unpacked, held))


def _groups(trees: Iterator[Tree]) -> Iterator[list[Tree]]:
    some, n = [], 0
    for tree in trees:
        some.append(tree)
        n += len(tree.kind)
        if n >= OPEN_NODES:
            yield some
            some, n = [], 0
    if some:
        yield some


def chunks(batches: Iterator, rows: int) -> Iterator[list]:
    """Batches (of pandas or Arrow) in lists of at least so many rows, but for the last."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def unlike(num: np.ndarray, cat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that differ from the one before them, and the place of every row among those. Missing values are alike."""
    if not len(num):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = (cat[1:] != cat[:-1]).any(axis=1)
    for x in num.T:
        new |= (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
    new = np.concatenate([[True], new])
    return np.flatnonzero(new), np.cumsum(new) - 1


def give_back() -> None:
    """In a worker: returns free memory to the system, which counts it as the executor's while the worker waits for another task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _small_batches(spark: SparkSession) -> None:
    """Rows with a packed tree are large: batches of many of them are held by the JVM and by Python at once."""
    setting, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)) > most:
        spark.conf.set(setting, str(most))


def read_alike(df: DataFrame) -> bool:
    """Whether df has the same rows when it is read again: no chance, and no choice of rows that depends on which come first."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.deterministic() and not re.search("Limit|Offset|Tail|Deduplicate|Sample", plan.toString())


def _free(df: DataFrame, base: str) -> str:
    name = f"copse_{base}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def dealt(df: DataFrame) -> DataFrame:
    """df in enough partitions for work that far outweighs a shuffle: a small file is otherwise one task's."""
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = size >> 27 if size < 1 << 48 else 0  # larger ones stand for unknown
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, by_size)
    return df.repartition(parts)


@dataclass
class Stored:
    """The table of packed trees of a forest: in `sent` what scoring and imputing need, in `rest` what node rows have besides."""

    table: DataFrame
    sizes: pd.Series  # nodes by tree, in order

    @staticmethod
    def write(spark: SparkSession, rounds: Iterator[DataFrame]) -> Stored:
        """Each round's trees are written before the next one's samples are drawn, so only one round's lie in shuffle files."""
        from copse.sources.store import shared_folder

        path = f"{shared_folder(spark)}/copse-{uuid.uuid4().hex[:12]}-forest"
        for trees in rounds:
            trees.write.mode("append").parquet(path)
            del trees
            gc.collect()  # lets Spark delete the samples' shuffle files now
            spark.sparkContext._jvm.System.gc()
        table = spark.read.schema(PACKED).parquet(path)
        sizes = table.select("tree", "n_nodes").toPandas().set_index("tree")["n_nodes"].sort_index()
        return Stored(table, sizes)

    def runs(self, most_nodes: int) -> Iterator[list[bytes]]:
        for _, part in self.sizes.groupby(self.sizes.cumsum() // most_nodes):
            rows = self.table.where(f"tree BETWEEN {part.index[0]} AND {part.index[-1]}").select("tree", "sent").toArrow()
            data, trees = rows["sent"], rows["tree"].to_numpy()
            yield [data[int(i)].as_py() for i in np.argsort(trees)]

    def frame(self) -> pd.DataFrame:
        """All node rows, for what takes a whole forest in the driver: exports, saving, sets of trees."""
        rows = self.table.select("tree", "sent", "rest").orderBy("tree").toLocalIterator()
        return pd.concat([_frame(r["tree"], unpacked(bytes(r["sent"])), _state(bytes(r["rest"]))) for r in rows], ignore_index=True)

    def over(self, df: DataFrame, into: str, kind: T.DataType, work: Callable[[pa.Table, Iterator[list[Tree]]], pa.Array], by: str) -> DataFrame:
        """df with one more column, work(rows, trees) for chunks of rows; the trees come some at a time. by: the column that work reads.

        Equal rows of `by` are worked on once and joined with df by its hash, so only they go to Python.
        """
        if not read_alike(df):
            return self._meet(df, into, kind, work)
        key, twin, other = (_free(df, x) for x in ("key", "twin", "other"))
        found = self._meet(df.select(by).distinct(), into, kind, work).select(F.xxhash64(by).alias(other), F.col(by).alias(twin), into)
        # Rows are sorted by the hash alone: in this form the rest is a condition and no further key.
        same = F.struct(F.col(by).alias("a"), F.col(other).alias("b")).eqNullSafe(F.struct(F.col(twin).alias("a"), F.col(key).alias("b")))
        rows = df.withColumn(key, F.xxhash64(by)).join(found, (F.col(key) == F.col(other)) & same, "left")
        value = F.when(F.col(other).isNull(), F.raise_error(F.lit("a row changed while its table was read again"))).otherwise(F.col(into))
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(into))

    def _meet(self, df: DataFrame, into: str, kind: T.DataType, work: Callable[[pa.Table, Iterator[list[Tree]]], pa.Array]) -> DataFrame:
        n_trees, schema = len(self.sizes), T.StructType([*df.schema.fields, T.StructField(into, kind)])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in chunks(batches, CHUNK):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0].schema) as out:
                    for b in held:
                        out.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "data"])
                del sink, out
                give_back()

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The trees of a chunk come one after another, its rows with one of them."""
            met = ((row[0].as_py(), row[1], row[2]) for b in batches for row in zip(b["chunk"], b["data"], b["sent"], strict=True))
            ahead = next(met, None)
            while ahead is not None:
                left, early, data = n_trees, [], None
                while data is None:
                    _, data, tree = ahead
                    data, left = data.as_py(), left - 1
                    early.append(tree.as_py())
                    ahead = next(met, None) if data is None else ahead
                rows = pa.ipc.open_stream(data).read_all()
                del data

                def trees() -> Iterator[Tree]:
                    nonlocal left
                    yield from map(unpacked, early)
                    early.clear()
                    while left:
                        left -= 1
                        yield unpacked(next(met)[2].as_py())

                rows = rows.append_column(into, work(rows, _groups(trees())))
                yield from rows.combine_chunks().to_batches(10_000)
                del rows
                give_back()
                ahead = next(met, None)

        sent = self.table.coalesce(1).select("tree", "sent").hint("shuffle_replicate_nl")
        first = F.when(F.col("tree") == int(self.sizes.index[0]), F.col("data")).alias("data")
        _small_batches(df.sparkSession)
        return dealt(df).mapInArrow(pack, "chunk string, data binary").crossJoin(sent).select("chunk", first, "sent").mapInArrow(meet, schema)
