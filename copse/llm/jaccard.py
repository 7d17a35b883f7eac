"""N-gram Jaccard join by a token-group matrix, and its connected components. Exact: no link between different sets is lost.

1. Documents with equal shingle sets are one class. A first deal counts in how many classes a shingle occurs and marks the common
   ones in a filter of fixed size. Any mark gives a valid order, so the filter's errors cost time, not links.
2. Shingles are ordered from unmarked to most marked, then by hash. Two sets of the wanted similarity share a shingle among their first
   n - ceil(t*n) + 1, so only those are dealt out, and only those that at least two classes share go on.
3. Classes are partitioned into groups of similar sets by their most common shared shingle; a large group is dealt into parts. The
   token-group matrix holds each (shingle, group) once, however many members have it, so thousands of near copies are a few entries.
   Groups with enough common entries for their sizes are candidates.
4. Every set has a signature, the counts of its shingles in hash cells; the cell-wise maximum over a group is the hashed form of the
   group's token union. A member opens the other group only if its overlap with that, and then with a member's signature, can reach
   the threshold. Only members that do are fetched with their whole sets and compared. A spanning forest of the links leaves the
   task, not all pairs.
5. Links become components by alternating large-star and small-star rounds over written tables.

Defined results: a null text or one without words has no shingle, links with nothing and is its own component. Fewer words than a
shingle's width make one shingle of the whole sequence. Rows that repeat an id or a text are one class if their sets are equal;
equal ids alone link nothing. A null id is never a component's id unless the whole component has none. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.common import discard, free_name, release, shuffle_width, stash
from copse.llm.texts import SLICE, batch, map_batches, mix, shingle_sets

#: Bits of the filters, of fixed size: one marks common shingles, one keeps unwanted texts out of a shuffle. A full one costs time only.
FILTER_BITS = 26
#: Shingles in more classes than this are common, unless more than MOST_MARKED would be.
USUAL = 16
MOST_MARKED = 1 << 21
STEPS = (8, 64)
#: Shingles that a task gathers before it deals them out.
FLUSH = 1 << 19
#: Members of a group's part, on average.
PART = 128
#: Sizes of a group's members differ by less than this factor.
BAND = 1.06
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80


def _least(n, percent: int):
    """The least overlap with any linked set that a set of size n must have."""
    return (percent * n + 99) // 100


def _i64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed longs; (0, 0) for the empty set."""
    if not len(shingles):
        return 0, 0
    a, b = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(a), int(b)


def _ranks(table: np.ndarray, s: np.ndarray) -> np.ndarray:
    """How common shingles are, 0 to 3, in two bits a place."""
    p = (s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (table[p >> 2] >> ((p & 3) << 1).astype(np.uint8)) & 3


def _prefix(s: np.ndarray, ranks: np.ndarray | None, percent: int) -> np.ndarray:
    """The first shingles of a sorted set, as many as a linked set must share one of. Without ranks: some more, by hash alone."""
    k = len(s) - _least(len(s), percent) + 1
    if ranks is None:
        return s[: k + k // 7 + 1]
    rare = s[ranks == 0]
    return rare[:k] if len(rare) >= k else s[np.argsort(ranks, kind="stable")[:k]]


def _prefixes(sets: list[np.ndarray], table: np.ndarray, percent: int) -> list[np.ndarray]:
    ranks = _ranks(table, np.concatenate(sets)) if sets else np.empty(0, np.uint8)
    stops = np.cumsum([len(s) for s in sets]).tolist()
    return [_prefix(s, ranks[b - len(s) : b], percent) for s, b in zip(sets, stops, strict=True)]


def _bit_table(places: DataFrame) -> np.ndarray:
    """places: p, numbers under 2**FILTER_BITS. At most 2**(FILTER_BITS - 15) rows of 4 kB come to the driver, whatever the input."""
    words = places.select(F.shiftrightunsigned("p", 15).alias("word"), (F.col("p") % 32768).alias("bit"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in words.groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[r["word"] * 4096 : (r["word"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _levels(tables: list[np.ndarray]) -> np.ndarray:
    """Three bit tables as one of two bits a place: in how many of them it is set."""
    out = np.empty(2 * len(tables[0]), np.uint8)
    for i in range(0, len(tables[0]), 1 << 16):
        n = sum(np.unpackbits(t[i : i + (1 << 16)], bitorder="little") for t in tables).reshape(-1, 4)
        out[2 * i : 2 * i + len(n)] = n[:, 0] | n[:, 1] << 2 | n[:, 2] << 4 | n[:, 3] << 6
    return out


def _gathered(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Parallel arrays, joined until they hold FLUSH entries: what a task holds does not grow with its rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= FLUSH:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _bucket(token: np.ndarray, n: int) -> np.ndarray:
    """Of n buckets, by a hash apart from the order of shingles."""
    return ((mix(token) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The distinct keys, and for every column a binary row of its entries for each key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    bounds = np.append(starts, len(key))
    out = []
    for c in columns:
        data = c[order]
        out.append(pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)]))
    return key[starts], out


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _counts(rows: DataFrame, tokens_of: Callable[[pa.RecordBatch], np.ndarray], least: int) -> DataFrame:
    """bucket, token, df of every shingle that at least `least` rows have. tokens_of: the shingles of a batch's rows, one entry per row and shingle.

    Tasks count what they gather before it is dealt, so a shingle of very many rows is a few entries of its bucket.
    """
    n = _buckets(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token,) in _gathered((tokens_of(b),) for b in batches):
            token, df = np.unique(token, return_counts=True)
            key, found = _packed(_bucket(token, n), token, df.astype("<u4"))
            yield batch(["bucket", "token", "df"], key, *found)

    def total(table: pa.Table) -> pa.Table:
        token, df = _joined(table["token"], np.uint64), _joined(table["df"], "<u4")
        order = np.argsort(token)
        token, df = token[order], df[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        df = np.add.reduceat(df, starts)
        keep = df >= least
        return pa.table({"bucket": np.full(int(keep.sum()), table["bucket"][0].as_py(), np.int64), "token": _i64(token[starts][keep]), "df": df[keep]})

    return map_batches(rows, count, "bucket long, token binary, df binary").groupBy("bucket").applyInArrow(total, "bucket long, token long, df long")


def _buckets(spark) -> int:
    return 4 * max(8, shuffle_width(spark))


def _common(docs: DataFrame, percent: int) -> np.ndarray:
    """Ranks of shingles: 1 for more than `usual` rows, 2 and 3 for more than STEPS times that; usual is the least power of two that marks few enough."""

    def tokens_of(b: pa.RecordBatch) -> np.ndarray:
        sets = {fingerprint(s): s for s in shingle_sets(b.column(1))}
        return np.concatenate([_prefix(s, None, percent) for s in sets.values() if len(s)] or [np.empty(0, np.uint64)])

    often = stash(_counts(docs, tokens_of, USUAL + 1), "often")
    sizes = often.groupBy(F.floor(F.log2("df")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per power of two
    usual = USUAL
    while sum(r["n"] for r in sizes if 2 ** r["k"] >= usual) > MOST_MARKED:
        usual *= 2
    tables = [_bit_table(often.where(F.col("df") > usual * x).select(F.shiftrightunsigned("token", 64 - FILTER_BITS).alias("p"))) for x in (1, *STEPS)]
    discard(docs.sparkSession, often)
    return _levels(tables)


def _shared(classes: DataFrame) -> DataFrame:
    """(node, prefix: array of shingles) to (node, token, df) for every shingle that at least two nodes have.

    Rows are dealt by bucket. A bucket with much more than its share, as a shingle of very many nodes makes it, is dealt on by node.
    """
    spark, n = classes.sparkSession, _buckets(classes.sparkSession)
    shared = stash(_counts(classes.select("prefix"), lambda b: b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), 2), "shared")
    heavy = shared.groupBy("bucket").agg(F.sum("df").alias("rows")).collect()  # a row per bucket
    fair = max(FLUSH, 2 * sum(r["rows"] for r in heavy) // n)
    split = {r["bucket"]: -(-r["rows"] // fair) for r in heavy if r["rows"] > fair}
    parts = np.ones(n, np.uint64)
    parts[list(split)] = list(split.values())

    def pairs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        token = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return token, np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy(zero_copy_only=False))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, node in _gathered(map(pairs, batches)):
            bucket = _bucket(token, n)
            part = (mix(node.view(np.uint64)) % parts[bucket]).astype(np.int64)
            key, found = _packed(part * n + bucket, token, node)
            yield batch(["bucket", "part", "token", "node"], key % n, key // n, *found)

    def keep(rows: pa.Table, of: pa.Table) -> pa.Table:
        token, node = (_joined(rows[c], np.int64) for c in ("token", "node")) if rows.num_rows else (np.empty(0, np.int64),) * 2
        known, df = of["token"].to_numpy(), of["df"].to_numpy()
        order = np.argsort(known)
        at = np.searchsorted(known, token, sorter=order)
        at = order[np.minimum(at, len(known) - 1)] if len(known) else np.empty(0, np.int64)
        hit = known[at] == token if len(known) else np.zeros(len(token), bool)
        return pa.table({"node": node[hit], "token": token[hit], "df": df[at[hit]] if len(known) else np.empty(0, np.int64)})

    rows = map_batches(classes.select("node", "prefix"), deal, "bucket long, part long, token binary, node binary")
    times = spark.createDataFrame(list(split.items()) or [(-1, 1)], "bucket long, parts long")
    of = shared.join(F.broadcast(times), "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)))
    found = rows.groupBy("bucket", "part").cogroup(of.select("bucket", "part", "token", "df").groupBy("bucket", "part")).applyInArrow(keep, "node long, token long, df long")
    found = stash(found, "tokens")
    discard(spark, shared)
    return found


def signature(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in a power of two of hash cells, about two shingles to a cell, as unsigned 16-bit numbers cut to bytes where they fit.

    The first byte is the width of a count. Cells are the top bits of the hashes, so halving a signature adds neighbours.
    """
    bits = max(4, int(len(s)).bit_length() - 1)
    c = np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return b"\x01" + c.astype(np.uint8).tobytes() if c.max(initial=0) < 256 else b"\x02" + c.astype("<u2").tobytes()


def read_signature(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8 if b[0] == 1 else "<u2", offset=1).astype(np.int32)


def _folded(c: np.ndarray, cells: int) -> np.ndarray:
    return c if len(c) == cells else c.reshape(cells, -1).sum(axis=1)


def qualifying(xs: list[tuple[int, bytes]], ys: list[tuple[int, bytes]], percent: int = PERCENT, same: bool = False) -> tuple[list[int], list[int]]:
    """Positions in xs and ys of members that some member of the other side may link with. A member is its size and signature."""
    a, b = [read_signature(s) for _, s in xs], [read_signature(s) for _, s in ys]
    nb = np.array([n for n, _ in ys])
    cells = min(len(c) for c in (*a, *b))
    wide = np.array([_folded(c, cells) for c in b])
    union = wide.max(axis=0)
    left, right = [], np.zeros(len(ys), bool)
    for i, ((n, _), c) in enumerate(zip(xs, a, strict=True)):
        narrow = _folded(c, cells)
        if np.minimum(narrow, union).sum() < _least(n, percent):
            continue
        most = np.minimum(narrow, wide).sum(axis=1)
        may = 100 * most >= percent * (n + nb - most)
        may &= (100 * np.minimum(n, nb) >= percent * np.maximum(n, nb))
        if same:
            may[i] = False
        for j in np.flatnonzero(may):
            if cells < min(len(c), len(b[j])):  # the common fold was coarser than this pair's own
                own = min(len(c), len(b[j]))
                m = int(np.minimum(_folded(c, own), _folded(b[j], own)).sum())
                may[j] = 100 * m >= percent * (n + nb[j] - m)
        if may.any():
            left.append(i)
            right |= may
    return left, np.flatnonzero(right).tolist()


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _profile(docs: DataFrame, table: np.ndarray, percent: int) -> DataFrame:
    """Written: doc_id, n, fa, fb (fingerprint), sig, prefix (array of longs)."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1))
            prints = [fingerprint(s) for s in sets]
            yield batch(
                ["doc_id", "n", "fa", "fb", "sig", "prefix"],
                b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                pa.array([signature(s) for s in sets], pa.binary()), pa.array(map(_i64, _prefixes(sets, sent.value, percent)), pa.list_(pa.int64())),
            )

    out = stash(map_batches(docs, work, "doc_id long, n long, fa long, fb long, sig binary, prefix array<long>"), "profile")
    sent.destroy()
    return out


def _sets(rows: DataFrame) -> DataFrame:
    """Rows (text, wanted: array<struct<fa, fb, node, at>>) to (pair, right, node, shingles), a row per pair that a set is compared in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, wanted in zip(shingle_sets(b.column(0)), b.column(1).to_pylist(), strict=True):
                print_ = fingerprint(s)
                out = [(x["pair"], x["right"], w["node"]) for w in wanted if (w["fa"], w["fb"]) == print_ for x in w["at"]]
                for i in range(0, len(out), 64):
                    pair, right, node = zip(*out[i : i + 64], strict=True)
                    yield batch(["pair", "right", "node", "shingles"], pa.array(pair, pa.int64()), pa.array(right, pa.bool_()), pa.array(node, pa.int64()), pa.array([s.tobytes()] * len(pair), pa.binary()))

    return map_batches(rows.select("text", "wanted"), work, "pair long, right boolean, node long, shingles binary")


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Rows (pair, same, a, b: member lists) to (pair, same, right, node) of the members that qualify."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                pair, same, xs, ys = (b.column(c)[i].as_py() for c in range(4))
                left, right = qualifying([(x["n"], x["sig"]) for x in xs], [(y["n"], y["sig"]) for y in (xs if same else ys)], percent, same)
                out += [(pair, same, False, xs[k]["node"]) for k in left]
                out += [] if same else [(pair, same, True, ys[k]["node"]) for k in right]
            if out:
                kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
                yield batch(["pair", "same", "right", "node"], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)))

    return map_batches(pairs.select("pair", "same", "a", "b"), work, "pair long, same boolean, right boolean, node long")


def _may_be_wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose id may be among ids, by a Bloom filter with one function of 2**FILTER_BITS bits."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    bits = _bit_table(ids.select(place("doc_id").alias("p")))
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(2).to_numpy()
            keep = (sent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1
            yield batch(["doc_id", "text"], *(b.column(c).filter(pa.array(keep.astype(bool))) for c in (0, 1)))

    return map_batches(docs.select("doc_id", "text", place("doc_id").alias("p")), work, "doc_id long, text string")


def open_group(xs: list[np.ndarray], ys: list[np.ndarray], percent: int = PERCENT, same: bool = False) -> list[tuple[int, int]]:
    """A spanning forest of the links between xs and ys (same: xs is ys), as pairs of positions; xs come first in the forest's numbering."""
    nx = np.array([len(x) for x in xs])
    ny = np.array([len(y) for y in ys])
    union, member = np.unique(np.concatenate(ys), return_inverse=True)
    at = [np.searchsorted(union, x) for x in xs]
    at = [a[(a < len(union)) & (union[np.minimum(a, len(union) - 1)] == x)] for a, x in zip(at, xs, strict=True)]
    opens = [i for i, a in enumerate(at) if len(a) >= _least(nx[i], percent)]  # the bound of query and group
    if not opens:
        return []
    parent = list(range(len(xs) + (0 if same else len(ys))))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    out, shift = [], 0 if same else len(xs)
    cols = np.repeat(np.arange(len(ys)), ny)
    few = len(union) * len(ys) <= 20_000_000
    if few:
        matrix = np.zeros((len(union), len(ys)), np.float32)
        matrix[member, cols] = 1
    for i in opens:
        if few:
            overlap = matrix[at[i]].sum(axis=0).astype(np.int64)
        else:
            hit = np.zeros(len(union), bool)
            hit[at[i]] = True
            overlap = np.bincount(cols[hit[member]], minlength=len(ys))
        linked = np.flatnonzero(100 * overlap >= percent * (nx[i] + ny - overlap))
        for j in linked.tolist():
            a, b = find(i), find(shift + j)
            if a != b:
                parent[b] = a
                out.append((i, j))
    return out


def _verify(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (pair, members: array<struct<right, node, shingles>>) to links (u, v). A pair without right members is a group with itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for i in range(b.num_rows):
                members = b.column(0)[i].as_py()
                sides = [{m["node"]: np.frombuffer(m["shingles"], np.uint64) for m in members if m["right"] == r} for r in (False, True)]
                (an, xs), (bn, ys) = ((list(x), list(x.values())) for x in sides)
                if not xs:
                    continue
                for p, q in open_group(xs, ys or xs, percent, not ys):
                    u.append(an[p])
                    v.append((bn or an)[q])
            if u:
                yield batch(["u", "v"], pa.array(u, pa.int64()), pa.array(v, pa.int64()))

    return map_batches(sets.select("members"), work, "u long, v long")


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node with a link, by alternating stars. links: u, v longs."""
    spark = links.sparkSession
    edges = stash(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large, "large")
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        done, edges = edges, stash(small.where("u <> v").distinct(), "edges")
        discard(spark, done, least, large, low)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return stash(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")


def similar_classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Two written tables: documents (doc_id, n, fa, fb) and classes (fa, fb, rep, component_id, root)."""
    spark = df.sparkSession
    docs = _docs(df, id_col, text_col)
    rows = _profile(docs, _common(docs, percent), percent)
    release(spark)
    who = stash(rows.select("doc_id", "n", "fa", "fb"), "documents")
    classes = rows.where("n > 0").groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    discard(spark, rows)
    tokens = _shared(classes)
    release(spark)

    # A group: classes of one leading shingle and one band of sizes, dealt into parts.
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(BAND)))
    lead = tokens.groupBy("node").agg(F.max(F.struct("df", "token"))["token"].alias("lead")).join(classes.select("node", "n"), "node")
    lead = stash(lead.withColumn("lead", F.xxhash64("lead", band)), "lead")
    parts = lead.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("parts"))
    grouped = lead.join(parts, "lead").select("node", "n", F.xxhash64("lead", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("grp"))
    grouped = stash(grouped, "groups")
    sizes = grouped.groupBy("grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("k"))

    matrix = tokens.join(grouped.select("node", "grp"), "node").select("token", "grp").distinct().join(sizes, "grp")
    matrix = stash(matrix.select("token", "grp", "low", "high"), "matrix")
    discard(spark, tokens, lead)
    a = matrix.select("token", F.col("grp").alias("ga"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = matrix.select("token", F.col("grp").alias("gb"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    fits = f"ga < gb and 100 * a_high >= {percent} * b_low and 100 * b_high >= {percent} * a_low"
    pairs = a.join(b, "token").where(fits).groupBy("ga", "gb", "a_low", "a_high", "b_low", "b_high").agg(F.count(F.lit(1)).alias("common"))
    # Sets of x >= y shingles need an overlap of share * (x + y), of which at most the larger suffix, under percent / 100 * x, lies outside the prefixes.
    # The rest grows with y and falls with x, so it is least at the larger's high and the smaller's low.
    share = percent / (100 + percent)
    over = percent / 100 - share
    need = f"floor(least({share} * b_low - {over} * a_high, {share} * a_low - {over} * b_high) - 1e-6) + 1"
    pairs = pairs.where(f"common >= {need}").select("ga", "gb")
    alone = sizes.where("k > 1").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    pairs = stash(pairs.unionByName(alone).withColumn("pair", F.monotonically_increasing_id()), "pairs")

    members = grouped.join(classes.select("node", "sig"), "node").groupBy("grp").agg(F.collect_list(F.struct("node", "n", "sig")).alias("members"))
    members = stash(members, "members")
    sides = pairs.join(members.select(F.col("grp").alias("ga"), F.col("members").alias("a")), "ga").join(members.select(F.col("grp").alias("gb"), F.col("members").alias("b")), "gb")
    opened = stash(_bounded(sides.withColumn("same", F.col("ga") == F.col("gb")), percent), "opened")
    discard(spark, matrix, grouped, members, pairs)

    release(spark)
    at = opened.groupBy("node").agg(F.collect_list(F.struct("pair", "right")).alias("at"))
    wanted = at.join(classes, "node").groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct("fa", "fb", "node", "at")).alias("wanted"))
    wanted = stash(wanted, "wanted")
    texts = _may_be_wanted(docs, wanted)
    texts = texts.join(wanted.withColumnRenamed("doc_id", "rep"), texts.doc_id.eqNullSafe(F.col("rep"))).select("text", "wanted")
    sets = _sets(texts).groupBy("pair").agg(F.collect_list(F.struct("right", "node", "shingles")).alias("members"))
    roots = components(_verify(sets, percent))
    discard(spark, opened, wanted)

    found = classes.select("fa", "fb", "rep", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    out = stash(found.join(least, "root").select("fa", "fb", "rep", "component_id", "root"), "components")
    discard(spark, classes, roots)
    return who, out


def jaccard_components(df: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. A document without shingles is its own component."""
    who, found = similar_classes(df, **options)
    alone = who.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    some = who.where("n > 0").join(found.select("fa", "fb", "component_id"), ["fa", "fb"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(alone)


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of every component, that of its smallest id; rows without shingles all stay. All columns stay."""
    who, found = similar_classes(docs, id_col=id_col, text_col=text_col, **options)
    keep = found.where(F.col("rep").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min(F.struct("fa", "fb")).alias("k"))
    keep = keep.select(F.col("k.fa").alias("fa"), F.col("k.fb").alias("fb"), F.col("component_id").alias("rep"))
    times = who.where("n > 0").groupBy("doc_id", "fa", "fb").agg(F.count(F.lit(1)).alias("times"))
    chosen = stash(keep.join(times, (times.fa == keep.fa) & (times.fb == keep.fb) & times.doc_id.eqNullSafe(keep.rep)).select(F.col("rep").alias("doc_id"), keep.fa, keep.fb, "times"), "chosen")
    empty = who.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("fa"), F.lit(0).cast("long").alias("fb"), F.lit(1).cast("long").alias("times")).distinct()
    chosen = chosen.unionByName(empty)
    fa, fb, rep, times_ = (free_name(docs, x) for x in ("copse_fa", "copse_fb", "copse_rep", "copse_times"))
    # Ids that occur once need no text to be told apart, so only the others are fingerprinted again.
    many = stash(who.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "many")
    if many.isEmpty():
        ids = chosen.select(F.col("doc_id").alias(rep))
        return docs.join(ids, docs[id_col].eqNullSafe(ids[rep]), "left_semi")

    @F.arrow_udf("fa long, fb long")
    def printed(text: pa.Array) -> pa.Array:
        found = [fingerprint(s) for i in range(0, len(text), SLICE) for s in shingle_sets(text.slice(i, SLICE))]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["fa", "fb"])

    mark = free_name(docs, "copse_print")
    rows = docs.withColumn(mark, printed(F.col(text_col).cast("string")))
    right = chosen.select(F.col("doc_id").alias(rep), F.col("fa").alias(fa), F.col("fb").alias(fb), F.col("times").alias(times_))
    on = docs_key(rows, id_col).eqNullSafe(right[rep]) & (rows[mark]["fa"] == right[fa]) & (rows[mark]["fb"] == right[fb])
    kept = rows.join(right, on).select(*[rows[c] for c in docs.columns], rows[mark]["fa"].alias(fa), right[times_])
    once = kept.where((F.col(times_) == 1) | (F.col(fa) == 0)).select(*docs.columns)
    again = kept.where((F.col(times_) > 1) & (F.col(fa) != 0)).dropDuplicates([id_col, fa]).select(*docs.columns)
    return once.unionByName(again)


def docs_key(df: DataFrame, id_col: str):
    return df[id_col].cast("long")
