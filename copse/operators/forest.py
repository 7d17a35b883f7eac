"""Isolation forest: an estimator over DataFrames and an immutable model whose forest is a table of nodes.

Trees are grown by grouped-map tasks over per-tree samples. Sampling is one narrow pass: a row's place in hash space names the tree
(or, where trees need more rows than there are, the trees) whose sample it may join, and the task keeps the exact number with the
smallest hashes. Scoring is one pass with the forest broadcast in batches of bounded size. Forests that may pass MOST_NODES nodes stay
out of the driver (see stored.py).
"""

import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copse.functions import special
from copse.operators.grow import NODE_SCHEMA, Grower, Sample
from copse.operators.levels import can_level, grow_levels
from copse.operators.spread import can_spread, grow_spread
from copse.operators.stored import CHUNK, PACKED, Stored, chunks, dealt, give_back, opened, packed, rest_of, unlike
from copse.operators.traverse import Rules, forest_totals, trees_of
from copse.plans.params import ForestParams

#: Rows that one tree's task may hold.
MOST_TASK_ROWS = 2_000_000
#: Nodes that are broadcast at once; larger forests are scored in batches of trees whose sums are added.
MOST_NODES = 1_000_000
#: Rows of samples that are shuffled at once for a forest that the driver doesn't hold, or this part of the table's if that is more.
ROUND_ROWS, ROUND_PART = 600_000, 6
AUTO_SAMPLE = 10_000
#: Elements that an array column may have; each is a numeric feature.
MOST_ELEMENTS = 4096


@dataclass(frozen=True)
class Schema:
    """Columns by role, frozen at fit: numeric ones, and categorical ones with their sorted levels.

    An array column v gives the numeric features v[0], v[1] and so on; elements has (feature, column, place) for each.
    """

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    levels: tuple[tuple[str, ...], ...] = ()
    temporal: tuple[str, ...] = ()
    elements: tuple[tuple[str, str, int], ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @staticmethod
    def infer(df: DataFrame, columns: list[str] | None = None, categ_cols: tuple[str, ...] = (), most_levels: int = 10_000) -> "Schema":
        """Numbers, dates, timestamps and arrays of numbers are numeric; strings, booleans and categ_cols categorical; anything else is refused.

        An array has as many features as its longest value in df; elements that a row lacks are missing values.
        """
        numeric, categorical, temporal, elements = [], [], [], []
        names = list(columns or df.columns)
        vectors = [c for c in names if isinstance(df.schema[c].dataType, T.ArrayType) and isinstance(df.schema[c].dataType.elementType, T.NumericType)]
        widths = df.agg(*[F.max(F.size(F.col(c))).alias(c) for c in vectors]).first() if vectors else {}
        for name in names:
            kind = df.schema[name].dataType
            if name in categ_cols or isinstance(kind, (T.StringType, T.BooleanType)):
                categorical.append(name)
            elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                numeric.append(name)
                temporal.append(name)
            elif isinstance(kind, T.NumericType):
                numeric.append(name)
            elif name in vectors:
                width = max(widths[name] or 0, 0)
                if width > MOST_ELEMENTS:
                    raise ValueError(f"column {name} has up to {width} elements; at most {MOST_ELEMENTS} are supported")
                features = [(f"{name}[{i}]", name, i) for i in range(width)]
                numeric += [f for f, _, _ in features]
                elements += features
            else:
                raise TypeError(f"column {name} has type {kind.simpleString()}; numbers, arrays of numbers, dates, timestamps, strings and booleans are supported")
        levels = []
        for name in categorical:
            found = df.select(F.col(name).cast("string").alias("v")).where("v is not null").distinct().limit(most_levels + 1).collect()
            if len(found) > most_levels:
                raise ValueError(f"column {name} has more than {most_levels} levels")
            levels.append(tuple(sorted(r["v"] for r in found)))
        return Schema(tuple(numeric), tuple(categorical), tuple(levels), tuple(temporal), tuple(elements))

    def select(self, df: DataFrame) -> list[Column]:
        """The model's columns as doubles and strings, by name. Times count in microseconds."""
        place = {feature: (c, i) for feature, c, i in self.elements}
        if missing := [c for c in dict.fromkeys(place.get(c, (c,))[0] for c in self.columns) if c not in df.columns]:
            raise ValueError(f"columns are missing: {missing}")
        out = []
        for c in self.numeric:
            if c in place:
                x = F.get(F.col(place[c][0]), F.lit(place[c][1]))
            else:
                x = F.unix_micros(F.col(c).cast("timestamp")) if c in self.temporal else F.col(c)
            out.append(x.cast("double").alias(c))
        return out + [F.col(c).cast("string").alias(c) for c in self.categorical]

    def arrays(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Numbers with NaN and codes with -1 for missing; an unseen level gets a code past the known ones."""
        num = np.column_stack([pdf[c].to_numpy(float, na_value=np.nan) for c in self.numeric]) if self.numeric else np.empty((len(pdf), 0))
        cats = []
        for c, levels in zip(self.categorical, self.levels, strict=True):
            codes = pd.Categorical(pdf[c], categories=list(levels)).codes.astype(np.int64)
            cats.append(np.where((codes < 0) & pdf[c].notna().to_numpy(), len(levels), codes))
        return num, np.array(cats, np.int64).T if cats else np.empty((len(pdf), 0), np.int64)


@dataclass(frozen=True)
class IsolationForest:
    """Estimator. Parameters are checked when it fits; fitting returns a new model."""

    params: ForestParams = field(default_factory=ForestParams)

    @staticmethod
    def of(**given) -> "IsolationForest":
        return IsolationForest(ForestParams.of(**given))

    def get_params(self) -> dict:
        return asdict(self.params)

    def set_params(self, **given) -> "IsolationForest":
        return IsolationForest(ForestParams.of(**(asdict(self.params) | given)))

    def fit(
        self, df: DataFrame, columns: list[str] | None = None, *, weight_col: str | None = None, column_weights: dict[str, float] | None = None, key_cols: list[str] | None = None
    ) -> "ForestModel":
        """key_cols: columns that name a row. With them the samples, and so the forest, do not depend on how the table is parted."""
        return self._fit(df, columns, weight_col, column_weights, everything=False, key_cols=key_cols)

    def _fit(self, df, columns, weight_col, column_weights, everything: bool, first_tree: int = 0, schema: Schema | None = None, key_cols=None) -> "ForestModel":
        p = self.params.resolved()
        key_cols = list(key_cols) if key_cols else None
        columns = [c for c in columns or df.columns if c != weight_col]
        schema = schema or Schema.infer(df, columns, p.categ_cols)
        p = p.with_columns(len(schema.numeric), len(schema.categorical))
        n = df.count()
        if n < 3:
            raise ValueError("a forest needs at least 3 rows")
        size = _sample_size(p, n, everything)
        depth = _max_depth(p, size)
        spread = everything and size > MOST_TASK_ROWS and can_spread(p) and depth is not None and 2 ** (depth + 1) <= 2 * MOST_TASK_ROWS
        if size > MOST_TASK_ROWS and not spread:
            raise ValueError(f"a tree's sample of {size} rows is over the {MOST_TASK_ROWS} that a task may hold; set sample_size")
        if weight_col and p.weights_as_sample_prob and size >= n and not p.sample_with_replacement:
            raise ValueError("weights that are sampling probabilities need sub-sampling")
        if everything and p.sample_with_replacement:
            raise ValueError("this needs every row once, so it can't sample with replacement")
        col_weight = np.array([(column_weights or {}).get(c, 1.0) for c in schema.columns]) if column_weights else None
        if spread:
            model = ForestModel(p, schema, pd.DataFrame(columns=_NODE_COLUMNS), size, special.expected_depth(size), special.expected_separation(size))
            weight = F.col(weight_col) if weight_col else None
            trees = [grow_spread(df, schema, p, model.rules(), first_tree + t, n, depth, weight, col_weight, MOST_TASK_ROWS) for t in range(p.ntrees)]
            return replace(model, nodes=pd.concat(trees, ignore_index=True))
        as_prob = p.weights_as_sample_prob

        large = p.ntrees * 2 * size > MOST_NODES
        rules = _rules(p, schema)

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            rng = np.random.default_rng([p.random_seed, tree])
            pdf = pdf.sort_values(["sort_key", *schema.columns], kind="stable").head(size).reset_index(drop=True)
            if len(pdf) < size:
                raise ValueError(f"tree {tree} got {len(pdf)} rows of its sample of {size}; use another random_seed")
            num, cat = schema.arrays(pdf)
            weight = np.ones(len(pdf))
            if weight_col and not as_prob:
                weight = pdf["sample_weight"].to_numpy(float)
                weight = weight * (len(pdf) / weight.sum())
            sample = Sample(num, cat, [len(x) for x in schema.levels], weight, col_weight)
            grower = Grower(sample, p, rng, depth)
            nodes = pd.DataFrame(grow_levels(grower, tree, not large) if can_level(grower) else grower.grow(tree, lists=not large), columns=_NODE_COLUMNS)
            if not large:
                return nodes
            sent = trees_of(nodes, rules)[0]
            sent.imp = grower.imputed if p.build_imputer else None
            row = pd.DataFrame({"tree": [tree], "n_nodes": [len(nodes)], "sent": [packed(sent)], "rest": [rest_of(nodes)]})
            del grower, sample, nodes, sent
            give_back()
            return row

        # Samples are small but growing is not: a stated number of partitions is not merged at run time.
        spark = df.sparkSession
        most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

        def grown(first: int, last: int) -> DataFrame:
            sampled = _tree_samples(df, schema, p, n, size, weight_col, first_tree, key_cols, (first, last))
            sampled = sampled if weight_col else sampled.drop("sample_weight")
            count = last - first + 1
            # A tree of a large forest takes a second or so: with more partitions than trees, few of them get two.
            parts = min(4 * count, max(256, count)) if large else min(count, most)
            return sampled.repartition(parts, "tree").groupBy("tree").applyInPandas(grow, PACKED if large else NODE_SCHEMA)

        end = first_tree + p.ntrees - 1
        if large:
            step = max(1, max(ROUND_ROWS, n // ROUND_PART) // size)
            nodes = Stored.write(spark, (grown(t, min(end, t + step - 1)) for t in range(first_tree, end + 1, step)))
        else:
            nodes = grown(first_tree, end).toArrow().to_pandas().sort_values(["tree", "node"]).reset_index(drop=True)  # at most MOST_NODES rows
            nodes["imp"] = nodes["imp"] if p.build_imputer else None
        defaults = _defaults(df, schema) if p.build_imputer else ()
        return ForestModel(p, schema, nodes, size, special.expected_depth(size), special.expected_separation(size), defaults)

    def fit_predict(
        self, df: DataFrame, columns: list[str] | None = None, *, output: str = "score", into: str | None = None, column_weights: dict[str, float] | None = None, key_cols: list[str] | None = None, id_col: str | None = None
    ) -> DataFrame:
        """Fits on every row and scores them; needs the full sample unless sample_size says otherwise.

        output: one of predict's; "imputed" for df with its missing values filled; or a distance or kernel between rows named by id_col.
        """
        params = replace(self.params, build_imputer=True) if output == "imputed" else self.params
        model = IsolationForest(params)._fit(df, columns, None, column_weights, everything=True, key_cols=key_cols)
        if output == "imputed":
            return model.transform(df)
        if output in ("dist", "avg_sep", "kernel", "kernel_raw"):
            if not id_col:
                raise ValueError("values between rows need id_col")
            return model.predict_distance(df, id_col, output)
        return model.predict(df, output, into)

    def fit_transform(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Fits an imputer on every row and fills their missing values."""
        params = replace(self.params, build_imputer=True)
        return IsolationForest(params)._fit(df, columns, None, None, everything=True).transform(df)


_NODE_COLUMNS = "tree node parent left right depth kind col split cat_left cat_right pct_left score n lo hi remainder terms imp".split()


def _sample_size(p: ForestParams, n: int, everything: bool) -> int:
    s = p.sample_size
    if s is None:
        return n
    if s == "auto":
        return n if everything else min(n, AUTO_SAMPLE)
    if isinstance(s, float) and s <= 1:
        return max(3, math.ceil(s * n))
    return min(n, max(3, int(s)))


def _max_depth(p: ForestParams, size: int) -> int | None:
    if p.max_depth == "auto":
        return math.ceil(math.log2(max(2, size)))
    return p.max_depth


def _unit(h: Column) -> Column:
    """A number strictly between 0 and 1 from a hash."""
    return (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _enough(size: float) -> float:
    """Expected candidates of a sample, about six deviations more than it needs."""
    return size + 6 * math.sqrt(size) + 10


def _weight_cut(df: DataFrame, weight: Column, size: int) -> float:
    """The key -ln(u) / weight up to which at least enough rows are expected, from counts of rows by octave of their weight.

    A row of weight w lies under t with a chance of 1 - exp(-w t); every row counts with its bin's least weight, so the cut is never low.
    """
    bins = df.where(weight > 0).groupBy(F.floor(F.log2(weight) * 4).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(weight).alias("low")).collect()  # at most some thousands
    n, low = np.array([r["n"] for r in bins], float), np.array([r["low"] for r in bins], float)
    if n.sum() < size:
        raise ValueError(f"{int(n.sum())} rows have a positive weight, fewer than a sample of {size}")
    want = _enough(size)
    if want >= 0.9 * n.sum():
        return math.inf
    expected = lambda t: float(-(n * np.expm1(-low * t)).sum())
    a, b = 0.0, 1.0 / low.max()
    while expected(b) < want:
        b *= 2
    for _ in range(60):
        mid = (a + b) / 2
        a, b = (a, mid) if expected(mid) >= want else (mid, b)
    return b


def _tree_samples(df: DataFrame, schema: Schema, p: ForestParams, n: int, size: int, weight_col: str | None, first: int, key_cols: list[str] | None, only: tuple[int, int] | None = None) -> DataFrame:
    """Rows (columns, sample_weight, sort_key, tree): candidates of every tree (only: from the one to the other), about six deviations more than its sample.

    A row is drawn by the hash of key_cols, so the same table gives the same sample however it is parted; without keys by its place.
    Uniform samples are drawn without replacement inside a tree, and without overlap between trees while the table has enough rows;
    with fewer rows than that, trees of one lot do not overlap, and lots are independent.
    With weights as probabilities, rows compete by -ln(u) / weight, which equals drawing one after another by weight.
    With replacement, a row comes as often as a Poisson process of its rate arrives; of the arrivals the first `size` count, in an
    order by chance, which are then as many independent draws from the whole table. A sort_key has 4 bytes, as they are shuffled; rows that
    share one are ordered by their values.
    """
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    key = [F.col(c) for c in key_cols] if key_cols else [F.monotonically_increasing_id()]
    rows = df.select(*schema.select(df), weight.alias("sample_weight"), F.xxhash64(*key, F.lit(p.random_seed)).alias("row_hash"))
    by_weight = bool(weight_col) and p.weights_as_sample_prob
    only = only or (first, first + p.ntrees - 1)
    want = min(1.0, _enough(size) / n)
    h, trees = F.col("row_hash"), F.sequence(*map(F.lit, only))
    if p.sample_with_replacement:
        total = df.agg(F.sum(F.when(weight > 0, weight))).first()[0] if by_weight else float(n)
        rate = F.greatest(F.col("sample_weight"), F.lit(0.0)) * F.lit(_enough(size) / total) if by_weight else F.lit(_enough(size) / total)
        gap = lambda t, k: -F.log(_unit(F.xxhash64(h, t, k)))
        none = F.lit(1).cast("int")
        rows = rows.withColumn("tree", F.explode(F.filter(trees, lambda t: gap(t, none) <= rate)))
        # Few rows are left: the further arrivals of each, up to far beyond its rate.
        later = F.sequence(F.lit(2), F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int"))
        start = F.struct(gap(F.col("tree"), none).alias("at"), F.lit(1).alias("n"))
        step = lambda acc, k: F.struct((acc["at"] + gap(F.col("tree"), k)).alias("at"), (acc["n"] + F.when(acc["at"] + gap(F.col("tree"), k) <= rate, 1).otherwise(0)).alias("n"))
        rows = rows.withColumn("times", F.aggregate(later, start, step)["n"])
        rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
        return rows.withColumn("sort_key", _unit(F.xxhash64(h, "tree", "nth", F.lit("order"))).cast("float")).drop("row_hash", "times", "nth")
    if not by_weight and want * p.ntrees <= 1:
        tree = F.floor(_unit(h) / F.lit(want)).cast("int")
        picked = rows.withColumn("tree", tree + F.lit(first)).where(tree < p.ntrees).where(F.col("tree").between(*only))
        return picked.withColumn("sort_key", F.xxhash64("row_hash", "tree").cast("float")).drop("row_hash")
    if not by_weight and want <= 0.25:
        # Lots of trees that share no row: a hash for each lot, and not for each tree, names the one that a row may join. Small lots save nothing.
        lot = math.floor(1 / want)
        slot = lambda k: F.floor(_unit(F.xxhash64(h, k)) / F.lit(want)).cast("int")
        trees = F.transform(F.sequence(*[F.lit(t // lot) for t in only]), lambda k: F.when(slot(k) < lot, k * lot + slot(k)))
        picked = rows.withColumn("tree", F.explode(trees)).where(F.col("tree").between(*only))
        return picked.withColumn("sort_key", F.xxhash64("row_hash", "tree").cast("float")).drop("row_hash")
    drawn = lambda t: -F.log(_unit(F.xxhash64(h, t))) / F.col("sample_weight") if by_weight else _unit(F.xxhash64(h, t))
    cut = _weight_cut(df, weight, size) if by_weight else want if want < 1 else math.inf
    if by_weight:
        rows = rows.where("sample_weight > 0")
    mine = F.filter(trees, lambda t: drawn(t) <= F.lit(cut)) if math.isfinite(cut) else trees
    return rows.withColumn("tree", F.explode(mine)).withColumn("sort_key", drawn(F.col("tree")).cast("float")).drop("row_hash")


def _defaults(df: DataFrame, schema: Schema) -> tuple:
    """Fallbacks of the imputer: means of numeric columns, modes of categorical ones (the smallest of equals)."""
    cols = df.select(*schema.select(df))
    means = cols.agg(*[F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c) for c in schema.numeric]).first() if schema.numeric else {}
    out = [means[c] for c in schema.numeric]
    for c in schema.categorical:
        top = cols.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), c).limit(1).collect()
        out.append(top[0][c] if top else None)
    return tuple(out)


def _rules(p: ForestParams, schema: Schema) -> Rules:
    return Rules(len(schema.numeric), [len(x) for x in schema.levels], p.missing_action, p.new_categ_action, p.penalize_range)


class _Nodes:
    """The model's node rows; those of a stored forest are read when something asks for them."""

    def __set__(self, model: "ForestModel", nodes: pd.DataFrame | Stored) -> None:
        model.__dict__["stored" if isinstance(nodes, Stored) else "_frame"] = nodes

    def __get__(self, model: "ForestModel | None", owner: type | None = None):
        if model is None:
            return self
        if "_frame" not in model.__dict__:
            model.__dict__["_frame"] = model.stored.frame()
        return model.__dict__["_frame"]


@dataclass(frozen=True, eq=False)
class ForestModel:
    """A fitted forest. Nothing changes it; set operations and partial fits give new models."""

    params: ForestParams
    schema: Schema
    nodes: pd.DataFrame
    sample_size: int
    depth_norm: float
    sep_norm: float
    defaults: tuple = ()
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    # -- describing ------------------------------------------------------------------------------------------------------------

    @property
    def ntrees(self) -> int:
        if stored := self.__dict__.get("stored"):
            return len(stored.sizes)
        return int(self.nodes["tree"].max()) + 1 if len(self.nodes) else 0

    def __len__(self) -> int:
        return self.ntrees

    def __str__(self) -> str:
        kind = "Extended isolation forest" if self.params.ndim > 1 else "Isolation forest"
        return f"{kind}: {self.ntrees} trees, {len(self.schema.numeric)} numeric and {len(self.schema.categorical)} categorical columns, samples of {self.sample_size}, metric {self.params.scoring_metric}"

    def feature_names(self) -> list[str]:
        return list(self.schema.columns)

    def same_as(self, other: "ForestModel") -> bool:
        return self.uid == other.uid

    def copy(self) -> "ForestModel":
        return replace(self, nodes=self.nodes.copy())

    def node_counts(self, spark: SparkSession) -> DataFrame:
        return self.nodes_table(spark).groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum((F.col("kind") == "leaf").cast("long")).alias("n_leaves"))

    def nodes_table(self, spark: SparkSession) -> DataFrame:
        from copse.sources.store import nodes_to_spark

        return nodes_to_spark(spark, self.nodes)

    def rules(self) -> Rules:
        return _rules(self.params, self.schema)

    # -- scoring ---------------------------------------------------------------------------------------------------------------

    def _batches(self) -> list[pd.DataFrame]:
        """The nodes in runs of whole trees of at most MOST_NODES nodes."""
        if len(self.nodes) <= MOST_NODES:
            return [self.nodes]
        sizes = self.nodes.groupby("tree").size().cumsum()
        run = (sizes // MOST_NODES).to_dict()
        return [part for _, part in self.nodes.groupby(self.nodes["tree"].map(run))]

    def sent(self, spark: SparkSession, imputer: bool = False) -> list:
        """Broadcast runs of whole trees; several runs, and a stored forest's, are of packed trees. imputer: with its values."""
        send = spark.sparkContext.broadcast
        if stored := self.__dict__.get("stored"):
            return [send(run) for run in stored.runs(MOST_NODES)]
        out, parts = [], self._batches()
        for part in parts:
            trees = trees_of(part, self.rules())
            if imputer:
                from copse.operators.impute import with_values

                with_values(trees, part, self.schema)
            out.append(send(trees if len(parts) == 1 else [packed(t) for t in trees]))
        return out

    def _over_trees(self, df: DataFrame, into: str, work, kind: str) -> DataFrame:
        """df with a column of work(trees, numbers, codes) over the model's columns, summed over trees or, if it has a value per tree, side
        by side; only those columns go to Python."""
        features, totals = F.struct(*self.schema.select(df)), not kind.startswith("array")
        if "stored" in self.__dict__ and totals and not df.isStreaming:
            schema, name = self.schema, _free_name(df, "features")

            def total(rows: pa.Table, forest) -> pa.Array:
                num, cat = schema.arrays(columns_of(rows, name))
                first, place = unlike(num, cat)
                num, cat = num[first], cat[first]
                return pa.array(sum(work(trees, num, cat) for trees in forest)[place])

            return self.stored.over(df.withColumn(name, features), into, T.DoubleType(), total, name).drop(name)
        runs = self.sent(df.sparkSession)
        many = len(runs) > 1
        values = _values(runs, self.schema, work, kind, CHUNK if many and totals else 1)
        return (dealt(df) if many else df).withColumn(into, values(features))

    def predict(self, df: DataFrame, output: str = "score", into: str | None = None) -> DataFrame:
        """df with one more column. output: score, avg_depth (not standardised), tree_depths, tree_num (leaf numbers from 0).

        Arrays have one entry per tree. A row that is parted has no single leaf, so with missing_action "divide" (or weighted new
        levels) its entries are refused: the query fails where such a row occurs. With "fail", rows with a missing value get null.
        """
        into = into or {"score": "score", "avg_depth": "avg_depth"}.get(output, output)
        metric, trees = self.params.scoring_metric, self.ntrees
        if output in ("score", "avg_depth"):
            name = _free_name(df, into)
            mean = F.nanvl(F.col(name) / F.lit(float(trees)), F.lit(None).cast("double"))
            value = special.standardised(metric, mean, self.depth_norm) if output == "score" else special.raw(metric, mean)
            return self._over_trees(df, name, forest_totals, "double").withColumn(into, value).drop(name)
        if output not in ("tree_num", "tree_depths"):
            raise ValueError(f"unknown output {output!r}")
        logs = metric in special.LOG_METRICS

        def per_tree(ts, num, cat):
            grid = np.full((len(num), len(ts)), np.nan)
            for k, t in enumerate(ts):
                rows, nodes, weight, _ = t.leaves(num, cat)
                if len(rows) > len(num):
                    raise ValueError("a row with missing values was divided, so it has no single leaf")
                found = t.leaf_number[nodes].astype(float) if output == "tree_num" else np.exp(t.score[nodes]) if logs else t.score[nodes]
                grid[rows, k] = np.where(np.isnan(weight), np.nan, found)
            return grid

        name = _free_name(df, into)
        kind = "int" if output == "tree_num" else "double"
        found = F.transform(F.col(name), lambda v: F.nanvl(v, F.lit(None).cast("double")).cast(kind))
        return self._over_trees(df, name, per_tree, "array<double>").withColumn(into, found).drop(name)

    decision_function = predict

    def leaf_table(self, df: DataFrame, id_col: str) -> DataFrame:
        """Long table id, tree, leaf (number), node, weight: every end of every row in every tree."""
        schema = self.schema
        kind = df.schema[id_col].dataType.simpleString()
        rows = df.select(F.col(id_col).alias("row_id"), *schema.select(df))
        ends = _ends(self.sent(df.sparkSession), schema)
        return rows.mapInPandas(ends, f"id {kind}, tree int, leaf int, node int, weight double")

    # -- imputation, distances, sets (see their modules) -----------------------------------------------------------------------

    def transform(self, df: DataFrame) -> DataFrame:
        from copse.operators.impute import impute

        return impute(self, df)

    def predict_distance(self, df: DataFrame, id_col: str, output: str = "dist", refs: DataFrame | None = None, digits: int | None = None) -> DataFrame:
        from copse.operators.similarity import pairwise

        return pairwise(self, df, id_col, output, refs, digits=digits)

    def predict_kernel(self, df: DataFrame, id_col: str, refs: DataFrame | None = None, digits: int | None = None) -> DataFrame:
        return self.predict_distance(df, id_col, "kernel", refs, digits)

    def append_trees(self, other: "ForestModel") -> "ForestModel":
        """All trees of both; this model's settings stay."""
        if (self.params.ndim > 1) != (other.params.ndim > 1):
            raise ValueError("single-variable and extended forests can't be mixed")
        if self.schema.columns != other.schema.columns or self.schema.levels != other.schema.levels:
            raise ValueError("the forests were fitted on different columns or levels")
        more = other.nodes.copy()
        more["tree"] += self.ntrees
        return replace(self, nodes=pd.concat([self.nodes, more], ignore_index=True), uid=uuid.uuid4().hex)

    def subset_trees(self, take: list[int]) -> "ForestModel":
        """The trees named, in that order, repeats allowed. All settings stay."""
        parts = {t: part for t, part in self.nodes.groupby("tree")}
        if not take or any(t not in parts for t in take):
            raise ValueError("trees must be named by numbers from 0")
        return replace(self, nodes=pd.concat([parts[t].assign(tree=i) for i, t in enumerate(take)], ignore_index=True), uid=uuid.uuid4().hex)

    def drop_imputer(self) -> "ForestModel":
        return replace(self, nodes=self.nodes.assign(imp=None), defaults=(), params=replace(self.params, build_imputer=False), uid=uuid.uuid4().hex)

    def partial_fit(self, df: DataFrame, *, trees: int = 1, weight_col: str | None = None, column_weights: dict[str, float] | None = None, key_cols: list[str] | None = None) -> "ForestModel":
        """With more trees, each grown on every row of df; scores keep the first fit's c(n), and seeds go on by tree number.

        Rows may weigh (as density) and columns may have weights; leaves of new trees get no reference rows, as landmarks are tables.
        """
        p = replace(self.params, sample_size=None, ntrees=trees, weights_as_sample_prob=False)
        more = IsolationForest(p)._fit(df, list(self.schema.columns), weight_col, column_weights, True, self.ntrees, self.schema, key_cols)
        return replace(self, nodes=pd.concat([self.nodes, more.nodes], ignore_index=True), uid=uuid.uuid4().hex)

    def newest(self, trees: int) -> "ForestModel":
        """The last trees only: a bounded forest for drifting data."""
        return self if self.ntrees <= trees else self.subset_trees(list(range(self.ntrees - trees, self.ntrees)))

    def save(self, spark: SparkSession, path: str) -> None:
        from copse.sources.store import save

        save(spark, self, path)


ForestModel.nodes = _Nodes()


def columns_of(rows: pa.Table, name: str) -> pd.DataFrame:
    """The fields of a struct column as columns."""
    found = rows[name].combine_chunks()
    found = found if isinstance(found, pa.StructArray) else found.chunk(0)
    return pd.DataFrame({f.name: found.field(i).to_pandas() for i, f in enumerate(found.type)})


def _free_name(df: DataFrame, base: str) -> str:
    name = f"copse_{base}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _ends(runs: list, schema: Schema):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            num, cat = schema.arrays(pdf)
            for k, t in enumerate(t for trees in opened(runs) for t in trees):
                rows, nodes, weight, _ = t.leaves(num, cat)
                ok = ~np.isnan(weight)
                yield pd.DataFrame({"id": pdf["row_id"].to_numpy()[rows[ok]], "tree": np.int32(k), "leaf": t.leaf_number[nodes[ok]].astype(np.int32), "node": nodes[ok].astype(np.int32), "weight": weight[ok]})

    return work


def _values(runs: list, schema: Schema, work, kind: str, chunk: int):
    @F.pandas_udf(kind)
    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for held in chunks(batches, chunk):
            num, cat = (np.concatenate(x) for x in zip(*map(schema.arrays, held), strict=True))
            whole = None
            for trees in opened(runs):
                part = work(trees, num, cat)
                whole = part if whole is None else np.hstack([whole, part]) if part.ndim > 1 else whole + part
            at = 0
            for pdf in held:
                part = whole[at : at + len(pdf)]
                yield pd.Series(part if part.ndim == 1 else list(part))
                at += len(pdf)

    return values
