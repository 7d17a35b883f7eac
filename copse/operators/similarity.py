"""Separation distances and isolation kernels between rows, from the long table (id, tree, leaf).

Rows that end in the same leaves of all trees are a class, and values are computed once for every pair of classes. Same leaf: an
equi-join on (tree, leaf). Different leaves: the splits shared by their paths, a small table per forest that a broadcast join adds when
it is under a checked size and a plain join otherwise. Forests whose table would be too large need none: classes are joined on the
nodes of their paths. The pairs of classes are then joined with their members, without an aggregation over pairs of rows.
Results are long tables (id_a, id_b, value).
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.functions.special import expected_separation
from copse.operators.forest import ForestModel

#: Largest leaf-by-leaf table, in rows (larger forests are joined on paths), and the largest that is broadcast.
MOST_LEAF_PAIRS = 20_000_000
BROADCAST_ROWS = 500_000
#: Rows of the second side that are broadcast to the pairs of classes; more are joined by a shuffle.
BROADCAST_MEMBERS = 1_000_000
#: Members of a class that are dealt to one part, so that a large class does not land in one task.
PART_ROWS = 256
OUTPUTS = ("dist", "avg_sep", "kernel", "kernel_raw")


def _divides(model: ForestModel) -> bool:
    p = model.params
    return p.missing_action == "divide" or (p.new_categ_action == "weighted" and bool(model.schema.categorical) and p.categ_split_type == "subset")


def leaf_index(model: ForestModel) -> pd.DataFrame:
    """tree, node, leaf, depth, n of every leaf; leaves are numbered in pre-order."""
    leaves = model.nodes[model.nodes["kind"] == "leaf"][["tree", "node", "depth", "n"]].sort_values(["tree", "node"])
    return leaves.assign(leaf=leaves.groupby("tree").cumcount()).reset_index(drop=True)


def leaf_pairs(model: ForestModel) -> int:
    """Rows of the leaf-by-leaf table."""
    return int((leaf_index(model).groupby("tree").size() ** 2).sum())


def leaf_separation(model: ForestModel) -> pd.DataFrame:
    """tree, leaf_a, leaf_b, sep: splits that both paths pass; a leaf with itself has its depth and what is expected below it."""
    rows = []
    index = leaf_index(model)
    if leaf_pairs(model) > MOST_LEAF_PAIRS:
        raise ValueError(f"the leaf table would have over {MOST_LEAF_PAIRS} rows; pairwise joins such a forest on paths")
    for tree, nodes in model.nodes.groupby("tree", sort=True):
        parent = nodes.set_index("node")["parent"].to_dict()
        mine = index[index["tree"] == tree]
        paths = {}
        for node in mine["node"]:
            path, at = [], node
            while at >= 0:
                path.append(at)
                at = parent[at]
            paths[node] = path[::-1]
        leaves = list(zip(mine["leaf"], mine["node"], mine["depth"], mine["n"], strict=True))
        for a, na, depth, n in leaves:
            own = depth + (3.0 if model.params.assume_full_distr else expected_separation(n))
            rows.append((tree, a, a, float(own)))
            for b, nb, _, _ in leaves:
                if b != a:
                    shared = sum(1 for x, y in zip(paths[na], paths[nb], strict=False) if x == y)
                    rows.append((tree, a, b, float(shared)))
    return pd.DataFrame(rows, columns=["tree", "leaf_a", "leaf_b", "sep"])


def _leaf_separation_table(spark: SparkSession, model: ForestModel) -> DataFrame:
    table = leaf_separation(model)
    df = spark.createDataFrame(table.astype({"tree": "int32", "leaf_a": "int32", "leaf_b": "int32"}))
    return F.broadcast(df) if len(table) <= BROADCAST_ROWS else df


def _classes(model: ForestModel, df: DataFrame, id_col: str) -> DataFrame:
    """id, class, parts, ends: every id with all its ends (tree, leaf, node, weight) in order.

    Equal ones have the same class, which is its smallest id; its members are dealt to so many parts.
    """
    end = F.struct("tree", "leaf", "node", "weight")
    ids = model.leaf_table(df, id_col).groupBy("id").agg(F.sort_array(F.collect_list(end)).alias("ends"))
    lead = ids.groupBy("ends").agg(F.min("id").alias("class"), F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    return ids.join(lead, "ends").select("id", "class", "parts", "ends")


def _class_ends(classes: DataFrame) -> DataFrame:
    """id, tree, leaf, node, weight of every class, by its smallest id."""
    return classes.where(F.col("id").eqNullSafe(F.col("class"))).select(F.col("class").alias("id"), F.explode("ends").alias("e")).select("id", "e.*")


def _path_table(model: ForestModel, ends: DataFrame) -> DataFrame:
    """id, tree, at, sep: the nodes of the paths to ends. The sep of the nodes that two paths share adds up to their separation."""
    full = model.params.assume_full_distr
    ways = {}
    for tree, nodes in model.nodes.groupby("tree"):
        nodes = nodes.sort_values("node")
        leaf = (nodes["kind"] == "leaf").to_numpy()
        below = [3.0 if full else expected_separation(n) for n in nodes["n"][leaf]]
        sep = np.ones(len(nodes))
        sep[leaf] = below
        ways[int(tree)] = nodes["parent"].to_numpy(np.int32), sep
    sent = ends.sparkSession.sparkContext.broadcast(ways)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree, part in pdf.groupby("tree"):
                parent, sep = sent.value[int(tree)]
                ids, at = part["id"].to_numpy(), part["node"].to_numpy()
                while len(at):
                    yield pd.DataFrame({"id": ids, "tree": np.int32(tree), "at": at, "sep": sep[at]})
                    at = parent[at]
                    ids, at = ids[at >= 0], at[at >= 0]

    kind = ends.schema["id"].dataType.simpleString()
    return ends.select("id", "tree", "node").mapInPandas(work, f"id {kind}, tree int, at int, sep double")


def _value(model: ForestModel, output: str, total):
    t = float(model.ntrees)
    if output == "kernel_raw":
        return total
    if output in ("kernel", "avg_sep"):
        return total / F.lit(t)
    norm = 2.0 if model.params.assume_full_distr else max(model.sep_norm - 1, 1e-9)
    return F.pow(F.lit(2.0), -(total - F.lit(t)) / F.lit(norm * t))


def pairwise(
    model: ForestModel, df: DataFrame, id_col: str, output: str = "dist", refs: DataFrame | None = None, *, include_same: bool = False, digits: int | None = None
) -> DataFrame:
    """id_a, id_b, value for all pairs with id_a < id_b, or for rows and reference rows. A kernel has only pairs that share a leaf.

    All pairs of distances are quadratic by definition; pass refs for large tables. digits: values are rounded, once per pair of classes.
    """
    if output not in OUTPUTS:
        raise ValueError(f"output must be one of {OUTPUTS}")
    if not output.startswith("kernel"):
        if _divides(model):
            raise ValueError("distances need one leaf per row; this forest divides rows")
        if refs is not None and not model.params.assume_full_distr:
            raise ValueError("distances to reference rows need assume_full_distr")
    spark = df.sparkSession
    classes_a = _classes(model, df, id_col)
    classes_b = classes_a if refs is None else _classes(model, refs, id_col)
    ends_a, ends_b = _class_ends(classes_a), _class_ends(classes_b)
    a = ends_a.select(F.col("id").alias("class_a"), "tree", F.col("leaf").alias("leaf_a"), F.col("weight").alias("wa"))
    b = ends_b.select(F.col("id").alias("class_b"), "tree", F.col("leaf").alias("leaf_b"), F.col("weight").alias("wb"))
    if output.startswith("kernel"):
        joined = a.join(b.withColumn("leaf_a", F.col("leaf_b")), ["tree", "leaf_a"])
        total = F.sum(F.col("wa") * F.col("wb"))
    else:
        if leaf_pairs(model) <= MOST_LEAF_PAIRS:
            joined = a.join(_leaf_separation_table(spark, model), ["tree", "leaf_a"]).join(b, ["tree", "leaf_b"])
        else:
            a = _path_table(model, ends_a).withColumnRenamed("id", "class_a")
            b = _path_table(model, ends_b).select(F.col("id").alias("class_b"), "tree", "at")
            joined = a.join(b, ["tree", "at"])
        total = F.sum("sep")
    value = _value(model, output, F.col("total"))
    value = value if digits is None else F.round(value, digits)
    pairs = joined.groupBy("class_a", "class_b").agg(total.alias("total")).select("class_a", "class_b", value.alias(output))
    if refs is None:
        same, wanted = lambda x, y: F.col(x) == F.col(y), F.col("id_a") <= F.col("id_b") if include_same else F.col("id_a") < F.col("id_b")
    else:  # an id that is null is an id too
        same, wanted = lambda x, y: F.col(x).eqNullSafe(F.col(y)), F.lit(True)
    # Pairs of classes are few and their members' pairs many: a stated number of tasks is not merged at run time.
    tasks = max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = classes_a.where(F.col("id").eqNullSafe(F.col("class"))).select(F.col("class").alias("sized"), "parts")
    pairs = pairs.join(sizes, same("class_a", "sized")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition(tasks, "class_a", "part").alias("p")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    left = classes_a.select(F.col("id").alias("id_a"), F.col("class").alias("member_of"), part.alias("part")).repartition(tasks, "member_of", "part").alias("a")
    right = classes_b.select(F.col("id").alias("id_b"), F.col("class").alias("class_of"))
    if (df if refs is None else refs).count() <= BROADCAST_MEMBERS:
        right = F.broadcast(right)
    found = left.join(pairs, same("member_of", "class_a") & (F.col("a.part") == F.col("p.part"))).join(right, same("class_b", "class_of") & wanted)
    return found.select("id_a", "id_b", output)


def packed_position(i: int, j: int, n: int) -> int:
    """Place of the pair i < j in a packed upper triangle of n rows."""
    return i * n - i * (i + 1) // 2 + j - i - 1


class Landmarks:
    """Reference rows kept as leaves: set once, compared with many tables."""

    def __init__(self, model: ForestModel, refs: DataFrame, id_col: str):
        self.model, self.id_col = model, id_col
        self.leaves = model.leaf_table(refs, id_col).select(F.col("id").alias("id_b"), "tree", F.col("leaf").alias("leaf_b"), F.col("weight").alias("wb"))

    def count(self) -> int:
        return self.leaves.select("id_b").distinct().count()

    def inverted(self) -> DataFrame:
        """tree, leaf, the reference ids that end there."""
        return self.leaves.groupBy("tree", F.col("leaf_b").alias("leaf")).agg(F.sort_array(F.collect_set("id_b")).alias("refs"))

    def kernel(self, df: DataFrame) -> DataFrame:
        a = self.model.leaf_table(df, self.id_col).select(F.col("id").alias("id_a"), "tree", F.col("leaf").alias("leaf_b"), F.col("weight").alias("wa"))
        total = a.join(self.leaves, ["tree", "leaf_b"]).groupBy("id_a", "id_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("t"))
        return total.select("id_a", "id_b", _value(self.model, "kernel", F.col("t")).alias("kernel"))
