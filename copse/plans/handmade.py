"""Small forests written out node by node, scored by the library, next to SQL written by hand from the same rules.

Unlike the pinned forests' SQL, none of it comes from the exporter: it says what missing values, new levels, range penalties,
hyperplanes and shared paths mean.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.operators.forest import _NODE_COLUMNS, ForestModel, Schema
from copse.plans.params import ForestParams

FLAGS = ("A", "N", "R")
_NORM = 2.0


def _nodes(*rows: dict) -> pd.DataFrame:
    blank = dict.fromkeys(_NODE_COLUMNS) | {"tree": 0, "left": 0, "right": 0, "col": -1, "n": 1.0, "remainder": 0.0}
    return pd.DataFrame([blank | r for r in rows], columns=_NODE_COLUMNS)


def _leaf(node: int, parent: int, depth: int, score: float, tree: int = 0) -> dict:
    return {"tree": tree, "node": node, "parent": parent, "depth": depth, "kind": "leaf", "score": score}


def _inner(kind: str, node: int, parent: int, depth: int, right: int, **rest) -> dict:
    return {"node": node, "parent": parent, "depth": depth, "kind": kind, "left": node + 1, "right": right, **rest}


def model(nodes: pd.DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...] = (), **options) -> ForestModel:
    levels = tuple(FLAGS for _ in categorical)
    return ForestModel(ForestParams(scoring_metric="depth", **options), Schema(numeric, categorical, levels), nodes, 16, _NORM, 2.0)


#: l_quantity <= 25, then l_discount <= 0.05 on the right, where six tenths went left.
NUMERIC = _nodes(
    _inner("num", 0, -1, 0, 2, col=0, split=25.0, pct_left=0.5, lo=5.0, hi=45.0),
    _leaf(1, 0, 1, 1.0),
    _inner("num", 2, 0, 1, 4, col=1, split=0.05, pct_left=0.6, lo=-0.05, hi=0.15),
    _leaf(3, 2, 2, 2.0),
    _leaf(4, 2, 2, 3.0),
)
#: Level A went left, with three tenths of the rows.
SUBSET = _nodes(_inner("subset", 0, -1, 0, 2, col=1, cat_left=[0], cat_right=[1, 2], pct_left=0.3), _leaf(1, 0, 1, 1.0), _leaf(2, 0, 1, 2.0))
SINGLE = _nodes(_inner("single", 0, -1, 0, 2, col=1, cat_left=[1], cat_right=[0, 2], pct_left=0.3), _leaf(1, 0, 1, 1.0), _leaf(2, 0, 1, 2.0))
PLANE = _nodes(
    _inner(
        "hplane", 0, -1, 0, 2, split=0.3, pct_left=0.5,
        terms=[
            {"col": 0, "coef": 0.1, "mean": 25.0, "cats": None, "fill": 0.4, "fill_new": 0.4},
            {"col": 2, "coef": 0.0, "mean": 0.0, "cats": [-0.5, 0.25, 0.5], "fill": 0.1, "fill_new": 0.2},
            {"col": 1, "coef": 2.0, "mean": 0.05, "cats": None, "fill": 0.7, "fill_new": 0.7},
        ],
    ),
    _leaf(1, 0, 1, 1.0),
    _leaf(2, 0, 1, 2.0),
)
#: Two trees over the balance: three leaves and two.
BALANCE = _nodes(
    _inner("num", 0, -1, 0, 2, col=0, split=2000.0, pct_left=0.3),
    _leaf(1, 0, 1, 1.0),
    _inner("num", 2, 0, 1, 4, col=0, split=6000.0, pct_left=0.5),
    _leaf(3, 2, 2, 2.0),
    _leaf(4, 2, 2, 2.0),
    _inner("num", 0, -1, 0, 2, col=0, split=5000.0, pct_left=0.5) | {"tree": 1},
    _leaf(1, 0, 1, 1.0, tree=1),
    _leaf(2, 0, 1, 1.0, tree=1),
)

_KEYS = ["l_orderkey", "l_linenumber"]
_LESS = "CASE WHEN l_quantity <= 25 THEN 1.0 WHEN {} WHEN l_discount <= 0.05 THEN 2.0 ELSE 3.0 END"
_FLAG = "CASE WHEN l_returnflag IS NULL THEN 2.0 WHEN l_returnflag = 'A' THEN 1.0 WHEN l_returnflag IN ('N', 'R') THEN 2.0 ELSE {} END"
#: name: model, the tree's value in SQL. Nulls of l_discount and l_returnflag and the level Z come from the table.
SCORED = {
    "hand_missing_divide": (model(NUMERIC, ("l_quantity", "l_discount"), missing_action="divide"), _LESS.format("l_discount IS NULL THEN 0.6 * 2.0 + 0.4 * 3.0")),
    "hand_missing_impute": (model(NUMERIC, ("l_quantity", "l_discount"), missing_action="impute"), _LESS.format("l_discount IS NULL THEN 2.0")),
    "hand_missing_fail": (model(NUMERIC, ("l_quantity", "l_discount"), missing_action="fail"), _LESS.format("l_discount IS NULL THEN NULL")),
    "hand_range_penalty": (
        model(NUMERIC, ("l_quantity", "l_discount"), missing_action="impute", penalize_range=True),
        f"{_LESS.format('l_discount IS NULL THEN 2.0')} - CASE WHEN l_quantity < 5 OR l_quantity > 45 THEN 1.0 ELSE 0.0 END",
    ),
    "hand_new_level_weighted": (model(SUBSET, ("l_quantity",), ("l_returnflag",), missing_action="impute", new_categ_action="weighted", categ_split_type="subset"), _FLAG.format("0.3 * 1.0 + 0.7 * 2.0")),
    "hand_new_level_smallest": (model(SUBSET, ("l_quantity",), ("l_returnflag",), missing_action="impute", new_categ_action="smallest", categ_split_type="subset"), _FLAG.format("1.0")),
    "hand_new_level_impute": (model(SUBSET, ("l_quantity",), ("l_returnflag",), missing_action="impute", new_categ_action="impute", categ_split_type="subset"), _FLAG.format("2.0")),
    "hand_new_level_single": (
        model(SINGLE, ("l_quantity",), ("l_returnflag",), missing_action="divide", categ_split_type="single_categ"),
        "CASE WHEN l_returnflag IS NULL THEN 0.3 * 1.0 + 0.7 * 2.0 WHEN l_returnflag = 'N' THEN 1.0 ELSE 2.0 END",
    ),
    "hand_hyperplane": (
        model(PLANE, ("l_quantity", "l_discount"), ("l_returnflag",), missing_action="impute", new_categ_action="impute", ndim=3),
        "CASE WHEN 0.1 * (l_quantity - 25) + CASE l_returnflag WHEN 'A' THEN -0.5 WHEN 'N' THEN 0.25 WHEN 'R' THEN 0.5 WHEN 'Z' THEN 0.2 ELSE 0.1 END"
        " + coalesce(2.0 * (l_discount - 0.05), 0.7) <= 0.3001 THEN 1.0 ELSE 2.0 END",
    ),
}
# The plane's cut lies between values that rounding could part.
PLANE.loc[0, "split"] = 0.3001


def score(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    return SCORED[name][0].predict(rows).select(*_KEYS, F.round("score", 8).alias("score"))


def score_sql(source: str, name: str) -> str:
    return f"SELECT {', '.join(_KEYS)}, round(POWER(2.0::DOUBLE, -({SCORED[name][1]})::DOUBLE / {_NORM}), 8) AS score FROM ({source})"


def distance(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return model(BALANCE, ("s_acctbal",), missing_action="fail", assume_full_distr=True).predict_distance(rows, "s_suppkey", digits=8)


#: Rows of one leaf: its depth and the three splits expected below it. Others: the splits that both pass.
DISTANCE_SQL = """WITH l AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal <= 2000 THEN 0 WHEN s_acctbal <= 6000 THEN 1 ELSE 2 END AS p, CASE WHEN s_acctbal <= 5000 THEN 0 ELSE 1 END AS q FROM supplier)
SELECT a.id AS id_a, b.id AS id_b, round(POWER(2.0::DOUBLE, -(CASE WHEN a.p = b.p THEN CASE a.p WHEN 0 THEN 4 ELSE 5 END WHEN a.p > 0 AND b.p > 0 THEN 2 ELSE 1 END + CASE WHEN a.q = b.q THEN 4 ELSE 1 END - 2.0) / 4.0), 8) AS dist
FROM l a JOIN l b ON a.id < b.id"""
