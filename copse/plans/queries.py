"""Registered queries over whole tables, and the same results as DuckDB SQL where it can express them."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.functions import frames, special
from copse.operators import similarity
from copse.operators.forest import ForestModel, IsolationForest
from copse.plans import export, handmade, params
from copse.plans.pinned import pinned
from copse.sources import store

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MIXED = [*NUM, "l_returnflag", "l_linestatus"]
_KEYS = ["l_orderkey", "l_linenumber"]
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(*_KEYS, *MIXED)


_HOLES = f"""SELECT {', '.join(_KEYS)}, l_quantity, l_extendedprice, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN 'Z' ELSE l_returnflag END AS l_returnflag, l_linestatus FROM lineitem"""


def _with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    flag = F.when(key % 5 == 0, F.lit(None)).when(key % 11 == 0, F.lit("Z")).otherwise(F.col("l_returnflag"))
    return _lineitem(spark, sf_dir).withColumn("l_discount", F.when(key % 7 != 0, F.col("l_discount"))).withColumn("l_returnflag", flag)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


# -- scores of pinned forests against generated SQL -----------------------------------------------------------------------------


def _scored(model: ForestModel, rows, source: str, name: str, note: str = "score") -> None:
    q = f"SELECT {', '.join(_KEYS)}, round({export.score_sql(model)}, 8) AS score FROM ({source})"
    query(name, q)(lambda spark, d: model.predict(rows(spark, d)).select(*_KEYS, F.round("score", 8).alias("score")))


for _metric in special.METRICS:
    _scored(pinned("lineitem", scoring_metric=_metric, missing_action="impute"), _lineitem, "SELECT * FROM lineitem", f"forest_score_{_metric}")
_scored(pinned("lineitem", ndim=2, coefs="normal"), _lineitem, "SELECT * FROM lineitem", "forest_score_extended")
_scored(pinned("lineitem", ndim=3, missing_action="impute", scoring_metric="density"), _lineitem, "SELECT * FROM lineitem", "forest_score_extended_density")
_scored(pinned("numeric", ndim=2, coefs="normal", ntry=5, prob_pick_avg_gain=1.0, penalize_range=True, missing_action="fail"), _lineitem, "SELECT * FROM lineitem", "forest_score_range_penalty")
_scored(pinned("lineitem", missing_action="impute", new_categ_action="smallest", categ_split_type="subset", prob_pick_pooled_gain=0.5), _with_holes, _HOLES, "forest_score_missing_impute")
_scored(pinned("lineitem", ndim=2), _with_holes, _HOLES, "forest_score_extended_missing")
for _crit in ("avg_gain", "pooled_gain", "dens"):
    _scored(pinned("lineitem", missing_action="impute", **{f"prob_pick_{_crit}": 1.0}), _lineitem, "SELECT * FROM lineitem", f"forest_score_guided_{_crit}")
_scored(pinned("numeric", missing_action="fail", prob_pick_full_gain=1.0), _lineitem, "SELECT * FROM lineitem", "forest_score_guided_full_gain")
for _by in ("range", "var", "kurt"):
    _scored(pinned("numeric", missing_action="fail", **{f"prob_pick_col_by_{_by}": 1.0}), _lineitem, "SELECT * FROM lineitem", f"forest_score_columns_by_{_by}")
_scored(pinned("numeric", missing_action="fail", weigh_by_kurtosis=True, ncols_per_tree=3), _lineitem, "SELECT * FROM lineitem", "forest_score_kurtosis_weights")
_PLAIN = pinned("numeric", missing_action="fail")
_scored(_PLAIN.append_trees(pinned("numeric", seed=8, missing_action="fail")), _lineitem, "SELECT * FROM lineitem", "forest_append_trees")
_scored(_PLAIN.subset_trees([4, 0, 0]), _lineitem, "SELECT * FROM lineitem", "forest_subset_trees")


def _divided_sql(model: ForestModel, tree: int) -> str:
    """A tree that parts missing values by weight; only for shallow trees, as both branches are written again for them."""
    rows = model.nodes[model.nodes["tree"] == tree].sort_values("node").to_dict("records")
    w = export._Writer(model, tree, "doublequotes", None)

    def value(i: int) -> str:
        n = rows[i]
        if n["kind"] == "leaf":
            return export._number(n["score"])
        a, b, name, p = value(n["left"]), value(n["right"]), w.names[n["col"]], float(n["pct_left"])
        both = f"({export._number(p)} * {a} + {export._number(1 - p)} * {b})"
        test = f"CAST({name} AS DOUBLE) <= {export._number(n['split'])}" if n["kind"] == "num" else f"{name} IN ({w.levels(n['col'], n['cat_left'])})"
        return f"CASE WHEN {name} IS NULL THEN {both} WHEN {test} THEN {a} ELSE {b} END"

    return value(0)


_DIVIDE = pinned("lineitem", max_depth=3, ntrees=4, holes=0.1)
_DIVIDE_SUM = " + ".join(f"({_divided_sql(_DIVIDE, t)})" for t in range(_DIVIDE.ntrees))


@query("forest_score_missing_divide", f"SELECT {', '.join(_KEYS)}, round(POWER(2.0, -(({_DIVIDE_SUM}) / 4.0) / {export._number(_DIVIDE.depth_norm)}), 8) AS score FROM ({_HOLES})")
def _divided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _DIVIDE.predict(_with_holes(spark, sf_dir)).select(*_KEYS, F.round("score", 8).alias("score"))


@query("forest_avg_depth", f"SELECT {', '.join(_KEYS)}, round(({' + '.join(f'({x})' for x in export.to_sql(_PLAIN))}) / 5.0, 8) AS avg_depth FROM lineitem")
def _avg_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _PLAIN.predict(_lineitem(spark, sf_dir), "avg_depth").select(*_KEYS, F.round("avg_depth", 8).alias("avg_depth"))


@query("forest_tree_num", f"SELECT {', '.join(_KEYS)}, {', '.join(f'CAST({x} AS INTEGER) AS leaf{i}' for i, x in enumerate(export.to_sql(_PLAIN, output_tree_num=True)))} FROM lineitem")
def _tree_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _PLAIN.predict(_lineitem(spark, sf_dir), "tree_num")
    return rows.select(*_KEYS, *[F.col("tree_num")[i].alias(f"leaf{i}") for i in range(5)])


@query("forest_tree_depths", f"SELECT {', '.join(_KEYS)}, {', '.join(f'round({x}, 8) AS depth{i}' for i, x in enumerate(export.to_sql(_PLAIN)))} FROM lineitem")
def _tree_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _PLAIN.predict(_lineitem(spark, sf_dir), "tree_depths")
    return rows.select(*_KEYS, *[F.round(F.col("tree_depths")[i], 8).alias(f"depth{i}") for i in range(5)])


@query("forest_top_outliers", f"SELECT {', '.join(_KEYS)}, round({export.score_sql(_PLAIN)}, 8) AS score FROM lineitem ORDER BY round({export.score_sql(_PLAIN)}, 8) DESC, 1, 2 LIMIT 20")
def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _PLAIN.predict(_lineitem(spark, sf_dir)).select(*_KEYS, F.round("score", 8).alias("score"))
    return rows.orderBy(F.desc("score"), *_KEYS).limit(20)


@query("forest_node_counts", "SELECT * FROM (VALUES " + ", ".join(f"({t}, {len(g)}, {int((g['kind'] == 'leaf').sum())})" for t, g in _PLAIN.nodes.groupby("tree")) + ") AS v(tree, n_nodes, n_leaves)")
def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _PLAIN.node_counts(spark)


@query("forest_sql_export", _SQL["forest_subset_trees"])
def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported expression, run by Spark itself."""
    return _lineitem(spark, sf_dir).select(*_KEYS, F.round(F.expr(export.score_sql(_PLAIN.subset_trees([4, 0, 0]), enclose="backticks")), 8).alias("score"))


# -- forests written out by hand against SQL written by hand ---------------------------------------------------------------------

for _name in handmade.SCORED:
    query(_name, handmade.score_sql(_HOLES, _name))(lambda spark, d, name=_name: handmade.score(spark, _with_holes(spark, d), name))


@query("hand_distance", handmade.DISTANCE_SQL)
def _hand_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handmade.distance(spark, _table(spark, sf_dir, "supplier"))


# -- kernels, distances, imputation ---------------------------------------------------------------------------------------------

_SUP = pinned("supplier", missing_action="fail", ntrees=6)
_SUP_LEAVES = "WITH l AS (" + " UNION ALL ".join(f"SELECT s_suppkey AS id, {t} AS tree, {x} AS leaf FROM supplier" for t, x in enumerate(export.to_sql(_SUP, output_tree_num=True))) + ")"
_SEP = similarity.leaf_separation(_SUP)
_SEP_VALUES = "(VALUES " + ", ".join(f"({r.tree}, {r.leaf_a}, {r.leaf_b}, CAST({r.sep!r} AS DOUBLE))" for r in _SEP.itertuples()) + ") AS s(tree, leaf_a, leaf_b, sep)"


@query("forest_kernel", f"{_SUP_LEAVES} SELECT a.id AS id_a, b.id AS id_b, round(count(*) / 6.0, 8) AS kernel FROM l a JOIN l b ON a.tree = b.tree AND a.leaf = b.leaf AND a.id < b.id GROUP BY 1, 2")
def _kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _SUP.predict_kernel(_table(spark, sf_dir, "supplier"), "s_suppkey", digits=8)


_SEP_SUM = f"{_SUP_LEAVES} SELECT a.id AS id_a, b.id AS id_b, {{}} FROM l a JOIN {_SEP_VALUES} ON a.tree = s.tree AND a.leaf = s.leaf_a JOIN l b ON b.tree = s.tree AND b.leaf = s.leaf_b WHERE {{}} GROUP BY 1, 2"


@query("forest_distance", _SEP_SUM.format("round(POWER(2.0, -(sum(sep) - 6.0) / 12.0), 8) AS dist", "a.id < b.id"))
def _distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _SUP.predict_distance(_table(spark, sf_dir, "supplier"), "s_suppkey", digits=8)


@query("forest_distance_to_references", _SEP_SUM.format("round(sum(sep) / 6.0, 8) AS avg_sep", "b.id % 10 = 0"))
def _distance_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier")
    return _SUP.predict_distance(rows, "s_suppkey", "avg_sep", rows.where("s_suppkey % 10 = 0"), digits=8)


@query("forest_kernel_to_references", f"{_SUP_LEAVES} SELECT a.id AS id_a, b.id AS id_b, round(count(*) / 6.0, 8) AS kernel FROM l a JOIN l b ON a.tree = b.tree AND a.leaf = b.leaf AND b.id % 10 = 0 GROUP BY 1, 2")
def _kernel_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier")
    return similarity.Landmarks(_SUP, rows.where("s_suppkey % 10 = 0"), "s_suppkey").kernel(rows).select("id_a", "id_b", F.round("kernel", 8).alias("kernel"))


_IMP = pinned("lineitem", build_imputer=True, missing_action="impute", holes=0.1, categ_split_type="single_categ")


def _impute_sql() -> str:
    leaves = " UNION ALL ".join(f"SELECT rid, {t} AS tree, {x} AS leaf FROM h WHERE l_discount IS NULL OR l_returnflag IS NULL" for t, x in enumerate(export.to_sql(_IMP, output_tree_num=True)))
    index = similarity.leaf_index(_IMP).set_index(["tree", "node"])["leaf"].to_dict()
    values = [(int(r.tree), index[r.tree, r.node], x["col"], x["level"], x["value"], x["weight"]) for r in _IMP.nodes.itertuples() if r.kind == "leaf" for x in r.imp if x["col"] in (2, 4)]
    table = ", ".join(f"({t}, {k}, {c}, {v}, CAST({a!r} AS DOUBLE), CAST({w!r} AS DOUBLE))" for t, k, c, v, a, w in values)
    flags = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_IMP.schema.levels[0]))
    return f"""
WITH h AS (SELECT row_number() OVER () AS rid, * FROM ({_HOLES})), l AS ({leaves}), v AS (SELECT * FROM (VALUES {table}) AS v(tree, leaf, col, level, value, weight)),
g AS (SELECT rid, col, level, sum(value * weight) AS s, sum(weight) AS w FROM l JOIN v USING (tree, leaf) GROUP BY ALL),
d AS (SELECT rid, s / w AS value FROM g WHERE col = 2),
f AS (SELECT rid, CASE arg_min(level, -s) {flags} END AS flag FROM g WHERE col = 4 GROUP BY ALL)
SELECT h.l_orderkey, h.l_linenumber, round(coalesce(h.l_discount, d.value), 8) AS l_discount, coalesce(h.l_returnflag, f.flag) AS l_returnflag
FROM h LEFT JOIN d ON h.rid = d.rid LEFT JOIN f ON h.rid = f.rid"""


@query("forest_impute", _impute_sql())
def _imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _IMP.transform(_with_holes(spark, sf_dir)).select(*_KEYS, F.round("l_discount", 8).alias("l_discount"), "l_returnflag")


# -- statistics and split searches ----------------------------------------------------------------------------------------------


@query("stat_kurtosis", "SELECT " + ", ".join(f"round(kurtosis_pop({c}) + 3, 6) AS kurt_{c}" for c in NUM) + " FROM lineitem")
def _kurt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).agg(*[F.round(frames.raw_kurtosis(c), 6).alias(f"kurt_{c}") for c in NUM])


@query("stat_ranges", "SELECT " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, round(stddev_pop({c}), 6) AS sd_{c}, round(median({c}), 6) AS med_{c}" for c in NUM) + " FROM lineitem")
def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [x for c in NUM for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.round(F.stddev_pop(c), 6).alias(f"sd_{c}"), F.round(F.median(c), 6).alias(f"med_{c}"))]
    return _lineitem(spark, sf_dir).agg(*aggs)


@query("stat_expected_level_sd", "WITH p AS (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_returnflag) SELECT round(sqrt(sum(p / 3 - p * p / 3) - (1 - sum(p * p)) / 4), 8) AS expected_sd FROM p")
def _level_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.expected_level_sd(_lineitem(spark, sf_dir), "l_returnflag").select(F.round("expected_sd", 8).alias("expected_sd"))


_GAINS = """WITH x AS (SELECT l_quantity AS value FROM lineitem), d AS (SELECT DISTINCT value FROM x), c AS (SELECT value, lead(value) OVER (ORDER BY value) AS nxt FROM d),
g AS (SELECT c.value + (nxt - c.value) / 2 AS cut, count(*) FILTER (x.value <= c.value)::DOUBLE AS n_left, count(*) FILTER (x.value > c.value)::DOUBLE AS n_right,
  stddev_pop(x.value) FILTER (x.value <= c.value) AS sl, stddev_pop(x.value) FILTER (x.value > c.value) AS sr, stddev_pop(x.value) AS s, min(x.value) AS lo, max(x.value) AS hi FROM c, x WHERE nxt IS NOT NULL GROUP BY c.value, nxt)
SELECT cut, n_left, n_right, round(1 - (n_left * sl + n_right * sr) / ((n_left + n_right) * s), 6) AS pooled_gain, round(1 - (sl + sr) / (2 * s), 6) AS avg_gain,
  round(power(n_left / (n_left + n_right), 2) * (hi - lo) / (cut - lo) + power(n_right / (n_left + n_right), 2) * (hi - lo) / (hi - cut) - 1, 6) AS dens_gain FROM g"""


@query("split_gains", _GAINS)
def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.split_gains(_lineitem(spark, sf_dir), "l_quantity")
    return rows.select("cut", "n_left", "n_right", *[F.round(c, 6).alias(c) for c in ("pooled_gain", "avg_gain", "dens_gain")])


@query("expected_depth_table", "SELECT n, round(CASE WHEN n <= 1 THEN 0 ELSE 2 * ((SELECT sum(1.0::DOUBLE / k) FROM range(1, n + 1) AS r(k)) - 1) END, 8) AS c FROM range(1, 301) AS t(n)")
def _c_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, round(special.expected_depth(n), 8)) for n in range(1, 301)], "n long, c double")


# -- array columns ---------------------------------------------------------------------------------------------------------------

_ARRAYS = {f"forest_score_array{note}": pinned("embeddings", ntrees=10, missing_action="impute", **given) for note, given in (("", {}), ("_extended", {"ndim": 3}))}


def _over_vectors(name: str, model: ForestModel) -> None:
    places = [f"embedding[{i + 1}]" for _, _, i in model.schema.elements]
    q = f"SELECT vec_id, round({export.score_sql(model, enclose='none', column_names=places)}, 8) AS score FROM embeddings"
    query(name, q)(lambda spark, d: model.predict(_table(spark, d, "embeddings")).select("vec_id", F.round("score", 8).alias("score")))


for _name, _model in _ARRAYS.items():
    _over_vectors(_name, _model)


# -- fits (random: the results are checked by properties in the tests) -----------------------------------------------------------


def _fitted(name: str, p: params.ForestParams, columns: list[str], rows=_lineitem) -> None:
    query(name)(lambda spark, d: IsolationForest(p).fit(rows(spark, d), columns, key_cols=_KEYS).predict(rows(spark, d)).select(*_KEYS, "score"))


_fitted("fit_iforest", params.iforest(), NUM)
_fitted("fit_eif", params.eif(), NUM)
_fitted("fit_sciforest", params.sciforest(), NUM)
_fitted("fit_fcf", params.fcf(), NUM)
_fitted("fit_rrcf", params.rrcf(), NUM)
_fitted("fit_mixed_missing", params.ForestParams(), MIXED, _with_holes)
_fitted("fit_extended_mixed", params.ForestParams.of(ndim=2), MIXED, _with_holes)


@query("fit_array")
def _fit_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return IsolationForest(params.iforest()).fit(rows, ["embedding"], key_cols=["vec_id"]).predict(rows).select("vec_id", "score")


@query("fit_transform_impute")
def _fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_holes(spark, sf_dir)
    model = IsolationForest.of(build_imputer=True).fit(rows, MIXED, key_cols=_KEYS)
    return model.transform(rows).select(*_KEYS, *MIXED)


@query("fit_partial")
def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    model = IsolationForest(params.iforest(ntrees=10)).fit(rows, ["o_totalprice", "o_custkey"], key_cols=["o_orderkey"])
    return model.partial_fit(rows, key_cols=["o_orderkey"]).predict(rows).select("o_orderkey", "score")


@query("forest_save_load", _SQL["forest_score_depth"])
def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pinned("lineitem", scoring_metric="depth", missing_action="impute")
    path = f"{store.shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.save(spark, path)
    return store.load(spark, path).predict(_lineitem(spark, sf_dir)).select(*_KEYS, F.round("score", 8).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most anomalous order lines under a fitted isolation forest."""
    rows = _lineitem(spark, sf_dir)
    scored = IsolationForest(params.iforest()).fit(rows, NUM, key_cols=_KEYS).predict(rows)
    return scored.select(*_KEYS, *NUM, "score").orderBy(F.desc("score"), *_KEYS).limit(20)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
