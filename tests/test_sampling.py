"""Samples of trees: exact sizes, inclusion by weight, repeats, and no dependence on how a table is parted."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from copse.operators import forest, traverse
from copse.operators.forest import IsolationForest, Schema
from copse.operators.grow import Grower, Sample
from copse.operators.levels import can_level, grow_levels
from copse.operators.traverse import Rows, Tree, forest_totals, trees_of
from copse.plans import params, queries
from copse.plans.pinned import pinned


def _samples(df, size, weight_col=None, keys=("id",), **options):
    """The sample that every tree's task keeps, as lists of ids."""
    p = params.ForestParams.of(sample_size=size, missing_action="fail", **options)
    schema, n = Schema.infer(df, ["id"]), df.count()
    rows = forest._tree_samples(df, schema, p, n, size, weight_col, 0, list(keys) if keys else None).toPandas()
    return [g.sort_values(["sort_key", "id"])["id"].astype(int).head(size).tolist() for _, g in rows.groupby("tree")]


def test_trees_of_a_lot_share_no_row_and_every_row_has_its_chance(spark):
    got = _samples(spark.range(20_000), 1000, ntrees=50)  # lots of 16 trees
    assert len(got) == 50 and all(len(s) == len(set(s)) == 1000 for s in got)
    for lot in (got[:16], got[16:32], got[32:48]):
        assert len({i for s in lot for i in s}) == 16_000
    common = [len(set(a) & set(b)) for a in got[:16] for b in got[16:32]]
    assert np.mean(common) == pytest.approx(50, rel=0.05)  # independent: 1000 * 1000 / 20,000
    times = np.bincount(np.concatenate(got), minlength=20_000)
    assert times.mean() == 2.5 and times.max() <= 4 and abs(times[:10_000].mean() - 2.5) < 0.03


def test_equal_rows_of_a_stored_forest_are_scored_once(spark, monkeypatch):
    data = spark.range(3000).select("id", (F.col("id") % 40).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") % 40 % 7 * 1.0).alias("y"), F.when(F.col("id") % 8 > 0, "a").alias("c"))
    kinds = data.select("x", "y", "c").distinct().count()
    monkeypatch.setattr("copse.operators.forest.MOST_NODES", 300)
    model = IsolationForest.of(ntrees=6, sample_size=200, ndim=2).fit(data, ["x", "y", "c"], key_cols=["id"])
    seen = spark.sparkContext.accumulator(0)

    def work(trees, num, cat):
        seen.add(len(num) * len(trees))
        return forest_totals(trees, num, cat)

    got = model._over_trees(data, "total", work, "double").toPandas()  # not sorted by Spark, which would run it twice
    assert len(got) == 3000 and seen.value == kinds * 6  # as many rows and trees as without repeats
    trees = trees_of(model.nodes, model.rules())
    assert np.allclose(got["total"], forest_totals(trees, *model.schema.arrays(got)), rtol=1e-12)


def test_skewed_weights_fill_every_sample(spark):
    df = spark.range(20_000).withColumn("w", F.when(F.col("id") < 10, 1e6).otherwise(0.05))
    got = _samples(df, 256, "w", ntrees=20, weights_as_sample_prob=True)
    assert len(got) == 20 and all(len(s) == len(set(s)) == 256 and set(range(10)) <= set(s) for s in got)


def test_inclusion_follows_weights(spark):
    df = spark.range(3000).withColumn("w", F.when(F.col("id") < 1000, 4.0).when(F.col("id") < 2000, 1.0).otherwise(0.0))
    got = _samples(df, 100, "w", ntrees=60, weights_as_sample_prob=True)
    flat = np.concatenate(got)
    assert (flat < 2000).all() and all(len(s) == 100 for s in got)
    assert 0.76 < (flat < 1000).mean() < 0.83  # a little under 4 / 5, as heavy rows run out
    with pytest.raises(ValueError, match="positive weight"):
        _samples(df.where("id >= 1950"), 100, "w", ntrees=2, weights_as_sample_prob=True)


@pytest.mark.parametrize("n,size", [(20_000, 400), (60, 60), (30, 30)])
def test_draws_with_replacement_come_from_the_whole_table(spark, n, size):
    got = _samples(spark.range(n), size, ntrees=40, sample_with_replacement=True)
    assert len(got) == 40 and all(len(s) == size for s in got)
    different = np.mean([len(set(s)) for s in got])
    assert different == pytest.approx(n * (1 - (1 - 1 / n) ** size), rel=0.03)


def test_weighted_draws_with_replacement(spark):
    df = spark.range(1000).withColumn("w", F.when(F.col("id") == 0, 999.0).otherwise(1.0))
    got = _samples(df, 200, "w", ntrees=40, sample_with_replacement=True, weights_as_sample_prob=True)
    assert all(len(s) == 200 for s in got) and np.mean([s.count(0) for s in got]) == pytest.approx(100, rel=0.06)


def test_keys_make_forests_independent_of_partitions(spark):
    df = spark.range(4000).select("id", (F.col("id") * 7919 % 1009 / 10.0).alias("x"), (F.col("id") % 13 + 0.5).alias("w"))
    for options, weight in ((dict(), None), (dict(sample_with_replacement=True), None), (dict(weights_as_sample_prob=True), "w")):
        est = IsolationForest.of(ntrees=5, sample_size=64, missing_action="fail", **options)
        a, b = (est.fit(t, ["x"], weight_col=weight, key_cols=["id"]).nodes for t in (df, df.repartition(7, "x")))
        assert len(a) == len(b) and np.array_equal(a["split"].fillna(0), b["split"].fillna(0)) and np.array_equal(a["score"].fillna(0), b["score"].fillna(0))


def test_short_way_equals_the_long_one():
    rng = np.random.default_rng(4)
    for options in (dict(), dict(ndim=2, coefs="normal")):
        model = pinned("numeric", missing_action="fail", **options)
        trees = trees_of(model.nodes, model.rules())
        num, cat = rng.uniform(0, 60, (500, 4)) * [1, 1000, 0.002, 0.002], np.empty((500, 0), np.int64)
        num[::50, 1] = np.nan
        fast = forest_totals(trees, num, cat)
        for t in trees:
            assert t.short
            t.short = False
        slow = forest_totals(trees, num, cat)
        assert np.allclose(fast, slow, rtol=1e-12, equal_nan=True) and np.isnan(fast).any() and not np.isnan(fast).all()


@pytest.mark.parametrize("action", ["divide", "impute", "fail"])
def test_rows_with_gaps_and_levels_go_a_short_way(action):
    model = pinned("lineitem", ntrees=6, max_depth=6, missing_action=action, categ_split_type="single_categ", holes=0.0 if action == "fail" else 0.1)
    rng, trees = np.random.default_rng(4), trees_of(model.nodes, model.rules())
    num = np.column_stack([rng.uniform(0, 50, 500), rng.uniform(900, 90_000, 500), rng.uniform(0, 0.1, 500), rng.uniform(0, 0.08, 500)])
    cat = np.column_stack([rng.integers(-1, 4, 500), rng.integers(-1, 3, 500)])  # with missing and unseen levels
    num[rng.random(num.shape) < 0.15], num[0, 0], num[1, 1] = np.nan, np.inf, -np.inf
    assert all(t.marked for t in trees)
    want = np.sum([t.totals(num, cat) for t in trees], axis=0)
    assert np.allclose(forest_totals(trees, num, cat), want, rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("options", [dict(), dict(coefs="normal", coef_by_prop=True, new_categ_action="smallest"), dict(categ_split_type="single_categ", new_categ_action="random")])
def test_hyperplanes_with_levels_do_not_go_the_long_way(monkeypatch, options):
    model = pinned("lineitem", ndim=3, rows=400, max_depth=9, holes=0.1, **options)
    _walks_as_the_long_way(model, monkeypatch)


@pytest.mark.parametrize("action", ["divide", "impute"])
@pytest.mark.parametrize("new", ["weighted", "smallest", "random"])
def test_levels_divided_or_new_do_not_go_the_long_way(monkeypatch, action, new):
    model = pinned("lineitem", rows=400, max_depth=9, holes=0.1, missing_action=action, categ_split_type="subset", new_categ_action=new)
    _walks_as_the_long_way(model, monkeypatch)


def _walks_as_the_long_way(model, monkeypatch):
    rng, trees, n = np.random.default_rng(6), trees_of(model.nodes, model.rules()), 3000
    num = np.column_stack([rng.uniform(0, 50, n), rng.uniform(900, 90_000, n), rng.uniform(0, 0.1, n), rng.uniform(0, 0.08, n)])
    cat = np.column_stack([rng.integers(-1, 4, n), rng.integers(-1, 3, n)])  # with missing and unseen levels
    num[rng.random(num.shape) < 0.15], num[0, 0], num[1, 1] = np.nan, np.inf, -np.inf
    want = np.sum([t.totals(num, cat) for t in trees], axis=0)
    monkeypatch.setattr(Tree, "leaves", None)
    assert np.allclose(forest_totals(trees, num, cat), want, rtol=1e-12)


def test_handmade_forests_equal_their_sql(spark, tmp_path):
    import duckdb

    flags, rows = "ANR", []
    for i in range(400):
        rows.append((i, i % 3 + 1, float(i % 50 + 1), 10.0 * i, (i % 11) / 100, 0.02, flags[i % 3], "F"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, 250.0 * i) for i in range(40)], "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    db = duckdb.connect()
    for t in ("lineitem", "supplier"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in [q for q in queries.queries() if q.startswith("hand_")]:
        got = [tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).collect()]
        want = db.sql(queries.oracle_sql()[name]).fetchall()
        key = lambda r: r[:2]
        assert len(got) == len(want) > 0, name
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a[:2] == b[:2] and (a[2] == b[2] or math.isclose(a[2], b[2], abs_tol=2e-8)), (name, a, b)


def test_outputs_of_fit_predict_and_weights_of_partial_fit(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 9 > 0, F.col("id") * 1.0).alias("y"), F.lit(1.0).alias("w"))
    est = IsolationForest.of(ntrees=5, sample_size=None)
    assert est.fit_predict(df, ["x", "y"], output="imputed", key_cols=["id"]).where("y is null").isEmpty()
    full = df.where("y is not null")
    strict = IsolationForest.of(ntrees=5, sample_size=None, missing_action="fail")
    assert strict.fit_predict(full, ["x", "y"], output="dist", id_col="id", column_weights={"x": 2.0}).where("dist between 0 and 1").count() == 53 * 52 // 2
    model = strict.fit(full, ["x", "y"])
    assert model.partial_fit(full, weight_col="w", column_weights={"x": 1.0, "y": 0.0}).nodes.query("tree == 5 and kind == 'num'")["col"].eq(0).all()


@pytest.mark.parametrize("action", ["divide", "impute"])
def test_trees_of_single_columns_take_rows_down_in_blocks(monkeypatch, action):
    model = pinned("lineitem", rows=400, max_depth=9, holes=0.1, missing_action=action, categ_split_type="single_categ")
    monkeypatch.setattr(Tree, "walk", None)  # node by node
    monkeypatch.setattr(traverse, "STRIDE", 700)
    _walks_as_the_long_way(model, monkeypatch)


@pytest.mark.parametrize("options", [dict(), dict(missing_action="impute", categ_split_type="subset", new_categ_action="smallest", max_depth=None)])
def test_trees_grown_by_levels_end_where_their_samples_do(monkeypatch, options):
    rng, n = np.random.default_rng(3), 4000
    num, cat = rng.normal(size=(n, 3)).round(1), np.column_stack([rng.integers(-1, 4, n), rng.integers(0, 2, n)])
    num[rng.random(num.shape) < 0.1], num[:3, 0] = np.nan, [np.inf, -np.inf, 1e300]
    p = params.ForestParams.of(build_imputer=True, **options).resolved().with_columns(3, 2)
    schema = Schema(("a", "b", "c"), ("d", "e"), (tuple("wxyz"), tuple("uv")))
    growers = [Grower(Sample(num, cat, [4, 2], np.ones(n)), p, np.random.default_rng(t), 12 if p.max_depth else None) for t in range(40)]
    assert all(map(can_level, growers))
    by_node = [pd.DataFrame(Grower(g.s, p, np.random.default_rng(t), g.max_depth).grow(t, lists=False)) for t, g in enumerate(growers)]
    monkeypatch.setattr(Grower, "grow", None)
    by_level = [pd.DataFrame(grow_levels(g, t)) for t, g in enumerate(growers)]
    depths = []
    for nodes in by_level:
        inner, leaves = nodes[nodes["kind"] != "leaf"], nodes[nodes["kind"] == "leaf"]
        assert (nodes["node"] == nodes.index).all() and (inner["left"] == inner["node"] + 1).all()
        assert (nodes["parent"].to_numpy()[inner[["left", "right"]]] == inner["node"].to_numpy()[:, None]).all() and len(nodes) == 2 * len(leaves) - 1
        tree = trees_of(nodes, forest._rules(p, schema))[0]
        _, ends, w = tree.walk(Rows.of(num, cat, tree))
        assert np.allclose(np.bincount(ends, w, len(nodes))[leaves.index], leaves["n"]) and leaves["imp"].map(len).min() > 0
        depths.append([np.average(leaves["depth"], weights=leaves["n"]), len(nodes), (inner["kind"] == "num").mean()])
    want = [[np.average(x["depth"], weights=x["n"]), len(t), (t[t["kind"] != "leaf"]["kind"] == "num").mean()] for t in by_node for x in [t[t["kind"] == "leaf"]]]
    a, b = np.array(depths), np.array(want)
    assert (np.abs(a.mean(axis=0) - b.mean(axis=0)) < 5 * np.sqrt((a.var(axis=0) + b.var(axis=0)) / 40)).all(), (a.mean(axis=0), b.mean(axis=0))


def test_rows_that_may_change_when_read_again_are_all_scored(spark, monkeypatch):
    data = spark.range(300).select("id", (F.col("id") % 40).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") % 7 * 1.0).alias("y"))
    monkeypatch.setattr("copse.operators.forest.MOST_NODES", 300)
    model = IsolationForest.of(ntrees=6, sample_size=200, build_imputer=True).fit(data, ["x", "y"], key_cols=["id"])
    want = {r["id"]: r["score"] for r in model.predict(data).collect()}
    few = data.orderBy(F.rand()).limit(50)
    got = model.predict(few).collect()
    assert len(got) == 50 and all(math.isclose(r["score"], want[r["id"]], rel_tol=1e-12) for r in got)
    odd = data.withColumn("x", F.when(F.rand() < 0.5, F.col("x")))
    filled = model.transform(odd).collect()
    assert len(filled) == 300 and all(r["x"] is not None and r["y"] is not None for r in filled)
    same = data.select("id", F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("x"), F.when(F.col("id") % 3 > 0, F.lit(float("nan"))).alias("y"))
    scores = {r["score"] for r in model.predict(same).collect()}
    assert len(scores) == 1 and None not in scores  # zeros of both signs are one, and so are nulls and NaN


def test_equal_rows_with_holes_are_imputed_once(spark, monkeypatch):
    from copse.operators import impute

    data = spark.range(2000).select("id", (F.col("id") % 30).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") % 30 % 7 * 1.0).alias("y"), F.when(F.col("id") % 4 > 0, "a").alias("c"))
    kinds = data.where("y IS NULL OR c IS NULL").select("x", "y", "c").distinct().count()
    monkeypatch.setattr("copse.operators.forest.MOST_NODES", 300)
    model = IsolationForest.of(ntrees=6, sample_size=200, build_imputer=True).fit(data, ["x", "y", "c"], key_cols=["id"])
    seen, sent, gathered, columns = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), impute._gathered, impute.columns_of

    def counted(forest, num, cat, starts):
        seen.add(len(num))
        return gathered(forest, num, cat, starts)

    def opened(rows, name):
        sent.add(len(rows))
        return columns(rows, name)

    monkeypatch.setattr(impute, "_gathered", counted)
    monkeypatch.setattr(impute, "columns_of", opened)
    got, want = model.transform(data).toPandas().set_index("id").sort_index(), data.toPandas().set_index("id").sort_index()
    assert len(got) == 2000 and seen.value == sent.value == kinds < 100  # rows that miss nothing do not meet the trees
    assert not got.isna().any(axis=None) and all((got[c] == want[c])[want[c].notna()].all() for c in "xyc")
