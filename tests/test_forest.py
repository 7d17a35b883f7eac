import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from copse.operators import similarity
from copse.operators.forest import ForestModel, IsolationForest, Schema
from copse.plans import export, params, queries
from copse.plans.pinned import pinned
from copse.sources import store
from copse.streaming.online import OnlineForest, score_stream


@pytest.fixture(scope="module")
def blob(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(300, 2)), [[6, 6]]])
    return spark.createDataFrame(pd.DataFrame({"id": range(301), "x0": x[:, 0], "x1": x[:, 1]}))


@pytest.mark.parametrize("p", [params.iforest(ntrees=20), params.eif(ntrees=20), params.sciforest(ntrees=10, ntry=2), params.fcf(ntrees=20), params.rrcf(ntrees=20)])
def test_planted_outlier_scores_highest(spark, blob, p):
    model = IsolationForest(p).fit(blob, ["x0", "x1"])
    top = model.predict(blob).orderBy(F.desc("score")).first()
    assert top["id"] == 300 and model.ntrees == p.ntrees


def test_array_columns_are_features_of_their_elements(spark, blob, tmp_path):
    rows = blob.select("id", "x0", F.array("x0", "x1").alias("v"))
    flat = blob.select("id", F.col("x0").alias("a"), F.col("x1").alias("b"))
    model = IsolationForest(params.iforest(ntrees=10)).fit(rows, ["v"], key_cols=["id"])
    assert model.schema.numeric == ("v[0]", "v[1]")
    want = IsolationForest(params.iforest(ntrees=10)).fit(flat, ["a", "b"], key_cols=["id"])
    scores = lambda m, df: [r["score"] for r in m.predict(df).orderBy("id").collect()]
    assert scores(model, rows) == scores(want, flat)
    model.save(spark, str(tmp_path / "m"))
    assert scores(store.load(spark, str(tmp_path / "m")), rows) == scores(want, flat)
    short = rows.withColumn("v", F.when(F.col("id") == 0, F.lit(None)).when(F.col("id") == 1, F.slice("v", 1, 1)).otherwise(F.col("v")))
    assert scores(model, short) == [None, None, *scores(want, flat)[2:]]  # the preset's missing_action is "fail"
    assert len(IsolationForest.of(ntrees=2, sample_size=64).fit(short, ["v"], key_cols=["id"]).schema.numeric) == 2
    with pytest.raises(ValueError, match="missing"):
        model.predict(flat)
    with pytest.raises(TypeError, match="array"):
        IsolationForest.of(ntrees=2, build_imputer=True).fit(rows, ["v"], key_cols=["id"]).transform(rows)
    with pytest.raises(TypeError):
        Schema.infer(rows.select(F.array(F.lit("x")).alias("t")))


def test_exports_take_other_names():
    model = pinned("lineitem")
    given = dict(column_names=["c0", "c1", "c2", "c3"], column_names_categ=["k0", "k1"])
    texts = [export.score_sql(model, **given), export.to_json(model, as_str=True, **given), export.to_dot(model, 1, **given)]
    assert all("l_" not in x and "c" in x for x in texts)
    leaves = [n for n in export.to_json(model, tree=0, output_tree_num=True).values() if n["terminal"] == "Yes"]
    assert [n["leaf"] for n in leaves] == list(range(len(leaves))) and not any("score" in n for n in leaves)
    assert "leaf 0" in export.to_dot(model, output_tree_num=True) and "score" not in export.to_dot(model, output_tree_num=True)
    with pytest.raises(ValueError, match="names"):
        export.to_sql(model, column_names=["a"])


@pytest.mark.parametrize("metric", ["depth", "adj_depth", "adj_density", "density", "boxed_density", "boxed_density2", "boxed_ratio"])
def test_metrics_are_finite_and_match_raw(spark, blob, metric):
    model = IsolationForest.of(ntrees=10, sample_size=64, scoring_metric=metric, missing_action="fail").fit(blob, ["x0", "x1"])
    rows = model.predict(model.predict(blob), "avg_depth").toPandas()
    assert np.isfinite(rows["score"]).all() and rows["score"].rank().corr(rows["avg_depth"].rank()) < -0.99


def test_result_does_not_depend_on_partitions_and_leaves_partition_the_sample(spark, blob):
    model = IsolationForest.of(ntrees=5, sample_size=None, missing_action="fail", weights_as_sample_prob=False).fit(blob, ["x0", "x1"])
    for _, nodes in model.nodes.groupby("tree"):
        leaves = nodes[nodes["kind"] == "leaf"]
        assert leaves["n"].sum() == pytest.approx(301)
        inner = nodes[nodes["kind"] != "leaf"]
        assert (inner["left"] == inner["node"] + 1).all()
    a = model.predict(blob).orderBy("id").toPandas()["score"]
    b = model.predict(blob.repartition(7)).orderBy("id").toPandas()["score"]
    assert (a == b).all()


def test_missing_values(spark, blob):
    holes = blob.withColumn("x0", F.when(F.col("id") % 5 != 0, F.col("x0")))
    divided = IsolationForest.of(ntrees=5, sample_size=64).fit(holes, ["x0", "x1"])
    ends = divided.leaf_table(holes, "id").groupBy("id", "tree").agg(F.sum("weight").alias("w"))
    assert ends.where(F.abs(F.col("w") - 1) > 1e-9).isEmpty() and ends.count() == 301 * 5
    with pytest.raises(Exception, match="divided"):
        divided.predict(holes, "tree_num").collect()
    with pytest.raises(Exception, match="missing"):
        IsolationForest(params.iforest()).fit(holes, ["x0", "x1"])
    strict = IsolationForest(params.iforest(ntrees=5)).fit(blob, ["x0", "x1"])
    assert strict.predict(holes).where("score is null").count() > 0


def test_kernel_and_distance(spark, blob):
    model = IsolationForest.of(ntrees=8, sample_size=64, missing_action="fail").fit(blob, ["x0", "x1"])
    few = blob.where("id < 12")
    same = similarity.pairwise(model, few, "id", "kernel", include_same=True)
    assert same.where("id_a = id_b and kernel <> 1").isEmpty()
    d = model.predict_distance(few, "id").toPandas()
    assert len(d) == 66 and d["dist"].between(0, 1).all()
    both = model.predict_distance(few, "id", refs=few).toPandas().set_index(["id_a", "id_b"])["dist"]
    assert all(both[a, b] == both[b, a] for a, b in both.index)
    marks = similarity.Landmarks(model, few, "id")
    assert marks.count() == 12 and marks.inverted().count() > 0


@pytest.mark.parametrize("full", [True, False])
def test_distances_of_forests_with_many_leaves(spark, blob, monkeypatch, full):
    model = IsolationForest.of(ntrees=4, sample_size=64, missing_action="fail", assume_full_distr=full).fit(blob, ["x0", "x1"])
    few, marks = blob.where("id < 12"), blob.where("id > 290") if full else None
    by_table = model.predict_distance(few, "id", "avg_sep", marks).toPandas().set_index(["id_a", "id_b"])["avg_sep"].sort_index()
    monkeypatch.setattr(similarity, "MOST_LEAF_PAIRS", 100)
    by_path = model.predict_distance(few, "id", "avg_sep", marks).toPandas().set_index(["id_a", "id_b"])["avg_sep"].sort_index()
    assert len(by_table) == (120 if full else 66) and (by_path.index == by_table.index).all() and np.allclose(by_path, by_table, rtol=1e-12)


@pytest.mark.parametrize("output", ["avg_sep", "kernel"])
def test_values_between_rows_are_computed_once_per_pair_of_classes(spark, monkeypatch, output):
    monkeypatch.setattr(similarity, "PART_ROWS", 2)
    model = pinned("supplier", missing_action="fail", ntrees=6)
    # Copies, an id that comes twice, one that is null, and a row without a value.
    given = [(i, 1000.0 * (i % 7), float(i % 3)) for i in range(60)] + [(5, 9000.0, 20.0), (None, 10.0, 4.0), (61, None, 2.0)]
    rows = spark.createDataFrame(given, "id long, s_acctbal double, s_nationkey double")
    leaves = model.leaf_table(rows, "id").select("id", "tree", "leaf").toPandas()
    classes = similarity._classes(model, rows, "id")
    assert classes.count() == leaves["id"].nunique(dropna=False) and classes.select("class").distinct().count() <= 24
    sep = similarity.leaf_separation(model)
    if output == "kernel":
        sep = sep[sep["leaf_a"] == sep["leaf_b"]].assign(sep=1.0)
    both = leaves.rename(columns={"id": "id_a", "leaf": "leaf_a"}).merge(sep, on=["tree", "leaf_a"]).merge(leaves.rename(columns={"id": "id_b", "leaf": "leaf_b"}), on=["tree", "leaf_b"])
    want = (both.groupby(["id_a", "id_b"], dropna=False)["sep"].sum() / 6.0).reset_index()
    got = model.predict_distance(rows, "id", output, digits=8).toPandas()
    refs = model.predict_distance(rows, "id", output, rows.where("id % 10 = 0 or id is null"), digits=8).toPandas()
    for found, wanted in ((got, want[want["id_a"] < want["id_b"]]), (refs, want[(want["id_b"] % 10 == 0) | want["id_b"].isna()])):
        found, wanted = (x.sort_values(["id_a", "id_b"]).to_numpy(float) for x in (found, wanted))
        assert found.shape == wanted.shape and np.allclose(found, wanted, atol=1e-8, equal_nan=True)


def test_imputation_beats_the_mean(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=400)
    x = np.column_stack([z + 0.1 * rng.normal(size=400) for _ in range(4)])
    holes = x.copy()
    holes[rng.random(x.shape) < 0.15] = np.nan
    df = spark.createDataFrame(pd.DataFrame(holes, columns=list("abcd")).assign(id=range(400), tag="t"))
    got = IsolationForest.of(ntrees=40, build_imputer=True, sample_size=None).fit_transform(df, list("abcd")).orderBy("id")
    assert got.columns == df.columns
    out, lost = got.toPandas()[list("abcd")].to_numpy(), np.isnan(holes)
    means = np.broadcast_to(np.nanmean(holes, axis=0), x.shape)
    assert ((out - x)[lost] ** 2).mean() < ((means - x)[lost] ** 2).mean() and (out[~lost] == holes[~lost]).all()


@pytest.mark.parametrize("ndim", [1, 2])
def test_a_forest_too_large_for_the_driver_scores_and_imputes_as_others(spark, monkeypatch, ndim):
    rng = np.random.default_rng(8)
    data = pd.DataFrame({"id": range(400), "x": rng.normal(size=400), "y": rng.normal(size=400), "c": rng.choice(list("aabc"), 400), "d": rng.choice(list("uv"), 400)})
    holes = spark.createDataFrame(data).withColumn("x", F.when(F.col("id") % 6 != 0, F.col("x"))).withColumn("c", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("c")))
    est = IsolationForest.of(ntrees=9, sample_size=100, build_imputer=True, ndim=ndim)
    small = est.fit(holes, ["x", "y", "c", "d"], key_cols=["id"])
    monkeypatch.setattr("copse.operators.forest.MOST_NODES", 300)
    monkeypatch.setattr("copse.operators.forest.ROUND_ROWS", 400)
    large = est.fit(holes, ["x", "y", "c", "d"], key_cols=["id"])
    new = holes.withColumn("d", F.when(F.col("id") < 20, "w").otherwise(F.col("d")))
    tables = [[m.predict(new), m.transform(new)] for m in (small, large)]
    assert "_frame" not in large.__dict__ and large.ntrees == 9 and len(large.sent(spark)) > 2  # the driver never held its nodes
    for a, b in zip(*tables, strict=True):
        a, b = (t.orderBy("id").toPandas() for t in (a, b))
        assert len(a) == len(b) == 400 and (a[["id", "c", "d"]].fillna("-") == b[["id", "c", "d"]].fillna("-")).all(axis=None)
        assert all(np.allclose(a[c], b[c], rtol=1e-12, equal_nan=True) for c in a.columns if c not in ("id", "c", "d"))
    assert tables[1][1].where("x IS NULL OR c IS NULL").isEmpty()
    ends = [m.leaf_table(holes.where("id < 9"), "id").toPandas().sort_values(["id", "tree", "leaf"]).reset_index(drop=True) for m in (small, large)]
    pd.testing.assert_frame_equal(*ends)
    both = [m.nodes.drop(columns=["imp", "terms", "cat_left", "cat_right"]).astype({"kind": str}) for m in (small, large)]
    pd.testing.assert_frame_equal(*both, check_dtype=False, check_exact=True)
    plain = lambda v: None if v is None else [{k: None if x is None else np.ravel(np.array(x, float)).tolist() for k, x in t.items()} if isinstance(t, dict) else int(t) for t in v]
    for c in ("terms", "cat_left", "cat_right"):
        assert repr(small.nodes[c].map(plain).tolist()) == repr(large.nodes[c].map(plain).tolist())
    for a, b in zip(small.nodes["imp"], large.nodes["imp"], strict=True):
        assert (a is None) == (b is None) and (a is None or [dict(x) for x in a] == [dict(x) for x in b])


def test_categories_and_new_levels(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "c": rng.choice(list("aabbc"), 200), "b": rng.random(200) < 0.5, "x": rng.random(200)}))
    new = df.withColumn("c", F.when(F.col("id") < 10, "zz").otherwise(F.col("c")))
    for options in (dict(), dict(categ_split_type="subset"), dict(categ_split_type="subset", new_categ_action="random"), dict(categ_split_type="subset", new_categ_action="smallest", missing_action="impute"), dict(ndim=2)):
        model = IsolationForest.of(ntrees=8, sample_size=100, **options).fit(df, ["c", "b", "x"])
        assert model.schema == Schema(("x",), ("c", "b"), (("a", "b", "c"), ("false", "true")))
        assert model.predict(new).where("score is null").isEmpty()


def test_save_load_append_subset_and_partial_fit(spark, blob, tmp_path):
    model = IsolationForest.of(ntrees=4, sample_size=64, missing_action="fail").fit(blob, ["x0", "x1"])
    model.save(spark, str(tmp_path / "m"))
    again = store.load(spark, str(tmp_path / "m"))
    scores = lambda m: m.predict(blob).orderBy("id").toPandas()["score"].to_numpy()
    assert (scores(again) == scores(model)).all() and again.params == model.params
    both = model.append_trees(again)
    assert both.ntrees == 8 and np.allclose(scores(both), scores(model)) and (scores(model.subset_trees([0, 1, 2, 3])) == scores(model)).all()
    grown = model.partial_fit(blob)
    assert grown.ntrees == 5 and grown.depth_norm == model.depth_norm and model.ntrees == 4
    assert store.append(spark, grown, str(tmp_path / "m")) == 1 and store.load(spark, str(tmp_path / "m")).ntrees == 5
    with pytest.raises(ValueError):
        model.append_trees(IsolationForest(params.eif(ntrees=2)).fit(blob, ["x0", "x1"]))


def test_registered_partial_fit_sees_every_order(spark, tmp_path, monkeypatch):
    spark.range(1, 301).selectExpr("id AS o_orderkey", "CAST(id % 17 AS DOUBLE) AS o_totalprice", "id % 7 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    models, fit = [], ForestModel.partial_fit
    monkeypatch.setattr(ForestModel, "partial_fit", lambda self, df, **k: models.append(fit(self, df, **k)) or models[-1])
    assert queries.queries()["fit_partial"](spark, str(tmp_path)).count() == 300
    roots = models[0].nodes[models[0].nodes["parent"] < 0].set_index("tree")["n"]
    assert len(roots) == 11 and roots[10] == 300


def test_a_tree_on_more_rows_than_a_task_holds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(pd.DataFrame({"id": range(600), "x": rng.normal(size=600), "y": rng.normal(size=600), "c": rng.choice(list("aabc"), 600)}))
    holes = rows.withColumn("x", F.when(F.col("id") % 6 != 0, F.col("x")))
    model = IsolationForest.of(ntrees=2, sample_size=64, max_depth=6).fit(holes, ["x", "y", "c"], key_cols=["id"])
    monkeypatch.setattr("copse.operators.forest.MOST_TASK_ROWS", 100)
    grown = model.partial_fit(holes, key_cols=["id"])
    tree = grown.nodes[grown.nodes["tree"] == 2].reset_index(drop=True)
    assert (tree["node"] == tree.index).all() and tree["n"][0] == 600 and tree["depth"].max() <= 6 and len(tree) > 15
    inner, leaves = tree[tree["kind"] != "leaf"], tree[tree["kind"] == "leaf"]
    assert (inner["left"] == inner["node"] + 1).all() and np.isclose(leaves["n"].sum(), 600) and leaves["score"].notna().all()
    ends = grown.leaf_table(holes, "id").where("tree = 2").groupBy("node").agg(F.sum("weight").alias("w")).toPandas().set_index("node")["w"].sort_index()
    assert np.allclose(ends, leaves.set_index("node")["n"])  # every row of the table, where scoring sends it
    with pytest.raises(ValueError, match="task may hold"):
        IsolationForest.of(ndim=2, max_depth=6).fit_predict(rows, ["x", "y"])


def test_registered_fits_use_presets_and_defaults(spark, monkeypatch):
    seen = []

    class Seen(IsolationForest):
        def fit(self, *_, **__):
            seen.append(self.params)
            raise InterruptedError

        of = staticmethod(lambda **given: Seen(params.ForestParams.of(**given)))

    line = spark.range(1).selectExpr("id AS l_orderkey", "1 AS l_linenumber", *(f"1.0D AS {c}" for c in queries.NUM), "'A' AS l_returnflag", "'F' AS l_linestatus")
    monkeypatch.setattr(queries, "_table", lambda *_: line)
    monkeypatch.setattr(queries, "IsolationForest", Seen)
    for name in ("fit_sciforest", "fit_fcf", "fit_mixed_missing", "fit_extended_mixed", "fit_transform_impute"):
        with pytest.raises(InterruptedError):
            queries.queries()[name](spark, "")
    assert seen == [params.sciforest(), params.fcf(), params.ForestParams(), params.ForestParams(ndim=2), params.ForestParams(build_imputer=True)]


def test_exports(spark, blob):
    model = IsolationForest.of(ntrees=3, sample_size=64, missing_action="fail").fit(blob, ["x0", "x1"])
    exact = model.predict(blob).select("score", F.expr(export.score_sql(model, enclose="backticks")).alias("again")).toPandas()
    assert np.allclose(exact["score"], exact["again"], rtol=1e-12)
    blob.createOrReplaceTempView("blob_rows")
    assert spark.sql(export.to_sql(model, enclose="backticks", table_from="blob_rows")).count() == 301
    assert len(export.to_json(model)) == 3 and export.to_dot(model).startswith("digraph") and len(export.to_sql(model)) == 3
    with pytest.raises(NotImplementedError):
        export.to_treelite(model)


def test_refusals(spark, blob):
    with pytest.raises(ValueError, match="3 rows"):
        IsolationForest(params.iforest()).fit(blob.limit(2), ["x0"])
    with pytest.raises(TypeError):
        IsolationForest(params.iforest()).fit(blob.withColumn("a", F.array(F.lit("x"))), ["a"])
    with pytest.raises(ValueError, match="missing"):
        IsolationForest(params.iforest(ntrees=2)).fit(blob, ["x0"]).predict(blob.drop("x0"))


def test_row_weights(spark, blob):
    heavy = blob.withColumn("w", F.when(F.col("id") < 30, 1.0).otherwise(0.0))
    model = IsolationForest.of(ntrees=4, sample_size=16, missing_action="fail").fit(heavy, ["x0", "x1"], weight_col="w")
    low, high = heavy.where("w > 0").agg(F.min("x0"), F.max("x0")).first()
    splits = model.nodes[(model.nodes["kind"] == "num") & (model.nodes["col"] == 0)]["split"]
    assert splits.between(low, high).all()


def test_streaming(spark, blob, tmp_path):
    blob.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(blob.schema).parquet(str(tmp_path / "in"))
    online = OnlineForest(IsolationForest(params.iforest(ntrees=3)).fit(blob, ["x0", "x1"]), most_trees=3)
    q = online.start(stream, str(tmp_path / "c1"), availableNow=True)
    q.awaitTermination(120)
    assert online.model.ntrees == 3 and online.last_batch >= 0
    q = score_stream(online.model, stream).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("scored").where("score is not null").count() == 301


def test_pinned_forests_are_stable():
    a, b = pinned("lineitem"), pinned.__wrapped__("lineitem")
    assert (a.nodes["score"].fillna(-1) == b.nodes["score"].fillna(-1)).all()


def test_entry_imports_and_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
