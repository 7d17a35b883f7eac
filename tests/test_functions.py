import math

import numpy as np
import pytest

from copse.functions import criteria, frames, special
from copse.operators.grow import Grower, Sample
from copse.plans import params
from copse.plans.params import ForestParams


def test_expected_depth_and_separation():
    assert special.expected_depth(1) == 0 and special.expected_depth(2) == pytest.approx(1) and special.expected_depth(3) == pytest.approx(5 / 3)
    assert special.expected_depth(1000) == pytest.approx(2 * (sum(1 / k for k in range(1, 1001)) - 1))
    assert [special.expected_separation(n) for n in (1, 2, 3, 4)] == pytest.approx([0, 1, 4 / 3, 1 + 1 / 3 + 2 / 9])
    assert special.expected_separation(2.5) == pytest.approx((1 + 4 / 3) / 2) and special.expected_separation(10**9) == 3


def test_midpoint_stays_below_the_upper_value():
    assert criteria.midpoint(np.array([1.0]), np.array([np.nextafter(1.0, 2)]))[0] == 1.0


@pytest.mark.parametrize("criterion", ["avg", "pooled", "dens", "full"])
def test_best_numeric_is_the_best_of_all_cuts(criterion):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=40), 1)
    others = np.column_stack([x, rng.normal(size=40)])
    gain, cut = criteria.best_numeric(x, np.ones(40), criterion, others)

    def value(c):
        left, right = x[x <= c], x[x > c]
        nl, nr, n = len(left), len(right), len(x)
        if criterion == "avg":
            return 1 - (left.std() + right.std()) / (2 * x.std())
        if criterion == "pooled":
            return 1 - (nl * left.std() + nr * right.std()) / (n * x.std())
        if criterion == "dens":
            r = (c - x.min()) / np.ptp(x)
            return (nl / n) ** 2 / r + (nr / n) ** 2 / (1 - r) - 1
        parts = sum(m.sum() ** 2 / len(m) for col in others.T for m in ((col - col.mean())[x <= c], (col - col.mean())[x > c]))
        return parts / ((others - others.mean(axis=0)) ** 2).sum()

    u = np.unique(x)
    assert gain == pytest.approx(max(value((a + b) / 2) for a, b in zip(u, u[1:], strict=False))) and value(cut) == pytest.approx(gain)


def test_kurtosis_and_expected_sd():
    assert criteria.kurtosis(np.array([1.0, 2, 3, 4, np.nan]), np.ones(5)) == pytest.approx(1.64)
    rng = np.random.default_rng(1)
    counts = np.array([5.0, 3, 2])
    draws = rng.random((200_000, 3))
    p = counts / 10
    var = (p * draws**2).sum(axis=1) - (p * draws).sum(axis=1) ** 2
    assert criteria.expected_sd(counts) == pytest.approx(math.sqrt(var.mean()), rel=0.01)
    assert criteria.best_single(counts)[1] == 0
    rest = np.where(np.arange(len(counts)) == 0, 0, counts)
    assert criteria.best_single(counts, "avg")[0] == pytest.approx(1 - criteria.expected_sd(rest) / (2 * criteria.expected_sd(counts)))
    assert criteria.best_single(np.array([8.0, 9.0, 1.0, 0.0]), "dens") == (pytest.approx((1 / 18) ** 2 * 3 + (17 / 18) ** 2 * 1.5 - 1), 2)
    assert criteria.best_single(np.array([1.0, 1.0, 7.0]), "dens")[1] == 2 and criteria.best_single(np.array([5.0, 0.0]), "dens") is None
    assert criteria.best_subset(counts, "pooled", True)[0] >= criteria.best_subset(counts, "pooled", False)[0] - 1e-9


@pytest.mark.parametrize("bad", [
    dict(weigh_by_kurtosis=True, prob_pick_col_by_kurt=0.5), dict(build_imputer=True, missing_action="fail"), dict(categ_split_type="subset", new_categ_action="impute"), dict(ndim=2, missing_action="divide"),
    dict(ndim=2, categ_split_type="subset", new_categ_action="weighted"), dict(penalize_range=True, scoring_metric="density"), dict(ntrees=0), dict(coefs="other"),
])
def test_rejected_parameters(bad):
    with pytest.raises(ValueError):
        ForestParams.of(**bad).resolved()


def test_defaults_aliases_and_presets():
    p = ForestParams.of(n_estimators=7, max_samples=9, random_state=3).resolved()
    assert (p.ntrees, p.sample_size, p.random_seed, p.missing_action, p.new_categ_action, p.categ_split_type) == (7, 9, 3, "divide", "weighted", "single_categ")
    assert ForestParams.of(ndim=2).resolved().missing_action == "impute" and params.sciforest().ntry == 10 and params.fcf().ntrees == 200
    with pytest.warns(UserWarning):
        assert ForestParams.of(prob_pick_avg_gain=1.0, prob_pick_dens=1.0).resolved().prob_pick_dens == 0.5
    with pytest.warns(UserWarning):
        assert ForestParams.of(ndim=4).with_columns(1, 1).ndim == 2
    with pytest.raises(ValueError):
        ForestParams.of(prob_pick_full_gain=1.0).with_columns(1, 1)


def test_all_subsets_are_tried_or_refused():
    counts = np.arange(1.0, 14.0)
    with pytest.raises(ValueError, match="all_perm"):
        criteria.best_subset(counts, "pooled", True)
    assert criteria.best_subset(counts[:12], "pooled", True) and criteria.best_subset(counts, "pooled", False)


@pytest.mark.parametrize("criterion", ["avg", "pooled", "dens"])
def test_infinite_values_are_cut_off(criterion):
    x = np.concatenate([np.linspace(0, 1, 30), [np.inf, np.inf]])
    p = ForestParams.of(**{"prob_pick_dens" if criterion == "dens" else f"prob_pick_{criterion}_gain": 1.0}).resolved()
    nodes = Grower(Sample(x[:, None], np.empty((32, 0), np.int64), [], np.ones(32)), p, np.random.default_rng(0), 6).grow(0)
    assert np.isfinite(nodes[0]["split"])
    if criterion != "dens":  # by density, the finite values are so crowded that a cut among them gains more
        assert nodes[0]["split"] >= 1 and nodes[0]["pct_left"] == pytest.approx(30 / 32)
    assert all(np.isfinite(n["score"]) for n in nodes if n["kind"] == "leaf")


def test_first_draw_follows_chances():
    g = Grower(Sample(np.zeros((4, 3)), np.empty((4, 0), np.int64), [], np.ones(4)), ForestParams.of().resolved(), np.random.default_rng(0), 3)
    cols = np.array([0, 1, 2])
    weighted = np.bincount([int(g._draw(cols, 1, np.array([0.2, 0.0, 0.8]))[0]) for _ in range(2000)], minlength=3) / 2000
    assert weighted[1] == 0 and abs(weighted[0] - 0.2) < 0.04
    even = np.bincount([int(g._draw(cols, 1, None)[0]) for _ in range(2000)], minlength=3) / 2000
    assert (abs(even - 1 / 3) < 0.04).all()
    assert sorted(g._draw(cols, 5, None)) == [0, 1, 2] and sorted(g._draw(cols, 5, np.array([0.2, 0.0, 0.8]))) == [0, 2]


@pytest.mark.parametrize("parts", [2, 7, 256])
def test_split_gains_over_ranges_equal_the_search_in_memory(spark, parts):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=500) * 3, 1)
    x[::3] = 1.5  # a third of all rows
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    got = frames.split_gains(rows, "x", parts).toPandas().sort_values("cut")
    assert len(got) == len(np.unique(x)) - 1
    assert got["n_left"].tolist() == [float((x <= c).sum()) for c in got["cut"]] and (got["n_left"] + got["n_right"] == 500).all()
    for criterion in ("avg", "pooled", "dens"):
        gain, cut = criteria.best_numeric(x, np.ones(500), criterion)
        best = got.loc[got[f"{criterion}_gain"].idxmax()]
        assert best[f"{criterion}_gain"] == pytest.approx(gain) and (criterion == "pooled" or best["cut"] == pytest.approx(cut))
    assert frames.split_gains(rows.where("x is null"), "x", parts).count() == 0
    assert frames.split_gains(rows.where("x = 1.5"), "x", parts).count() == 0
