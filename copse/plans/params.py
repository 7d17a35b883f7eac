"""Parameters of a forest, their defaults, their checks, and the named presets."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace

from copse.functions.special import METRICS

AUTO = "auto"
_ALIASES = {"n_estimators": "ntrees", "max_samples": "sample_size", "random_state": "random_seed", "bootstrap": "sample_with_replacement", "n_jobs": "nthreads"}
_CHOICES = {
    "missing_action": (AUTO, "divide", "impute", "fail"),
    "new_categ_action": (AUTO, "weighted", "impute", "smallest", "random"),
    "categ_split_type": (AUTO, "subset", "single_categ"),
    "coefs": ("uniform", "normal"),
    "depth_imp": ("lower", "higher", "same"),
    "weigh_imp_rows": ("inverse", "prop", "flat"),
    "scoring_metric": METRICS,
}


@dataclass(frozen=True)
class ForestParams:
    sample_size: int | float | str | None = AUTO
    ntrees: int = 500
    ndim: int = 1
    ntry: int = 1
    categ_cols: tuple[str, ...] = ()
    max_depth: int | str | None = AUTO
    ncols_per_tree: int | float | None = None
    prob_pick_avg_gain: float = 0.0
    prob_pick_pooled_gain: float = 0.0
    prob_pick_full_gain: float = 0.0
    prob_pick_dens: float = 0.0
    prob_pick_col_by_range: float = 0.0
    prob_pick_col_by_var: float = 0.0
    prob_pick_col_by_kurt: float = 0.0
    min_gain: float = 0.0
    missing_action: str = AUTO
    new_categ_action: str = AUTO
    categ_split_type: str = AUTO
    all_perm: bool = False
    coef_by_prop: bool = False
    weights_as_sample_prob: bool = True
    sample_with_replacement: bool = False
    penalize_range: bool = False
    standardize_data: bool = True
    scoring_metric: str = "depth"
    fast_bratio: bool = True
    weigh_by_kurtosis: bool = False
    coefs: str = "uniform"
    assume_full_distr: bool = True
    build_imputer: bool = False
    min_imp_obs: int = 3
    depth_imp: str = "higher"
    weigh_imp_rows: str = "inverse"
    random_seed: int = 1
    recode_categ: bool = False
    use_long_double: bool = False
    nthreads: int = -1

    @staticmethod
    def of(**given) -> ForestParams:
        given = {_ALIASES.get(k, k): v for k, v in given.items()}
        known = {f.name for f in fields(ForestParams)}
        if unknown := set(given) - known:
            raise TypeError(f"unknown parameters: {sorted(unknown)}")
        if "categ_cols" in given:
            given["categ_cols"] = tuple(given["categ_cols"] or ())
        return ForestParams(**given)

    def resolved(self) -> ForestParams:
        """Checked, with every "auto" replaced that does not need the data, and probabilities that exceed one scaled down."""
        p = self
        for name, allowed in _CHOICES.items():
            if getattr(p, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(p, name)!r}")
        if p.ntrees < 1 or p.ndim < 1 or p.ntry < 1 or p.min_imp_obs < 1 or p.min_gain < 0:
            raise ValueError("ntrees, ndim, ntry and min_imp_obs must be at least 1, and min_gain not negative")
        for group in (("avg_gain", "pooled_gain", "full_gain", "dens"), ("col_by_range", "col_by_var", "col_by_kurt")):
            names = [f"prob_pick_{x}" for x in group]
            total = sum(getattr(p, n) for n in names)
            if any(getattr(p, n) < 0 for n in names):
                raise ValueError("probabilities can't be negative")
            if total > 1 + 1e-9:
                warnings.warn(f"{', '.join(names)} sum to {total}; they are scaled to 1", stacklevel=2)
                p = replace(p, **{n: getattr(p, n) / total for n in names})
        wide = p.ndim > 1
        p = replace(
            p,
            missing_action=("impute" if wide else "divide") if p.missing_action == AUTO else p.missing_action,
            new_categ_action=("impute" if wide else "weighted") if p.new_categ_action == AUTO else p.new_categ_action,
            categ_split_type=("subset" if wide else "single_categ") if p.categ_split_type == AUTO else p.categ_split_type,
        )
        if p.weigh_by_kurtosis and p.prob_pick_col_by_kurt:
            raise ValueError("weigh_by_kurtosis and prob_pick_col_by_kurt exclude each other")
        if p.build_imputer and p.missing_action == "fail":
            raise ValueError("an imputer can't be built with missing_action='fail'")
        if not wide and p.categ_split_type == "subset" and p.new_categ_action == "impute":
            raise ValueError("ndim=1 with subset splits can't impute new categories")
        if wide and p.missing_action == "divide":
            raise ValueError("ndim>1 can't divide missing values")
        if wide and p.categ_split_type == "subset" and p.new_categ_action == "weighted":
            raise ValueError("ndim>1 with subset splits can't weigh new categories")
        if p.penalize_range and p.scoring_metric in ("density", "adj_density", "boxed_density", "boxed_density2", "boxed_ratio"):
            raise ValueError(f"penalize_range can't be used with scoring_metric={p.scoring_metric!r}")
        return p

    def with_columns(self, n_numeric: int, n_categ: int) -> ForestParams:
        """Checks that need the columns; more dimensions than columns are lowered."""
        p = self
        if n_categ and (p.prob_pick_col_by_range or p.prob_pick_full_gain):
            raise ValueError("column choice by range and full gain need numeric columns only")
        if p.ndim > n_numeric + n_categ:
            warnings.warn(f"ndim is lowered from {p.ndim} to the number of columns, {n_numeric + n_categ}", stacklevel=2)
            p = replace(p, ndim=max(1, n_numeric + n_categ))
        return p


def iforest(**over) -> ForestParams:
    """Isolation forest of Liu, Ting and Zhou."""
    return ForestParams.of(**dict(ndim=1, sample_size=256, max_depth=8, ntrees=100, missing_action="fail") | over)


def eif(**over) -> ForestParams:
    """Extended isolation forest; standardise the columns beforehand."""
    return ForestParams.of(**dict(ndim=2, sample_size=256, max_depth=8, ntrees=100, missing_action="fail", coefs="uniform", standardize_data=False) | over)


def sciforest(**over) -> ForestParams:
    return ForestParams.of(**dict(ndim=2, sample_size=256, max_depth=8, ntrees=100, missing_action="fail", coefs="normal", ntry=10, prob_pick_avg_gain=1.0, penalize_range=True) | over)


def fcf(**over) -> ForestParams:
    """Fair-cut forest."""
    return ForestParams.of(**dict(ndim=2, sample_size=256, max_depth=None, ntrees=200, missing_action="fail", coefs="normal", ntry=1, prob_pick_pooled_gain=1.0) | over)


def rrcf(**over) -> ForestParams:
    """Columns drawn by range as in robust random cut forests, scored by depth."""
    return ForestParams.of(**dict(ndim=1, sample_size=256, max_depth=None, ntrees=100, missing_action="fail", prob_pick_col_by_range=1.0) | over)
