"""Growing one tree over a sample held in numpy arrays.

Numeric columns are 0 .. p-1 with NaN for missing, categorical ones follow with codes and -1 for missing. Nodes are numbered in
pre-order, so a left child is its parent's number plus one; a leaf has left = 0. The result is a list of plain rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from copse.functions import criteria
from copse.functions.special import expected_depth, expected_separation
from copse.plans.params import ForestParams

TINY, EPS = np.finfo(float).tiny, np.finfo(float).eps

NODE_SCHEMA = (
    "tree int, node int, parent int, left int, right int, depth int, kind string, col int, split double, cat_left array<int>, cat_right array<int>, "
    "pct_left double, score double, n double, lo double, hi double, remainder double, "
    "terms array<struct<col: int, coef: double, mean: double, cats: array<double>, fill: double, fill_new: double>>, "
    "imp array<struct<col: int, level: int, value: double, weight: double>>"
)


class MissingValues(ValueError):
    pass


@dataclass
class Split:
    kind: str
    col: int = -1
    at: float = 0.0
    left_codes: list[int] = field(default_factory=list)
    right_codes: list[int] = field(default_factory=list)
    terms: list[dict] = field(default_factory=list)
    gain: float = 0.0
    z: np.ndarray | None = None  # value per row for num and hplane, NaN for missing
    low: float = 0.0  # ends of z
    high: float = 0.0
    missing: np.ndarray | None = None  # where z is NaN, if anywhere


@dataclass
class Sample:
    num: np.ndarray
    cat: np.ndarray
    n_levels: list[int]
    weight: np.ndarray
    col_weight: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.num.shape[1] + self.cat.shape[1]


class Grower:
    def __init__(self, sample: Sample, p: ForestParams, rng: np.random.Generator, max_depth: int | None):
        self.s, self.p, self.rng = sample, p, rng
        self.max_depth = max_depth
        self.n_num = sample.num.shape[1]
        self.total = float(sample.weight.sum())
        cols = np.arange(sample.width)
        if p.ncols_per_tree and p.ncols_per_tree != sample.width:
            m = p.ncols_per_tree
            m = math.ceil(m * len(cols)) if isinstance(m, float) and m <= 1 else int(m)
            cols = np.sort(rng.choice(cols, min(len(cols), max(1, m)), replace=False))
        self.cols = cols
        self.col_weight = np.ones(sample.width) if sample.col_weight is None else sample.col_weight.astype(float)
        if p.weigh_by_kurtosis:
            self.col_weight = self.col_weight * np.array([max(1e-8, self._kurtosis(c, np.arange(len(sample.weight)), sample.weight) - 1) for c in range(sample.width)])
        with np.errstate(all="ignore"):
            self.low = np.array([_finite(sample.num[:, c]).min(initial=np.inf) for c in range(self.n_num)])
            self.high = np.array([_finite(sample.num[:, c]).max(initial=-np.inf) for c in range(self.n_num)])
        self.has_odd = not np.isfinite(sample.num).all()
        whole = sample.num
        if np.isinf(whole).any():
            whole = np.where(np.isinf(whole), np.sign(whole) * np.finfo(float).max / 4, whole)
        self.columns = [np.ascontiguousarray(c) for c in whole.T]
        self.has_nan = [bool(np.isnan(c).any()) for c in self.columns]
        self.has_gap = [bool((c < 0).any()) for c in sample.cat.T]
        self.guided = p.prob_pick_avg_gain + p.prob_pick_pooled_gain + p.prob_pick_full_gain + p.prob_pick_dens > 0
        self.by_spread = p.prob_pick_col_by_range + p.prob_pick_col_by_var + p.prob_pick_col_by_kurt > 0
        self.even = not self.by_spread and bool((self.col_weight == 1).all())
        self.levels0 = [max(1, len(np.unique(c[c >= 0]))) for c in sample.cat.T]

    # -- columns ---------------------------------------------------------------------------------------------------------------

    def _counts(self, c: int, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        codes = self.s.cat[rows, c - self.n_num]
        ok = codes >= 0
        return np.bincount(codes[ok], w[ok], self.s.n_levels[c - self.n_num])

    def _kurtosis(self, c: int, rows: np.ndarray, w: np.ndarray) -> float:
        if c < self.n_num:
            return criteria.kurtosis(self.s.num[rows, c], w)
        return criteria.categorical_kurtosis(self._counts(c, rows, w), self.p.categ_split_type, self.rng)

    def _splittable(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        nums = cols[cols < self.n_num]
        out = []
        if len(nums):
            x = self.s.num.take(rows, axis=0)
            x = x if len(nums) == self.n_num else x[:, nums]
            if self.has_odd:
                x = np.where(np.isfinite(x), x, np.nan)
                out = nums[np.fmin.reduce(x, axis=0) < np.fmax.reduce(x, axis=0)].tolist()
            else:
                out = nums[x.min(axis=0) < x.max(axis=0)].tolist()
        for c in cols[cols >= self.n_num]:
            v = self.s.cat[rows, c - self.n_num]
            if self.has_gap[c - self.n_num]:
                v = v[v >= 0]
            if len(v) and v.min() < v.max():
                out.append(c)
        return np.array(out, int)

    def _chances(self, cols: np.ndarray, rows: np.ndarray, w: np.ndarray) -> np.ndarray | None:
        """Probabilities of the columns: their weights, times range, variance or kurtosis if the draw says so. Infinite ones share all.

        None if all are alike.
        """
        if self.even:
            return None
        u, p, base = self.rng.random(), self.p, self.col_weight[cols].copy()
        if u < p.prob_pick_col_by_range:
            base *= [np.ptp(_finite(self.s.num[rows, c])) for c in cols]
        elif u < p.prob_pick_col_by_range + p.prob_pick_col_by_var:
            base *= [np.var(_finite(self.s.num[rows, c])) if c < self.n_num else criteria.expected_sd(self._counts(c, rows, w)) ** 2 for c in cols]
        elif u < p.prob_pick_col_by_range + p.prob_pick_col_by_var + p.prob_pick_col_by_kurt:
            base *= [max(1e-8, self._kurtosis(c, rows, w) - 1) for c in cols]
        if np.isinf(base).any():
            base = np.isinf(base).astype(float)
        total = base.sum()
        return base / total if total > 0 else np.full(len(cols), 1 / len(cols))

    def _draw(self, cols: np.ndarray, most: int, chances: np.ndarray | None) -> np.ndarray:
        """At most `most` different columns with a chance, drawn one after another."""
        if chances is None:
            return cols[[self.rng.integers(len(cols))]] if most == 1 else cols[self.rng.permutation(len(cols))[:most]]
        if most == 1:
            upto = np.cumsum(chances)
            return cols[[min(int(np.searchsorted(upto, self.rng.random() * upto[-1], side="right")), int(np.flatnonzero(chances)[-1]))]]
        return self.rng.choice(cols, min(most, int((chances > 0).sum())), replace=False, p=chances)

    def _criterion(self) -> str:
        if not self.guided:
            return "random"
        u, p = self.rng.random(), self.p
        for name, share in (("avg", p.prob_pick_avg_gain), ("pooled", p.prob_pick_pooled_gain), ("full", p.prob_pick_full_gain), ("dens", p.prob_pick_dens)):
            if u < share:
                return name
            u -= share
        return "random"

    # -- splits ----------------------------------------------------------------------------------------------------------------

    def _single(self, rows: np.ndarray, w: np.ndarray, cols: np.ndarray) -> Split | None:
        kind = self._criterion()
        chances = self._chances(cols, rows, w)
        best = None
        for c in self._draw(cols, 1 if kind == "random" else self.p.ntry, chances):
            found = self._numeric(c, rows, w, kind) if c < self.n_num else self._categorical(c, rows, w, kind)
            if found and (best is None or found.gain > best.gain):
                best = found
        if best is None or kind != "random" and best.gain <= self.p.min_gain:
            return None
        return best

    def _threshold(self, low: float, high: float) -> float:
        at = low + (high - low) * self.rng.random()
        return float(at if at < high else np.nextafter(high, -np.inf))

    def _numeric(self, c: int, rows: np.ndarray, w: np.ndarray, kind: str) -> Split | None:
        z, missing = self.columns[c].take(rows), None
        seen, mine = z, w
        if self.has_nan[c]:
            missing = np.isnan(z)
            if missing.any():
                seen, mine = z[~missing], w[~missing]
            else:
                missing = None
        low, high = float(seen.min()), float(seen.max())
        if kind == "random":
            return Split("num", int(c), self._threshold(low, high), gain=1.0, z=z, low=low, high=high, missing=missing)
        if len(rows) == 2:
            return Split("num", int(c), float(criteria.midpoint(low, high)), gain=1.0, z=z, low=low, high=high, missing=missing)
        others = self.s.num[rows][:, [k for k in self.cols if k < self.n_num]] if kind == "full" else None
        if others is not None and missing is not None:
            others = others[~missing]
        found = criteria.best_numeric(seen, mine, kind, others)
        return found and Split("num", int(c), found[1], gain=found[0], z=z, low=low, high=high, missing=missing)

    def _categorical(self, c: int, rows: np.ndarray, w: np.ndarray, kind: str) -> Split | None:
        counts = self._counts(c, rows, w)
        present = np.flatnonzero(counts)
        if len(present) < 2:
            return None
        if self.p.categ_split_type == "single_categ":
            gain, chosen = criteria.best_single(counts, kind) if kind != "random" else (1.0, int(self.rng.choice(present)))
            return Split("single", int(c), left_codes=[int(chosen)], right_codes=[int(x) for x in present if x != chosen], gain=gain)
        if kind == "random":
            left = self.rng.random(len(present)) < 0.5
            if left.all() or not left.any():
                left[self.rng.integers(len(present))] ^= True
            return Split("subset", int(c), left_codes=present[left].tolist(), right_codes=present[~left].tolist(), gain=1.0)
        gain, mask = criteria.best_subset(counts, kind, self.p.all_perm)
        return Split("subset", int(c), left_codes=np.flatnonzero(mask).tolist(), right_codes=[int(x) for x in present if not mask[x]], gain=gain)

    def _plane(self, rows: np.ndarray, w: np.ndarray, cols: np.ndarray) -> Split | None:
        kind, best, known = self._criterion(), None, {}
        for _ in range(self.p.ntry if kind != "random" else 1):
            picked = self._draw(cols, self.p.ndim, self._chances(cols, rows, w))
            z, terms = np.zeros(len(rows)), []
            for c in picked:
                part, term = self._term(int(c), rows, w, known)
                z += part
                terms.append(term)
            low, high = float(z.min()), float(z.max())
            if not low < high:
                continue
            if kind == "random":
                return Split("hplane", at=self._threshold(low, high), terms=terms, gain=1.0, z=z, low=low, high=high)
            others = self.s.num[rows][:, [c for c in picked if c < self.n_num]] if kind == "full" else None
            found = criteria.best_numeric(z, w, "pooled" if kind == "full" and others.shape[1] == 0 else kind, others)
            if found and (best is None or found[0] > best.gain):
                best = Split("hplane", at=found[1], terms=terms, gain=found[0], z=z, low=low, high=high)
        return best if best and best.gain > self.p.min_gain else None

    def _coef(self, size=None):
        return self.rng.normal(size=size) if self.p.coefs == "normal" else self.rng.uniform(-1, 1, size)

    def _term(self, c: int, rows: np.ndarray, w: np.ndarray, known: dict) -> tuple[np.ndarray, dict]:
        """A column's part of a hyperplane: centred, divided by its deviation, times a random coefficient; missing gets the median's part.

        known holds what was computed of the node's columns, for further candidates.
        """
        p = self.p
        if c < self.n_num:
            if c not in known:
                known[c] = self._centred(c, rows, w)
            d, ok, mean, sd, middle = known[c]
            coef = float(self._coef()) / (sd if p.standardize_data and sd > 0 else 1.0)
            fill = coef * middle
            part = coef * d
            return part if ok is None else np.where(ok, part, fill), {"col": c, "coef": coef, "mean": mean, "cats": None, "fill": fill, "fill_new": fill}
        counts = self._counts(c, rows, w)
        present = np.flatnonzero(counts)
        cats = np.full(len(counts), np.nan)
        if p.categ_split_type == "single_categ":
            cats[:] = 0.0
            cats[self.rng.choice(present)] = float(self._coef())
        else:
            drawn = self._coef(len(present))
            if p.coef_by_prop:  # larger coefficients for more frequent levels
                ranks = np.argsort(np.argsort(counts[present], kind="stable"), kind="stable")
                drawn = np.sort(drawn)[ranks]
            cats[present] = drawn
        mean_part = float(np.average(cats[present], weights=counts[present]))
        new = {"impute": mean_part, "weighted": mean_part, "smallest": float(cats[present[np.argmin(counts[present])]]), "random": float(self._coef())}[p.new_categ_action]
        codes = self.s.cat[rows, c - self.n_num]
        part = np.where(codes >= 0, np.nan_to_num(cats[np.maximum(codes, 0)], nan=new), mean_part)
        return part, {"col": c, "coef": 0.0, "mean": 0.0, "cats": [None if math.isnan(v) else float(v) for v in cats], "fill": mean_part, "fill_new": new}

    def _centred(self, c: int, rows: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, float, float, float]:
        """Of a node's numeric column: values less their mean (0 where missing), where it is finite if not everywhere, mean, deviation, median less mean."""
        x, ok = self.s.num[:, c].take(rows), None
        seen, mine = x, w
        if self.has_odd:
            ok = np.isfinite(x)
            if ok.all():
                ok = None
            else:
                seen, mine = x[ok], w[ok]
        total = float(mine.sum())
        mean = float(mine @ seen) / total
        d = seen - mean
        sd = math.sqrt(float(mine @ (d * d)) / total)
        half = len(seen) // 2
        ends = (half,) if len(seen) % 2 else (half - 1, half)
        middle = float(np.partition(d, ends)[list(ends)].mean())
        if ok is not None:
            whole = np.zeros(len(x))
            whole[ok] = d
            d = whole
        return d, ok, mean, sd, middle

    # -- tree ------------------------------------------------------------------------------------------------------------------

    def grow(self, tree: int, first_depth: int = 0, state: dict | None = None, lists: bool = True) -> list[dict]:
        """first_depth and state: of the node at which the sample stands, if it is not the root.

        lists: whether leaves hold the imputer's values as rows; imputed has them in either case (see imp_arrays).
        """
        nodes: list[dict] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows and weights by node, for the imputer
        start = state or {"adj": 0.0 if self.p.scoring_metric == "adj_depth" else 1.0, "dens": 0.0, "box": 0.0, "low": self.low, "high": self.high, "levels": list(self.levels0)}
        stack = [(np.arange(len(self.s.weight)), self.s.weight.astype(float), first_depth, -1, False, start)]
        while stack:
            rows, w, depth, parent, is_right, state = stack.pop()
            me = len(nodes)
            if is_right:
                nodes[parent]["right"] = me
            elif parent >= 0:
                nodes[parent]["left"] = me
            n = float(w.sum())
            node = {
                "tree": tree, "node": me, "parent": parent, "left": 0, "right": 0, "depth": depth, "kind": "leaf", "col": -1, "split": None, "cat_left": None, "cat_right": None,
                "pct_left": None, "score": None, "n": n, "lo": None, "hi": None, "remainder": 0.0, "terms": None, "imp": None,
            }
            nodes.append(node)
            if self.p.build_imputer:
                held.append((rows, w))
            split = None
            if len(rows) > 2 and n > 1 and (self.max_depth is None or depth < self.max_depth):
                cols = self._splittable(rows, self.cols)
                cols = cols[self.col_weight[cols] > 0] if len(cols) else cols
                if len(cols):
                    split = self._plane(rows, w, cols) if self.p.ndim > 1 else self._single(rows, w, cols)
            if split is None:
                self._close(node, n, depth, state)
                continue
            left, right, wl, wr = self._part(split, rows, w, node)
            if not len(left) or not len(right):
                self._close(node, n, depth, state)
                continue
            node |= {"kind": split.kind, "col": split.col}
            if split.kind in ("num", "hplane"):
                span = split.high - split.low
                node |= {"split": split.at, "lo": split.at - span, "hi": split.at + span}
            else:
                node |= {"cat_left": split.left_codes, "cat_right": split.right_codes}
            if split.kind == "hplane":
                node["terms"] = split.terms
            a, b = self._states(split, node["pct_left"], state)
            stack.append((right, wr, depth + 1, me, True, b))
            stack.append((left, wl, depth + 1, me, False, a))
        if self.p.build_imputer:
            leaves = np.flatnonzero([x["kind"] == "leaf" for x in nodes])
            node = np.repeat(np.arange(len(held)), [len(rows) for rows, _ in held])
            self.imputed = self._imputer(*(np.array([x[k] for x in nodes]) for k in ("parent", "depth")), leaves, node, *(np.concatenate([x[i] for x in held]) for i in (0, 1)))
            if lists:
                for node, found in zip([x for x in nodes if x["kind"] == "leaf"], imp_lists(*imp_arrays(self.imputed), self.s.n_levels), strict=True):
                    node["imp"] = found
        return nodes

    def _part(self, split: Split, rows: np.ndarray, w: np.ndarray, node: dict):
        if split.kind in ("num", "hplane"):
            missing = split.missing
            goes = split.z <= split.at  # no for missing ones
        else:
            codes, k = self.s.cat[rows, split.col - self.n_num], split.col - self.n_num
            missing = codes < 0 if self.has_gap[k] else None
            side = np.zeros(self.s.n_levels[k], bool)
            side[split.left_codes] = True
            goes = side[codes] if missing is None else side[np.maximum(codes, 0)] & ~missing
            if missing is not None and not missing.any():
                missing = None
        known = node["n"] if missing is None else float(w[~missing].sum())
        wl = float(w[goes].sum())
        pct = wl / known if known > 0 else 0.5
        node["pct_left"] = pct
        if missing is not None:
            if self.p.missing_action == "fail":
                raise MissingValues("the data have missing values and missing_action is 'fail'")
            if self.p.missing_action == "divide":
                left, right = goes | missing, ~goes
                return rows[left], rows[right], np.where(missing[left], w[left] * pct, w[left]), np.where(missing[right], w[right] * (1 - pct), w[right])
            goes = np.where(missing, pct >= 0.5, goes)
        rest = ~goes
        return rows[goes], rows[rest], w[goes], w[rest]

    def _states(self, split: Split, pct: float, state: dict) -> tuple[dict, dict]:
        """Density bookkeeping of both children; a box is copied on descent."""
        if self.p.scoring_metric == "depth":
            return state, state
        a, b = dict(state), dict(state)
        if split.kind in ("num", "hplane"):
            span = max(split.high - split.low, TINY)
            fl = min(max((split.at - split.low) / span, EPS), 1 - EPS)
        else:
            fl = len(split.left_codes) / (len(split.left_codes) + len(split.right_codes))
        for out, frac, share in ((a, fl, pct), (b, 1 - fl, 1 - pct)):
            out["dens"] = state["dens"] + math.log(frac)
            ratio = max(share, EPS) / frac
            factor = 2 / (1 + 0.5 / ratio)
            out["adj"] = state["adj"] + factor if self.p.scoring_metric == "adj_depth" else max(state["adj"] * factor, EPS)
        if split.kind == "num":
            c = split.col
            wide = max(state["high"][c] - state["low"][c], TINY)
            for out, side in ((a, "high"), (b, "low")):
                edge = state[side].copy()
                edge[c] = min(edge[c], split.at) if side == "high" else max(edge[c], split.at)
                out[side] = edge
                out["box"] = state["box"] + math.log(max(out["high"][c] - out["low"][c], TINY)) - math.log(wide)
        elif split.kind == "hplane":
            low = high = 0.0
            for t in split.terms:
                if t["cats"] is None:
                    ends = [t["coef"] * (v - t["mean"]) for v in (self.low[t["col"]], self.high[t["col"]])]
                else:
                    ends = [v for v in t["cats"] if v is not None]
                low, high = low + min(ends), high + max(ends)
            frac = min(max((split.at - low) / max(high - low, TINY), EPS), 1 - EPS)
            a["box"], b["box"] = state["box"] + math.log(frac), state["box"] + math.log(1 - frac)
        else:
            k = split.col - self.n_num
            for out, mine in ((a, split.left_codes), (b, split.right_codes)):
                out["levels"] = list(state["levels"])
                out["levels"][k] = max(1, len(mine))
                out["box"] = state["box"] + math.log(out["levels"][k]) - math.log(max(1, state["levels"][k]))
        return a, b

    def _close(self, node: dict, n: float, depth: int, state: dict) -> None:
        metric = self.p.scoring_metric
        share = math.log(max(n, TINY)) - math.log(max(self.total, TINY))
        node["remainder"] = expected_separation(n) if not self.p.assume_full_distr else 0.0
        node["score"] = float({
            "depth": lambda: depth + expected_depth(n),
            "adj_depth": lambda: max(state["adj"], TINY) + expected_depth(n),
            "adj_density": lambda: state["adj"],
            "density": lambda: share - state["dens"],
            "boxed_ratio": lambda: math.exp(state["box"]),
            "boxed_density2": lambda: share - state["box"],
            "boxed_density": lambda: share + state["box"],
        }[metric]())

    # -- imputation ------------------------------------------------------------------------------------------------------------

    def _sums(self, n: int, node: np.ndarray, rows: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per column, over n nodes: observations, weight of the values present, and their mean or the levels' shares as columns."""
        for c in range(self.s.width):
            if c < self.n_num:
                x = self.s.num[:, c].take(rows)
                ok = np.isfinite(x)
                codes, mine = np.zeros(int(ok.sum()), np.int64), x[ok] * w[ok]
            else:
                codes = self.s.cat[:, c - self.n_num].take(rows)
                ok = codes >= 0
                codes, mine = codes[ok], w[ok]
            at, wide = node[ok], 1 if c < self.n_num else self.s.n_levels[c - self.n_num]
            total = np.bincount(at, w[ok], n)
            sums = np.bincount(at * wide + codes, mine, n * wide).reshape(n, wide)
            yield np.bincount(at, minlength=n), total, np.divide(sums, total[:, None], out=np.zeros_like(sums), where=total[:, None] > 0)

    def _imputer(self, parent: np.ndarray, depth: np.ndarray, leaves: np.ndarray, node: np.ndarray, rows: np.ndarray, w: np.ndarray) -> tuple:
        """What leaves in order impute, for imp_arrays: by column, the node it comes from and how far that is up; those nodes' values.

        node, rows, w: the rows of every node, inner ones too, with their weights.
        A column with too few observations takes its nearest ancestor's values, at w / (2 * levels climbed).
        """
        values, totals, sources = [], [], []
        for c, (obs, total, found) in enumerate(self._sums(len(parent), node, rows, w)):
            enough = obs >= self.p.min_imp_obs if c < self.n_num else (obs >= self.p.min_imp_obs) & (total > 0)
            at = leaves.copy()
            while len(up := np.flatnonzero(~enough[at] & (parent[at] >= 0))):
                at[up] = parent[at[up]]
            unused = np.ones(len(parent), bool)
            unused[at] = False
            found[unused] = 0.0
            total = np.where(unused, totals[0] if totals else 0.0, total)  # as the first column's, which takes no room
            values.append(found)
            totals.append(total)
            sources.append(at)
        some, place = np.unique(sources, return_inverse=True)
        place = place.reshape(len(sources), -1).astype(np.int32)
        climbed = np.array([depth[leaves] - depth[at] for at in sources], np.int8)
        bits = np.array([t[some] for t in totals]).view(np.int64)
        bits[1:] ^= bits[0]
        place[1:] -= place[0]
        climbed[1:] -= climbed[0]
        columns = tuple(tuple(np.ascontiguousarray(x) for x in v[some].T) for v in values)
        return depth[leaves].astype(np.int32), place, climbed, bits, columns, (self.p.weigh_imp_rows, self.p.depth_imp)


def imp_arrays(imputed: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Over leaves in order: means and shares of levels, and weights by column (0: no value)."""
    depth, place, climbed, bits, columns, (weigh, deep) = imputed
    place, climbed, bits = place.copy(), climbed.copy(), bits.copy()
    place[1:] += place[0]
    climbed[1:] += climbed[0]
    bits[1:] ^= bits[0]
    values, weights = [], []
    for at, up, total, found in zip(place, climbed, bits.view(np.float64), columns, strict=True):
        have = total[at]
        with np.errstate(all="ignore"):
            weight = np.where(up > 0, have / (2.0 * np.maximum(up, 1)), have)
            weight = {"prop": weight, "flat": weight / have, "inverse": weight / (have * np.sqrt(have))}[weigh]
        weight = weight * {"higher": depth + 1, "lower": 1 / (depth + 1), "same": 1}[deep]
        values += [x[at] for x in found]
        weights.append(np.where(have > 0, weight, 0.0))
    return np.column_stack(values), np.column_stack(weights)


def imp_lists(values: np.ndarray, weights: np.ndarray, n_levels: list[int]) -> list[list[dict]]:
    """The imputer's arrays as the rows of the node table: one for a number's mean (level -1), one for each level present."""
    n_num = weights.shape[1] - len(n_levels)
    places = [(c, -1) for c in range(n_num)] + [(n_num + k, v) for k, wide in enumerate(n_levels) for v in range(wide)]
    return [
        [{"col": c, "level": level, "value": x, "weight": w[c]} for (c, level), x in zip(places, v, strict=True) if w[c] > 0 and (level < 0 or x > 0)]
        for v, w in zip(values.tolist(), weights.tolist(), strict=True)
    ]


def _finite(x: np.ndarray) -> np.ndarray:
    return x[np.isfinite(x)]
