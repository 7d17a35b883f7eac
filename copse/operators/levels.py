"""Growing a tree level by level: the nodes of a level are split by a few operations over all of its rows, which lie node by node.

For splits by chance in single columns, scored by depth. The nodes are those that Grower.grow would make from other random numbers.
"""

from __future__ import annotations

import numpy as np

from copse.functions.special import expected_depth, expected_separation
from copse.operators.grow import Grower, MissingValues, imp_arrays, imp_lists

#: Levels of a categorical column up to which a level's nodes are counted in one array.
MOST_LEVELS = 64


def can_level(g: Grower) -> bool:
    return g.p.ndim == 1 and not g.guided and g.even and g.p.scoring_metric == "depth" and max(g.s.n_levels, default=0) <= MOST_LEVELS


def grow_levels(g: Grower, tree: int, lists: bool = True) -> dict[str, np.ndarray]:
    """Columns of the node table, as of Grower.grow's nodes; g.imputed as there."""
    rows, w, sizes, depth = np.arange(len(g.s.weight)), g.s.weight.astype(float), np.array([len(g.s.weight)]), 0
    levels, held = [], []
    while len(sizes):
        starts = np.cumsum(sizes) - sizes
        n = np.add.reduceat(w, starts)
        level = {"n": n, "kind": np.full(len(n), "leaf", object), "col": np.full(len(n), -1)} | {k: np.full(len(n), np.nan) for k in ("split", "lo", "hi", "pct_left")}
        level |= {k: np.full(len(n), None, object) for k in ("cat_left", "cat_right")}
        levels.append(level)
        if g.p.build_imputer:
            held.append((sizes, rows, w))
        ready = (sizes > 2) & (n > 1) if g.max_depth is None or depth < g.max_depth else np.zeros(len(n), bool)
        rows, w, sizes = _split(g, level, rows, w, sizes, starts, ready)
        depth += 1
    return _table(g, tree, levels, held, lists)


def _ends(g: Grower, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node and column: whether it can be split; least and greatest values of the numeric columns."""
    can, low, high = np.zeros((len(starts), g.s.width), bool), np.empty((len(starts), g.n_num)), np.empty((len(starts), g.n_num))
    for c in g.cols:
        if c < g.n_num:
            x = g.columns[c].take(rows)
            low[:, c], high[:, c] = np.fmin.reduceat(x, starts), np.fmax.reduceat(x, starts)
            can[:, c] = low[:, c] < high[:, c]
            if g.has_odd:  # only finite values count for whether there is something to split
                x = g.s.num[:, c].take(rows)
                x = np.where(np.isfinite(x), x, np.nan)
                can[:, c] = np.fmin.reduceat(x, starts) < np.fmax.reduceat(x, starts)
        else:
            v = g.s.cat[:, c - g.n_num].take(rows)
            least = np.where(v < 0, np.iinfo(v.dtype).max, v) if g.has_gap[c - g.n_num] else v
            can[:, c] = np.minimum.reduceat(least, starts) < np.maximum.reduceat(v, starts)
    return can, low, high


def _split(g: Grower, level: dict, rows: np.ndarray, w: np.ndarray, sizes: np.ndarray, starts: np.ndarray, ready: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splits a level's nodes, notes it in level, and returns the children's rows, weights and sizes, a left child before its right one."""
    none, rng, p, n_num = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), g.rng, g.p, g.n_num
    mine = np.flatnonzero(ready)
    if not len(mine):
        return none
    keep = np.flatnonzero(np.repeat(ready, sizes))
    rows, w, sizes = rows.take(keep), w.take(keep), sizes[mine]
    starts = np.cumsum(sizes) - sizes
    can, low, high = _ends(g, rows, starts)
    count = can.sum(axis=1)
    nth = np.minimum((rng.random(len(mine)) * count).astype(np.int64), count - 1)
    col = np.where(count > 0, (np.cumsum(can, axis=1) > nth[:, None]).argmax(axis=1), -1)
    chance, node = rng.random(len(mine)), np.repeat(np.arange(len(mine)), sizes)
    at, goes, missing, ok = np.full(len(mine), np.nan), np.zeros(len(rows), bool), np.zeros(len(rows), bool), count > 0
    sides, here = {}, col.take(node)
    for c in range(g.s.width):
        k, i = np.flatnonzero(col == c), np.flatnonzero(here == c)
        if not len(k):
            continue
        if c < n_num:
            cut = low[k, c] + (high[k, c] - low[k, c]) * chance[k]
            at[k] = np.where(cut < high[k, c], cut, np.nextafter(high[k, c], -np.inf))
            x = g.columns[c].take(rows.take(i))
            goes[i] = x <= at.take(node.take(i))
            if g.has_nan[c]:
                missing[i] = np.isnan(x)
            continue
        place = np.zeros(len(mine), np.int64)
        place[k] = np.arange(len(k))
        codes, wide, own = g.s.cat[:, c - n_num].take(rows.take(i)), g.s.n_levels[c - n_num], place.take(node.take(i))
        known = np.flatnonzero(codes >= 0)
        present = np.bincount(own.take(known) * wide + codes.take(known), w.take(i.take(known)), len(k) * wide).reshape(len(k), wide) > 0
        sides[c] = k, present, _sides(g, present)
        ok[k] &= present.sum(axis=1) > 1
        goes[i] = sides[c][2][own, np.maximum(codes, 0)] & (codes >= 0)
        missing[i] = codes < 0
    gaps = missing.any()
    if gaps and p.missing_action == "fail":
        raise MissingValues("the data have missing values and missing_action is 'fail'")
    total = np.add.reduceat(np.where(missing, 0.0, w) if gaps else w, starts)
    pct = np.divide(np.add.reduceat(np.where(goes, w, 0.0), starts), total, out=np.full(len(mine), 0.5), where=total > 0)
    if gaps and p.missing_action == "impute":
        goes = np.where(missing, pct.take(node) >= 0.5, goes)
        missing[:] = False
    left, right = goes | missing, ~goes
    both = np.add.reduceat(left.astype(np.int64), starts), np.add.reduceat(right.astype(np.int64), starts)
    ok &= (both[0] > 0) & (both[1] > 0)
    done = np.flatnonzero(ok)
    if not len(done):
        return none
    _note(g, level, mine, col, at, pct, low, high, ok, sides)
    child = np.full(len(mine), -1)
    child[done] = 2 * np.arange(len(done))
    a, b = (np.flatnonzero(side & ok.take(node)) for side in (left, right))
    wa, wb = w.take(a), w.take(b)
    if gaps and p.missing_action == "divide":
        wa, wb = np.where(missing[a], wa * pct.take(node.take(a)), wa), np.where(missing[b], wb * (1 - pct.take(node.take(b))), wb)
    order = np.argsort(np.concatenate([child.take(node.take(a)), child.take(node.take(b)) + 1]), kind="stable")
    return rows.take(np.concatenate([a, b]).take(order)), np.concatenate([wa, wb]).take(order), np.column_stack([both[0][done], both[1][done]]).ravel()


def _sides(g: Grower, present: np.ndarray) -> np.ndarray:
    """By node and level present: whether it goes left."""
    count = present.sum(axis=1)
    one = np.minimum((g.rng.random(len(present)) * count).astype(np.int64), count - 1)
    chosen = present & (np.cumsum(present, axis=1) == one[:, None] + 1)
    if g.p.categ_split_type == "single_categ":
        return chosen
    left = present & (g.rng.random(present.shape) < 0.5)
    alike = (left.sum(axis=1) == 0) | (left.sum(axis=1) == count)
    return np.where(alike[:, None], left ^ chosen, left)


def _note(g: Grower, level: dict, mine: np.ndarray, col: np.ndarray, at: np.ndarray, pct: np.ndarray, low: np.ndarray, high: np.ndarray, ok: np.ndarray, sides: dict) -> None:
    k = np.flatnonzero(ok)
    level["col"][mine[k]], level["pct_left"][mine[k]] = col[k], pct[k]
    k = np.flatnonzero(ok & (col < g.n_num))
    span = high[k, col[k]] - low[k, col[k]]
    level["kind"][mine[k]], level["split"][mine[k]] = "num", at[k]
    level["lo"][mine[k]], level["hi"][mine[k]] = at[k] - span, at[k] + span
    for nodes, present, left in sides.values():
        for j in np.flatnonzero(ok[nodes]):
            i = mine[nodes[j]]
            level["kind"][i] = "single" if g.p.categ_split_type == "single_categ" else "subset"
            level["cat_left"][i], level["cat_right"][i] = np.flatnonzero(left[j]).tolist(), np.flatnonzero(present[j] & ~left[j]).tolist()


def _table(g: Grower, tree: int, levels: list[dict], held: list[tuple], lists: bool) -> dict[str, np.ndarray]:
    """The levels' nodes in pre-order."""
    inner = [np.flatnonzero(x["kind"] != "leaf") for x in levels]
    below = [np.ones(len(x["n"]), np.int64) for x in levels]  # nodes of the subtree
    for d in range(len(levels) - 2, -1, -1):
        below[d][inner[d]] += below[d + 1].reshape(-1, 2).sum(axis=1)
    number, parent = [np.zeros(1, np.int64)], [np.full(1, -1)]
    left, right = ([np.zeros(len(x["n"]), np.int64) for x in levels] for _ in range(2))
    for d in range(len(levels) - 1):
        up = number[d][inner[d]]
        left[d][inner[d]], right[d][inner[d]] = up + 1, up + 1 + below[d + 1][::2]
        number.append(np.column_stack([left[d][inner[d]], right[d][inner[d]]]).ravel())
        parent.append(np.repeat(up, 2))
    order = np.argsort(np.concatenate(number))
    out = {k: np.concatenate([x[k] for x in levels]).take(order) for k in levels[0]}
    out |= {k: np.concatenate(v).take(order) for k, v in (("parent", parent), ("left", left), ("right", right))}
    size = len(order)
    depth = np.repeat(np.arange(len(levels)), [len(x["n"]) for x in levels]).take(order)
    out |= {"tree": np.full(size, tree), "node": np.arange(size), "depth": depth, "score": np.full(size, np.nan), "remainder": np.zeros(size)}
    leaves = np.flatnonzero(out["kind"] == "leaf")
    out["score"][leaves] = depth[leaves] + np.array([expected_depth(n) for n in out["n"][leaves].tolist()])
    if not g.p.assume_full_distr:
        out["remainder"][leaves] = [expected_separation(n) for n in out["n"][leaves].tolist()]
    out |= {k: np.full(size, None, object) for k in ("terms", "imp")}
    if g.p.build_imputer:
        node = np.concatenate([np.repeat(i, sizes) for i, (sizes, _, _) in zip(number, held, strict=True)])
        g.imputed = g._imputer(out["parent"], depth, leaves, node, *(np.concatenate([x[i] for x in held]) for i in (1, 2)))
        if lists:
            for i, found in zip(leaves, imp_lists(*imp_arrays(g.imputed), g.s.n_levels), strict=True):
                out["imp"][i] = found
    return out
