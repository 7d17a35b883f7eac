"""Rows through trees: level by level over node arrays in numpy. Missing values may part a row over several leaves with weights.

Trees are arrays from the start: they are read once from the node table, and sent as they are.
Rows without missing values go through trees without categorical splits on a short way that holds one node per row. Other rows go
down trees of single columns level by level, a block at a time (`_descend`); in trees of hyperplanes they are parted node by node
while many are together, and then level by level (`walk`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

LEAF, NUM, CAT, PLANE = 0, 1, 2, 3
_KINDS = {"leaf": LEAF, "num": NUM, "single": CAT, "subset": CAT, "hplane": PLANE}
#: Rows that the short way carries at once, so that its arrays stay in a core's cache.
BLOCK = 8192
#: Rows that go down a tree of single columns together; the arrays of their ends stay in a core's cache too.
STRIDE = 16384
#: Fewer rows than this at a node are not parted by themselves, but with those of other nodes.
FEW = 256


@dataclass
class Rules:
    """What the traversal needs to know besides the nodes."""

    n_num: int
    n_levels: list[int]
    missing_action: str
    new_categ_action: str
    penalize_range: bool


class Tree:
    """One tree as arrays over its nodes, in order."""

    def __init__(self, columns: dict[str, np.ndarray], rules: Rules):
        """columns: the node table's columns of one tree, ordered by node; kind as numbers."""
        self.rules = rules
        self.imp = None  # of a tree with an imputer, over leaves: means and shares of levels, and weights by column
        self.kind, kinds = columns["kind"], columns["name"]
        self.left, self.right, self.col, self.depth = (columns[c].astype(np.int32) for c in ("left", "right", "col", "depth"))
        self.split, self.pct, self.score, self.lo, self.hi = (columns[c] for c in ("split", "pct_left", "score", "lo", "hi"))
        self._number()
        cats = np.flatnonzero(self.kind == CAT)
        wide = max(rules.n_levels, default=1)
        self.cat_side = np.full((max(1, len(cats)), wide), -1, np.int8)  # 1 left, 0 right, -1 not at this node
        self.cat_single = np.array([kinds[i] == "single" for i in cats] or [False])
        for k, i in enumerate(cats):
            if kinds[i] == "single":
                self.cat_side[k] = 0
            self.cat_side[k, list(columns["cat_right"][i])] = 0
            self.cat_side[k, list(columns["cat_left"][i])] = 1
        planes = np.flatnonzero(self.kind == PLANE)
        deep = max((len(columns["terms"][i]) for i in planes), default=0)
        shape = (max(1, len(planes)), deep)
        self.t_col = np.full(shape, -1, np.int32)
        self.t_coef, self.t_mean, self.t_fill, self.t_new = (np.zeros(shape) for _ in range(4))
        with_levels = any(t["cats"] is not None for i in planes for t in columns["terms"][i])
        self.t_cats = np.full((*shape, wide if with_levels else 1), np.nan)
        for k, i in enumerate(planes):
            for d, t in enumerate(columns["terms"][i]):
                self.t_col[k, d], self.t_coef[k, d], self.t_mean[k, d], self.t_fill[k, d], self.t_new[k, d] = t["col"], t["coef"], t["mean"], t["fill"], t["fill_new"]
                if t["cats"] is not None:
                    c = [np.nan if v is None else v for v in t["cats"]]
                    self.t_cats[k, d, : len(c)] = c
        self.with_levels = with_levels
        self._prepare()

    def _number(self) -> None:
        """Numbers of leaves, splits by level and hyperplanes, each in the order of nodes; -1 at other nodes."""
        for name, kind in (("leaf_number", LEAF), ("cat_at", CAT), ("plane_at", PLANE)):
            mine = self.kind == kind
            setattr(self, name, np.where(mine, np.cumsum(mine) - 1, -1).astype(np.int32))
        self.steps = int(self.depth.max(initial=0))

    def _prepare(self) -> None:
        """What follows from the node arrays and is not sent with them."""
        cats, planes, rules = np.flatnonzero(self.cat_at >= 0), np.flatnonzero(self.plane_at >= 0), self.rules
        #: Whether rows without missing values can take the short way.
        self.short = not len(cats) and not self.with_levels and not rules.penalize_range
        if self.short:
            self._shorten(planes)
        #: Whether single-level splits can be taken as cuts of indicators, so that all rows of known ends go a short way.
        self.marked = not len(planes) and bool(self.cat_single.all() or not len(cats)) and not rules.penalize_range
        #: Whether rows can be walked: missing values and new levels have a place in the terms, and no penalty is kept.
        self.fast = not rules.penalize_range and rules.missing_action != "fail" and not (len(planes) and bool((self.kind == NUM).any()))
        if self.fast:
            self._terms(cats, planes)
        elif self.marked:
            self._mark(cats)

    _DERIVED = ("leaf_number", "cat_at", "plane_at", "steps", "child", "test", "x_col", "x_coef", "x_mean", "leaf", "m_child", "m_test", "m_col", "w_test", "w_child", "w_terms", "w_cats", "w_tables", "w_fill", "w_parts", "d_col", "d_test")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in self._DERIVED}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._number()
        self._prepare()

    def _terms(self, cats: np.ndarray, planes: np.ndarray) -> None:
        """Every split as a sum of terms, of which at most w_test goes left, and NaN both ways by pct. A term is coef * (value - mean),
        fill where that is missing, or a level's entry in a table: after the levels come a new level and a missing one."""
        n, wide, rules = len(self.kind), max(self.rules.n_levels, default=1), self.rules
        larger = np.where(self.pct >= 0.5, 0.0, 1.0)
        me, self.leaf = np.arange(n, dtype=np.int64), self.kind == LEAF
        self.w_child = np.stack([np.where(self.leaf, me, self.right), np.where(self.leaf, me, self.left)], axis=1).ravel().astype(np.int64)
        self.w_test = np.where(self.kind == CAT, 0.5, self.split)
        lost = np.full(n, np.nan) if rules.missing_action == "divide" else np.where(larger == 0, -np.inf, np.inf)
        deep = max(1, self.t_col.shape[1] if len(planes) else 1)
        self.w_terms, self.w_tables, tables, used = [], [], [], 0
        for d in range(deep):
            col, coef, mean, fill = np.where(self.kind >= NUM, self.col, 0).astype(np.int64) if d == 0 else np.zeros(n, np.int64), np.ones(n) if d == 0 else np.zeros(n), np.zeros(n), lost.copy() if d == 0 else np.zeros(n)
            at = np.full(n, -1, np.int64)
            if d == 0 and len(cats):
                side, codes = self.cat_side[self.cat_at[cats]], np.arange(wide)
                k = self.col[cats] - rules.n_num
                new = {
                    "impute": lambda c: np.broadcast_to(larger[cats, None], (len(cats), len(c.T))),
                    "smallest": lambda c: np.broadcast_to(np.where(self.pct[cats] < 0.5, 0.0, 1.0)[:, None], (len(cats), len(c.T))),
                    "random": lambda c: np.where((c + cats[:, None]) % 2 == 1, 0.0, 1.0),
                }.get(rules.new_categ_action, lambda c: np.full((len(cats), len(c.T)), np.nan))
                unseen = np.where(self.cat_single[self.cat_at[cats]][:, None], 1.0, new(np.array(rules.n_levels)[k][:, None]))
                gone = np.full((len(cats), 1), np.nan) if rules.missing_action == "divide" else larger[cats, None]
                tables.append(np.hstack([np.where(side < 0, new(np.broadcast_to(codes, side.shape)), 1.0 - side), unseen, gone]).ravel())
                at[cats] = used + np.arange(len(cats)) * (wide + 2)
                used += len(tables[-1])
            if len(planes):
                k = self.plane_at[planes]
                mine = self.t_col[k, d]
                here = mine >= 0
                col[planes], coef[planes], mean[planes], fill[planes] = np.maximum(mine, 0), np.where(here, self.t_coef[k, d], 0.0), np.where(here, self.t_mean[k, d], 0.0), np.where(here, self.t_fill[k, d], 0.0)
                some = np.flatnonzero(mine >= rules.n_num)
                if len(some):
                    new = self.t_new[k[some], d][:, None]
                    known = self.t_cats[k[some], d]
                    tables.append(np.hstack([np.where(np.isnan(known), new, known), new, self.t_fill[k[some], d][:, None]]).ravel())
                    at[planes[some]] = used + np.arange(len(some)) * (wide + 2)
                    used += len(tables[-1])
            self.w_terms.append((col, coef, mean, fill))
            self.w_tables.append(at if (at >= 0).any() else None)
        self.w_cats = np.concatenate(tables) if tables else np.empty(0)
        self.w_fill = bool(len(planes)) or rules.missing_action != "divide"  # whether missing numbers have a side
        self.w_parts = bool(np.isnan(lost).any()) or bool(np.isnan(self.w_cats).any())
        if not len(planes):  # a leaf takes a column of zeros, and stays
            self.d_col, self.d_test = np.where(self.leaf, -1, self.w_terms[0][0]), np.where(self.leaf, 0.0, self.w_test)

    def pieces(self, rows: "Rows") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Every end of every row, for ranges of rows from the one to the other: places in the range, leaf nodes, and weights as of walk."""
        if hasattr(self, "d_col"):
            yield from self._descend(rows)
        else:
            yield 0, rows.n, *self.walk(rows)

    def _descend(self, rows: "Rows") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """pieces of a tree without hyperplanes. Where a row is parted, its right part stays in place and its left one is put last."""
        grid, tables, fill = rows.grid(), self.w_tables[0], self.w_terms[0][3] if self.w_fill and any(rows.gaps) else None
        flat, wide = grid.ravel(), grid.shape[1]
        col, left = np.where(self.d_col < 0, wide - 1, self.d_col), self.left.astype(np.intp)
        for a in range(0, rows.n, STRIDE):
            m = first = min(STRIDE, rows.n - a)
            lanes = rows.lanes(m)
            lanes.node[:m], lanes.base[:m], lanes.share[:m] = 0, np.arange(a, a + m) * wide, 1.0
            for _ in range(self.steps):
                node, at, x, cut, flags = (v[:m] for v in (lanes.node, lanes.at, lanes.x, lanes.cut, lanes.flags))
                col.take(node, out=at, mode="clip")
                at += lanes.base[:m]
                flat.take(at, out=x, mode="clip")
                if tables is not None:
                    tables.take(node, out=at, mode="clip")
                    k = np.flatnonzero(np.greater_equal(at, 0, out=flags))
                    x[k] = self.w_cats.take(at.take(k) + x.take(k).astype(np.intp))
                if fill is not None:
                    k = np.flatnonzero(np.isnan(x, out=flags))
                    if tables is not None:
                        k = k[at.take(k) < 0]
                    x[k] = fill.take(node.take(k))
                lost = np.flatnonzero(np.isnan(x, out=flags)) if self.w_parts else ()
                self.d_test.take(node, out=cut, mode="clip")
                np.multiply(node, 2, out=at)
                at += np.less_equal(x, cut, out=flags)
                end = m + len(lost)
                if len(lost):
                    here, share = node.take(lost), lanes.share.take(lost)
                    pct = self.pct.take(here)
                    more = rows.lanes(end)
                    if more is not lanes:
                        for old, new in ((lanes.base, more.base), (lanes.share, more.share)):
                            new[:m] = old[:m]
                        lanes = more
                    lanes.base[m:end], lanes.node[m:end], lanes.share[m:end] = lanes.base.take(lost), left.take(here), share * pct
                    lanes.share[lost] = share * (1 - pct)
                self.w_child.take(at, out=lanes.node[:m], mode="clip")
                m = end
            yield a, a + first, lanes.base[:m] // wide - a, lanes.node[:m], lanes.share[:m] if self.w_parts else None

    def walk(self, rows: "Rows") -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(row, leaf node, weight) of every end of every row; weight is None where no row is parted."""
        n, gaps, (first, more, flags) = rows.n, rows.gaps, rows.room
        out, few, stack, cells = [], [], [(0, np.arange(n), None)], self._cells()
        kind, tables = cells["kind"], self.w_cats
        while stack:
            i, mine, w = stack.pop()
            if kind[i] == LEAF:
                out.append((mine, i, w))
                continue
            if len(mine) < FEW:
                few.append((mine, i, w))
                continue
            z, m = first[: len(mine)], len(mine)
            for d, (col, coef, mean, fill) in enumerate(cells["terms"]):
                part = more[:m] if d else z
                at = cells["tables"][d]
                if at is not None and at[i] >= 0:
                    tables[at[i] : at[i] + rows.wide].take(rows.columns[col[i]].take(mine), out=part, mode="clip")
                else:
                    rows.columns[col[i]].take(mine, out=part, mode="clip")
                    if kind[i] != NUM:
                        part -= mean[i]
                        part *= coef[i]
                    if gaps[col[i]] and (kind[i] != NUM or self.w_fill):
                        np.copyto(part, fill[i], where=np.isnan(part, out=flags[:m]))
                if d:
                    z += part
            goes = np.less_equal(z, cells["test"][i], out=flags[:m])
            left, right, pct = cells["left"][i], cells["right"][i], cells["pct"][i]
            if self.w_parts and (lost := np.isnan(z)).any():
                a, b = np.flatnonzero(goes | lost), np.flatnonzero(~goes)
                w = np.ones(len(mine)) if w is None else w
                sides = (right, b, np.where(lost, w * (1 - pct), w)), (left, a, np.where(lost, w * pct, w))
            else:
                sides = (right, np.flatnonzero(~goes), w), (left, np.flatnonzero(goes), w)
            for node, keep, weight in sides:
                if len(keep):
                    stack.append((node, mine.take(keep), None if weight is None else weight.take(keep)))
        parted = any(w is not None for _, _, w in out + few)
        ends = [np.concatenate([m for m, _, _ in out]) if out else np.empty(0, np.int64), np.repeat([i for _, i, _ in out], [len(m) for m, _, _ in out]) if out else np.empty(0, np.int64)]
        weight = lambda v: np.concatenate([np.ones(len(m)) if w is None else w for m, _, w in v]) if v else np.empty(0)
        if not few:
            return *ends, weight(out) if parted else None
        at, node = np.concatenate([m for m, _, _ in few]), np.repeat([i for _, i, _ in few], [len(m) for m, _, _ in few])
        w = weight(few) if self.w_parts else None
        tail = self._steps(rows, at, node, w)
        return np.concatenate([ends[0], tail[0]]), np.concatenate([ends[1], tail[1]]), np.concatenate([weight(out), tail[2]]) if self.w_parts else None

    def _cells(self) -> dict:
        """The arrays that walk reads one value at a time, as lists."""
        terms = [tuple(v.tolist() for v in t) for t in self.w_terms]
        return {"kind": self.kind.tolist(), "col": terms[0][0], "terms": terms, "tables": [None if t is None else t.tolist() for t in self.w_tables], "test": self.w_test.tolist(), "left": self.left.tolist(), "right": self.right.tolist(), "pct": self.pct.tolist()}

    def _steps(self, rows: "Rows", at: np.ndarray, node: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Rows at nodes, one level after another, to their ends."""
        n, done = rows.n, []
        any_gaps = any(rows.gaps)
        while len(node):
            end = self.leaf.take(node)
            if end.any():
                k = np.flatnonzero(end)
                done.append((at.take(k), node.take(k), None if w is None else w.take(k)))
                k = np.flatnonzero(~end)
                at, node, w = at.take(k), node.take(k), None if w is None else w.take(k)
                if not len(node):
                    break
            z = None
            for (col, coef, mean, fill), table in zip(self.w_terms, self.w_tables, strict=True):
                x = rows.flat.take(col.take(node) * n + at)
                if len(self.w_terms) == 1 and self.plane_at[0] < 0:
                    part = x
                else:
                    part = coef.take(node) * (x - mean.take(node))
                if any_gaps and self.w_fill:
                    bad = np.flatnonzero(np.isnan(part))
                    part[bad] = fill.take(node.take(bad))
                if table is not None:
                    place = table.take(node)
                    k = np.flatnonzero(place >= 0)
                    part[k] = self.w_cats.take(place.take(k) + x.take(k).astype(np.int64))
                z = part if z is None else z + part
            nxt = self.w_child.take(2 * node + (z <= self.w_test.take(node)))
            if self.w_parts:
                lost = np.flatnonzero(np.isnan(z))
                if len(lost):
                    here, share = node.take(lost), w.take(lost)
                    pct = self.pct.take(here)
                    w[lost] = share * (1 - pct)  # the right part stays in place
                    nxt = np.concatenate([nxt, self.left.take(here).astype(np.int64)])
                    at, w = np.concatenate([at, at.take(lost)]), np.concatenate([w, share * pct])
            node = nxt
        return tuple(None if w is None and j == 2 else np.concatenate([v[j] for v in done]) for j in range(3))

    def _mark(self, cats: np.ndarray) -> None:
        """Per node: children side by side, the place of its number or indicator in marks()' rows, and the cut."""
        me, self.leaf = np.arange(len(self.kind), dtype=np.int32), self.kind == LEAF
        self.m_child = np.stack([np.where(self.leaf, me, self.right), np.where(self.leaf, me, self.left)], axis=1).ravel().astype(np.int32)
        self.m_test, self.m_col = np.where(self.leaf, np.inf, self.split), np.where(self.leaf, 0, self.col).astype(np.int32)
        starts = self.rules.n_num + np.cumsum([0, *self.rules.n_levels])
        for i in cats:
            self.m_test[i], self.m_col[i] = 0.5, starts[self.col[i] - self.rules.n_num] + int(self.cat_side[self.cat_at[i]].argmax())

    def marked_totals(self, flat: np.ndarray, width: int, n: int) -> np.ndarray:
        """The tree's values of n rows of marks() that miss nothing."""
        base, node = np.arange(n) * width, np.zeros(n, np.int32)
        for _ in range(self.steps):
            node = self.m_child[2 * node + (flat[base + self.m_col[node]] <= self.m_test[node])]
        return self.score[node]

    def _shorten(self, planes: np.ndarray) -> None:
        """Per node: both children side by side (a leaf is its own), and the terms of its value."""
        me = np.arange(len(self.kind), dtype=np.int32)
        leaf = self.kind == LEAF
        self.child = np.stack([np.where(leaf, me, self.right), np.where(leaf, me, self.left)], axis=1).ravel().astype(np.int32)
        self.test = np.where(leaf, np.inf, self.split)
        if not len(planes):
            self.x_col, self.x_coef, self.x_mean = [np.where(leaf, 0, self.col).astype(np.int32)], None, None
            return
        k, deep = self.plane_at, self.t_col.shape[1]
        at = lambda a, d, none: np.where(k >= 0, a[np.maximum(k, 0), d], none)
        self.x_col, self.x_coef, self.x_mean = [], [], []
        for d in range(deep):
            col = at(self.t_col, d, -1)
            single = (self.kind == NUM) & (d == 0)
            self.x_col.append(np.where(single, self.col, np.maximum(col, 0)).astype(np.int32))
            self.x_coef.append(np.where(single, 1.0, np.where(col >= 0, at(self.t_coef, d, 0.0), 0.0)))
            self.x_mean.append(np.where(single, 0.0, at(self.t_mean, d, 0.0)))

    def ends(self, flat: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The leaf node of every row without missing values, on the short way. flat: the rows' finite numbers; base: where each begins."""
        node = np.zeros(len(base), np.int32)
        for _ in range(self.steps):
            if self.x_coef is None:
                z = flat[base + self.x_col[0][node]]
            else:
                z = 0.0
                for col, coef, mean in zip(self.x_col, self.x_coef, self.x_mean, strict=True):
                    z = z + coef[node] * (flat[base + col[node]] - mean[node])
            node = self.child[2 * node + (z <= self.test[node])]
        return node

    def _plane_values(self, num: np.ndarray, cat: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        k, z = self.plane_at[nodes], np.zeros(len(rows))
        for d in range(self.t_col.shape[1]):
            col = self.t_col[k, d]
            is_num = (col >= 0) & (col < self.rules.n_num)
            i = np.flatnonzero(is_num)
            if len(i):
                x = num[rows[i], col[i]]
                ok = np.isfinite(x)
                z[i] += np.where(ok, self.t_coef[k[i], d] * (np.where(ok, x, 0) - self.t_mean[k[i], d]), np.nan if self.rules.missing_action == "fail" else self.t_fill[k[i], d])
            i = np.flatnonzero(col >= self.rules.n_num)
            if len(i):
                codes = cat[rows[i], col[i] - self.rules.n_num]
                known = np.clip(codes, 0, self.t_cats.shape[2] - 1)
                part = self.t_cats[k[i], d, known]
                unseen = np.isnan(part) | (codes >= np.array(self.rules.n_levels)[col[i] - self.rules.n_num])
                part = np.where(unseen, self.t_new[k[i], d], part)
                z[i] += np.where(codes < 0, np.nan if self.rules.missing_action == "fail" else self.t_fill[k[i], d], part)
        return z

    def leaves(self, num: np.ndarray, cat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf node, weight, penalty) of every end of every row; a failed row ends with weight NaN. Rows that are not parted end once with weight 1."""
        n = len(num)
        if self.short and n and np.isfinite(num).all():
            flat = np.ascontiguousarray(num).ravel()
            parts = [self.ends(flat, np.arange(i, min(n, i + BLOCK)) * num.shape[1]) for i in range(0, n, BLOCK)]
            return np.arange(n), np.concatenate(parts).astype(np.int64), np.ones(n), np.zeros(n)
        rows, nodes, weight, penalty = np.arange(n), np.zeros(n, np.int64), np.ones(n), np.zeros(n)
        done = []
        rules = self.rules
        while len(rows):
            at_leaf = self.kind[nodes] == LEAF
            if at_leaf.any():
                done.append((rows[at_leaf], nodes[at_leaf], weight[at_leaf], penalty[at_leaf]))
                rows, nodes, weight, penalty = (v[~at_leaf] for v in (rows, nodes, weight, penalty))
                if not len(rows):
                    break
            kind = self.kind[nodes]
            side = np.zeros(len(rows), np.int8)  # 1 left, 0 right, -1 missing, -2 new category
            i = np.flatnonzero(kind == NUM)
            for i, z in ((i, num[rows[i], self.col[nodes[i]]]), (j := np.flatnonzero(kind == PLANE), self._plane_values(num, cat, rows[j], nodes[j]) if len(j) else np.empty(0))):
                if not len(i):
                    continue
                side[i] = np.where(np.isnan(z), -1, z <= self.split[nodes[i]])
                if rules.penalize_range:
                    penalty[i] += (z < self.lo[nodes[i]]) | (z > self.hi[nodes[i]])
            i = np.flatnonzero(kind == CAT)
            if len(i):
                k = self.col[nodes[i]] - rules.n_num
                codes = cat[rows[i], k]
                wide = self.cat_side.shape[1]
                known = self.cat_side[self.cat_at[nodes[i]], np.clip(codes, 0, wide - 1)].astype(np.int8)
                unseen = codes >= np.array(rules.n_levels)[k]
                single = unseen & self.cat_single[self.cat_at[nodes[i]]]  # a one-level split sends all else to the right
                side[i] = np.where(codes < 0, -1, np.where(single, 0, np.where(unseen | (known < 0), -2, known)))
            pct = self.pct[nodes]
            new = side == -2
            if new.any():
                if rules.new_categ_action == "impute":
                    side[new] = pct[new] >= 0.5
                elif rules.new_categ_action == "smallest":
                    side[new] = pct[new] < 0.5
                elif rules.new_categ_action == "random":
                    side[new] = (cat[rows[new], self.col[nodes[new]] - rules.n_num] + nodes[new]) % 2
                else:
                    side[new] = -3  # parted by weight
            lost = side == -1
            if lost.any():
                if rules.missing_action == "impute":
                    side[lost] = pct[lost] >= 0.5
                elif rules.missing_action == "divide":
                    side[lost] = -3
                else:
                    done.append((rows[lost], nodes[lost], np.full(lost.sum(), np.nan), penalty[lost]))
            both = side == -3
            keep = side >= 0
            nxt = np.where(side == 1, self.left[nodes], self.right[nodes])
            parts = [(rows[keep], nxt[keep], weight[keep], penalty[keep])]
            if both.any():
                parts += [(rows[both], self.left[nodes[both]], weight[both] * pct[both], penalty[both]), (rows[both], self.right[nodes[both]], weight[both] * (1 - pct[both]), penalty[both])]
            rows, nodes, weight, penalty = (np.concatenate(v) for v in zip(*parts, strict=True))
        return tuple(np.concatenate(v) for v in zip(*done, strict=True)) if done else (np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0))

    def totals(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        """The tree's value for every row: leaf scores by weight, less the range penalty."""
        rows, nodes, weight, penalty = self.leaves(num, cat)
        return np.bincount(rows, weight * (self.score[np.minimum(nodes, len(self.score) - 1)] - penalty), len(num)) if not np.isnan(weight).any() else _failed(rows, nodes, weight, penalty, self.score, len(num))


def forest_totals(trees: list[Tree], num: np.ndarray, cat: np.ndarray) -> np.ndarray:
    """Sums over trees for every row. Rows without missing values share what the short way prepares."""
    out = np.zeros(len(num))
    if not trees or not len(num):
        return out
    whole = np.isfinite(num).all(axis=1) if all(t.short for t in trees) else np.zeros(len(num), bool)
    at = np.flatnonzero(whole)
    if len(at):
        flat = np.ascontiguousarray(num if len(at) == len(num) else num[at]).ravel()
        total = np.zeros(len(at))
        for i in range(0, len(at), BLOCK):
            base = np.arange(i, min(len(at), i + BLOCK)) * num.shape[1]
            part = total[i : i + BLOCK]
            for t in trees:
                part += t.score[t.ends(flat, base)]
        out[at] = total
    rest = np.flatnonzero(~whole)
    if len(rest) and all(t.fast for t in trees):
        rows, total = Rows.of(num[rest], cat[rest], trees[0]), np.zeros(len(rest))
        for t in trees:
            for a, b, at, node, weight in t.pieces(rows):
                score = t.score.take(node)
                total[a:b] += np.bincount(at, score if weight is None else weight * score, b - a)
        out[rest] = total
    elif len(rest) and all(t.marked for t in trees):
        rows = marks(num[rest], cat[rest], trees[0].rules)
        gaps = np.isnan(rows).any(axis=1)
        at = np.flatnonzero(gaps)  # such rows fail where they miss what a split needs
        out[rest[at]] = np.sum([t.totals(num[rest[at]], cat[rest[at]]) for t in trees], axis=0) if len(at) else 0.0
        at = np.flatnonzero(~gaps)
        for i in range(0, len(at), BLOCK):
            mine = at[i : i + BLOCK]
            flat, total = np.ascontiguousarray(rows[mine]).ravel(), np.zeros(len(mine))
            for t in trees:
                total += t.marked_totals(flat, rows.shape[1], len(mine))
            out[rest[mine]] = total
    elif len(rest):
        out[rest] = np.sum([t.totals(num[rest], cat[rest]) for t in trees], axis=0)
    return out


class Lanes:
    """Arrays of what goes down a tree: node, where its row begins, its share of the row, and room for a step."""

    def __init__(self, size: int):
        self.node, self.base, self.at = (np.empty(size, np.intp) for _ in range(3))
        self.share, self.x, self.cut, self.flags = np.empty(size), np.empty(size), np.empty(size), np.empty(size, bool)


@dataclass
class Rows:
    """Rows as walk reads them: column after column, levels as places in a table of `wide` entries; gaps: which numbers are missing anywhere.

    columns has the same by column, levels as integers; room is for the values of a node's rows, so that none is allocated for every node.
    grid has the same row after row, with a column of zeros at the end; lanes is the room of rows that go down a tree.
    """

    flat: np.ndarray
    n: int
    gaps: list[bool]
    wide: int
    columns: list[np.ndarray]
    room: tuple[np.ndarray, np.ndarray, np.ndarray]
    _grid: np.ndarray | None = None
    _lanes: Lanes = field(default_factory=lambda: Lanes(0))

    def grid(self) -> np.ndarray:
        if self._grid is None:
            self._grid = np.zeros((self.n, len(self.columns) + 1))
            self._grid[:, :-1] = self.flat.reshape(len(self.columns), self.n).T
        return self._grid

    def lanes(self, size: int) -> Lanes:
        """Room for so many; the same arrays as long as they are large enough."""
        if size > len(self._lanes.node):
            self._lanes = Lanes(2 * size)
        return self._lanes

    @staticmethod
    def of(num: np.ndarray, cat: np.ndarray, tree: Tree) -> Rows:
        rules = tree.rules
        most = max(rules.n_levels, default=1)
        if (tree.plane_at >= 0).any():  # hyperplanes take infinite values for missing
            num = np.where(np.isfinite(num), num, np.nan)
        codes = [np.where(c < 0, most + 1, np.where(c >= k, most, c)) for c, k in zip(cat.T, rules.n_levels, strict=True)]
        n, flat = len(num), np.concatenate([num.T.ravel(), *[c.astype(float) for c in codes]])
        columns = [*flat[: num.size].reshape(num.shape[1], n), *[c.astype(np.intp) for c in codes]]
        gaps = [*np.isnan(num).any(axis=0).tolist(), *[False] * len(codes)]
        return Rows(flat, n, gaps, most + 2, columns, (np.empty(n), np.empty(n), np.empty(n, bool)))


def marks(num: np.ndarray, cat: np.ndarray, rules: Rules) -> np.ndarray:
    """Numbers, then for every level 0 where a row has it, 1 where it has another, and NaN where its value is missing."""
    parts = [num]
    for k, levels in enumerate(rules.n_levels):
        parts.append(np.where(cat[:, k, None] < 0, np.nan, cat[:, k, None] != np.arange(levels)))
    return np.hstack(parts)


def _failed(rows, nodes, weight, penalty, score, n) -> np.ndarray:
    value = np.where(np.isnan(weight), 0, weight * (np.nan_to_num(score[nodes]) - penalty))
    out = np.bincount(rows, value, n)
    out[rows[np.isnan(weight)]] = np.nan
    return out


#: What a node's missing number stands for.
_NONE = {"left": 0, "right": 0, "col": -1, "depth": 0, "split": 0.0, "pct_left": 0.5, "score": np.nan, "lo": -np.inf, "hi": np.inf}


def trees_of(nodes, rules: Rules) -> list[Tree]:
    """nodes: a pandas frame of node rows; trees in order."""
    nodes = nodes.sort_values(["tree", "node"], kind="stable")
    columns = {"name": nodes["kind"].to_numpy(object)}
    columns["kind"] = nodes["kind"].map(_KINDS).to_numpy(np.int8)
    for name, none in _NONE.items():
        columns[name] = nodes[name].astype(float).fillna(none).to_numpy()
    for name in ("cat_left", "cat_right", "terms"):
        columns[name] = nodes[name].to_numpy(object)
    tree = nodes["tree"].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1]))) if len(tree) else []
    return [Tree({k: v[a:b] for k, v in columns.items()}, rules) for a, b in zip(starts, [*starts[1:], len(tree)], strict=True)]
