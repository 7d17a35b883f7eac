"""Growing a tree on more rows than one task may hold: the nodes at the top are split one level at a time from statistics that tasks
gather, until every open node's rows fit a task, which grows what is below it. Only splits by chance in single columns are grown so.
"""

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.operators.grow import NODE_SCHEMA, Grower, MissingValues, Sample
from copse.operators.traverse import Rules, Tree, trees_of
from copse.plans.params import ForestParams


def can_spread(p: ForestParams) -> bool:
    guided = p.prob_pick_avg_gain + p.prob_pick_pooled_gain + p.prob_pick_full_gain + p.prob_pick_dens > 0
    return not (guided or p.ndim > 1 or p.prob_pick_col_by_var or p.prob_pick_col_by_kurt or p.weigh_by_kurtosis or p.build_imputer or p.sample_with_replacement)


def _ends(tree: Tree, num: np.ndarray, cat: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """node, rows and their weights at every end of the tree that rows reach."""
    rows, nodes, share, _ = tree.leaves(num, cat)
    if np.isnan(share).any():
        raise MissingValues("the data have missing values and missing_action is 'fail'")
    order = np.argsort(nodes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(nodes[order])) + 1):
        if len(part):
            yield int(nodes[part[0]]), rows[part], weight[rows[part]] * share[part]


def _gather(rows: DataFrame, schema, tree: Tree, splits: dict) -> dict[int, list[np.ndarray]]:
    """Per node: rows, weight; least and largest values, finite ones, and rows of every level. With splits: weights that go left, and that are known."""
    sent = rows.sparkSession.sparkContext.broadcast((tree, splits))
    wide = len(schema.numeric)

    def of(num, cat, w, split):
        if split is not None:
            kind, col, at, left = split
            if kind == "num":
                goes, known = num[:, col] <= at, ~np.isnan(num[:, col])
            else:
                goes, known = np.isin(cat[:, col - wide], left), cat[:, col - wide] >= 0
            return [np.array([w[goes].sum(), w[known].sum()])]
        whole = np.where(np.isfinite(num), num, np.nan)
        edges = [f.reduce(x, axis=0, initial=np.nan) for x in (num, whole) for f in (np.fmin, np.fmax)]
        levels = [np.bincount(cat[cat[:, k] >= 0, k], minlength=len(x))[: len(x)] for k, x in enumerate(schema.levels)]
        return [np.array([len(w), w.sum()]), *edges, np.concatenate(levels).astype(float) if levels else np.empty(0)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, splits = sent.value
        found = {}
        for pdf in batches:
            num, cat = schema.arrays(pdf)
            for node, at, w in _ends(tree, num, cat, pdf["sample_weight"].to_numpy(float)):
                if not splits or node in splits:
                    mine = of(num[at], cat[at], w, splits.get(node))
                    found[node] = _add(found[node], mine) if node in found else mine
        for node, parts in found.items():
            yield pd.DataFrame({"node": [node], "parts": [[x.tolist() for x in parts]]})

    out = {}
    for r in rows.mapInPandas(work, "node int, parts array<array<double>>").collect():  # a row per task and open node
        mine = [np.array(x, float) for x in r["parts"]]
        out[r["node"]] = _add(out[r["node"]], mine) if r["node"] in out else mine
    return out


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    if len(a) == 1:
        return [a[0] + b[0]]
    return [a[0] + b[0], np.fmin(a[1], b[1]), np.fmax(a[2], b[2]), np.fmin(a[3], b[3]), np.fmax(a[4], b[4]), a[5] + b[5]]


def _like(stats: list[np.ndarray], n_levels: list[int], col_weight) -> Sample:
    """A few rows with a node's ends and levels, from which splits by chance come as from its own rows."""
    edges = np.array(stats[1:5]).reshape(4, -1)
    at = [(k, v) for k, (a, n) in enumerate(zip(np.cumsum([0, *n_levels]), n_levels, strict=False)) for v in np.flatnonzero(stats[5][a : a + n])]
    num = np.vstack([edges, np.full((len(at), edges.shape[1]), np.nan)])
    cat = np.full((len(num), len(n_levels)), -1, np.int64)
    for i, (k, v) in enumerate(at, 4):
        cat[i, k] = v
    return Sample(num, cat, n_levels, np.ones(len(num)), col_weight)


def grow_spread(df: DataFrame, schema, p: ForestParams, rules: Rules, tree: int, n: int, depth: int | None, weight: Column | None, col_weight, most_rows: int) -> pd.DataFrame:
    """The nodes of one tree on all rows of df, in order."""
    rows = df.select(*schema.select(df), (F.lit(1.0) if weight is None else weight.cast("double")).alias("sample_weight"))
    if weight is not None:
        rows = rows.withColumn("sample_weight", F.col("sample_weight") * F.lit(n / rows.agg(F.sum("sample_weight")).first()[0]))
    n_levels, rng = [len(x) for x in schema.levels], np.random.default_rng([p.random_seed, tree])
    blank = dict.fromkeys("split cat_left cat_right pct_left score lo hi terms imp".split()) | {"tree": tree, "left": 0, "right": 0, "kind": "leaf", "col": -1, "n": 0.0, "remainder": 0.0}
    nodes, states, small, cols, total = [blank | {"node": 0, "parent": -1, "depth": 0}], {}, [], None, 0.0
    p, drawn, left = replace(p, ncols_per_tree=None), p, [0]
    while left:
        now = trees_of(pd.DataFrame(nodes), rules)[0]
        stats, growers, splits = _gather(rows, schema, now, {}), {}, {}
        for i in left:
            sample = _like(stats[i], n_levels, col_weight)
            if cols is None:
                root = Grower(sample, drawn, rng, depth)
                cols, total = root.cols, float(stats[i][0][1])
                states[i] = {"adj": 0.0 if p.scoring_metric == "adj_depth" else 1.0, "dens": 0.0, "box": 0.0, "low": root.low, "high": root.high, "levels": root.levels0}
            split = None
            if stats[i][0][0] > most_rows and (depth is None or nodes[i]["depth"] < depth):
                g = growers[i] = Grower(sample, p, rng, depth)
                every = np.arange(len(sample.weight))
                mine = g._splittable(every, cols)
                mine = mine[g.col_weight[mine] > 0] if len(mine) else mine
                split = g._single(every, sample.weight, mine) if len(mine) else None
            nodes[i]["n"] = float(stats[i][0][1])
            if split is None:
                small.append(i)
            else:
                splits[i] = split
        shares = _gather(rows, schema, now, {i: (s.kind, s.col, s.at, s.left_codes) for i, s in splits.items()}) if splits else {}
        left = []
        for i, s in splits.items():
            goes, known = shares[i][0]
            pct = goes / known if known > 0 else 0.5
            nodes[i] |= {"kind": s.kind, "col": s.col, "pct_left": pct, "left": len(nodes), "right": len(nodes) + 1}
            nodes[i] |= {"split": s.at, "lo": s.at - (s.high - s.low), "hi": s.at + s.high - s.low} if s.kind == "num" else {"cat_left": s.left_codes, "cat_right": s.right_codes}
            for state in growers[i]._states(s, pct, states[i]):
                states[len(nodes)] = state
                left.append(len(nodes))
                nodes.append(blank | {"node": len(nodes), "parent": i, "depth": nodes[i]["depth"] + 1})
    top, starts = trees_of(pd.DataFrame(nodes), rules)[0], {i: (nodes[i]["depth"], states[i], nodes[i]["n"]) for i in small}
    closed = {}
    for i in list(starts):  # ends that no rows' values part any more, or the depth's limit: nothing is left to grow
        at, state, weight_here = starts[i]
        if depth is not None and at >= depth:
            g = Grower(Sample(np.empty((0, len(schema.numeric))), np.empty((0, len(n_levels)), np.int64), n_levels, np.ones(0), col_weight), p, rng, depth)
            g.total = total
            g._close(nodes[i], weight_here, at, state)
            closed[i] = [nodes[i]]
            del starts[i]
    sent = df.sparkSession.sparkContext.broadcast((top, starts))
    seed, kinds = p.random_seed, ", ".join(f"`{c}` double" for c in schema.numeric) + "".join(f", `{c}` string" for c in schema.categorical)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, at, w in _ends(sent.value[0], *schema.arrays(pdf), pdf["sample_weight"].to_numpy(float)):
                if node in sent.value[1]:
                    yield pdf.iloc[at].assign(sample_weight=w, at=np.int32(node))

    columns = "tree node parent left right depth kind col split cat_left cat_right pct_left score n lo hi remainder terms imp".split()

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["at"].iloc[0])
        at, state, _ = sent.value[1][i]
        num, cat = schema.arrays(pdf)
        g = Grower(Sample(num, cat, n_levels, pdf["sample_weight"].to_numpy(float), col_weight), p, np.random.default_rng([seed, tree, i]), depth)
        g.cols, g.total = cols, total
        return pd.DataFrame(g.grow(i, at, state), columns=columns)

    dealt = rows.mapInPandas(deal, f"{kinds}, sample_weight double, at int".lstrip(", "))
    grown = dealt.repartition(max(1, len(starts)), "at").groupBy("at").applyInPandas(subtree, NODE_SCHEMA).toArrow().to_pandas() if starts else pd.DataFrame(columns=columns)
    closed |= {int(i): part.sort_values("node").to_dict("records") for i, part in grown.groupby("tree")}
    out, stack = [], [(0, -1, False)]
    while stack:  # in pre-order
        i, parent, is_right = stack.pop()
        base = len(out)
        if parent >= 0:
            out[parent]["right" if is_right else "left"] = base
        if i in closed:
            for r in closed[i]:
                inner = r["kind"] != "leaf"
                me = len(out)
                out.append(r | {"tree": tree, "node": me, "parent": base + r["parent"] if me > base else parent, "left": base + r["left"] if inner else 0, "right": base + r["right"] if inner else 0})
        else:
            out.append(nodes[i] | {"node": base, "parent": parent})
            stack += [(nodes[i]["right"], base, True), (nodes[i]["left"], base, False)]
    return pd.DataFrame(out, columns=columns)
