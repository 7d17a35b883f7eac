"""A forest as SQL, JSON and DOT.

SQL is one nested CASE per tree, each condition once, with full-precision DOUBLE literals; it runs on Spark and DuckDB. Missing values
follow the side that "impute" takes; forests that divide them are exported for rows without missing values. Range penalties are added.
"""

import json

from copse.functions.special import LOG_METRICS
from copse.operators.forest import ForestModel


def _number(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _quoted(name: str, enclose: str) -> str:
    return {"doublequotes": f'"{name}"', "backticks": f"`{name}`", "squarebraces": f"[{name}]", "none": name}[enclose]


def _columns(model: ForestModel, column_names: list[str] | None, column_names_categ: list[str] | None) -> list[str]:
    """The names to write: the model's, or those given for its numeric and its categorical columns."""
    out: list[str] = []
    for own, given in ((model.schema.numeric, column_names), (model.schema.categorical, column_names_categ)):
        if given is not None and len(given) != len(own):
            raise ValueError(f"{len(given)} names were given for {len(own)} columns: {list(own)}")
        out += own if given is None else given
    return out


class _Writer:
    def __init__(self, model: ForestModel, tree: int, enclose: str, leaf, names: list[str] | None = None):
        s = model.schema
        self.model, self.leaf = model, leaf
        self.rows = model.nodes[model.nodes["tree"] == tree].sort_values("node").to_dict("records")
        self.names = [_quoted(c, enclose) for c in names or s.columns]
        self.n_num = len(s.numeric)

    def levels(self, col: int, codes) -> str:
        known = self.model.schema.levels[col - self.n_num]
        return ", ".join(_text(known[c]) for c in codes)

    def plane(self, node: dict) -> str:
        parts = []
        for t in node["terms"]:
            name = self.names[t["col"]]
            if t["cats"] is None:
                parts.append(f"COALESCE({_number(t['coef'])} * (CAST({name} AS DOUBLE) - {_number(t['mean'])}), {_number(t['fill'])})")
            else:
                levels = self.model.schema.levels[t["col"] - self.n_num]
                whens = " ".join(f"WHEN {_text(levels[k])} THEN {_number(v)}" for k, v in enumerate(t["cats"]) if v is not None and v == v)
                parts.append(f"CASE WHEN {name} IS NULL THEN {_number(t['fill'])} ELSE CASE {name} {whens} ELSE {_number(t['fill_new'])} END END")
        return " + ".join(f"({p})" for p in parts)

    def condition(self, node: dict) -> str:
        """True for rows that go left."""
        if node["kind"] == "hplane":
            return f"{self.plane(node)} <= {_number(node['split'])}"
        name, left = self.names[node["col"]], node["pct_left"] >= 0.5
        if node["kind"] == "num":
            return f"COALESCE(CAST({name} AS DOUBLE) <= {_number(node['split'])}, {str(left).upper()})"
        yes, no = self.levels(node["col"], node["cat_left"]), self.levels(node["col"], node["cat_right"])
        if node["kind"] == "single":
            return f"COALESCE({name} IN ({yes}), {str(left).upper()})"
        new = {"smallest": not left}.get(self.model.params.new_categ_action, left)
        return f"CASE WHEN {name} IS NULL THEN {str(left).upper()} WHEN {name} IN ({yes}) THEN TRUE WHEN {name} IN ({no}) THEN FALSE ELSE {str(new).upper()} END"

    def expression(self, at: int = 0) -> str:
        node = self.rows[at]
        if node["kind"] == "leaf":
            return self.leaf(node)
        inner = f"CASE WHEN {self.condition(node)} THEN {self.expression(node['left'])} ELSE {self.expression(node['right'])} END"
        if not self.model.params.penalize_range:
            return inner
        x = self.plane(node) if node["kind"] == "hplane" else f"CAST({self.names[node['col']]} AS DOUBLE)" if node["kind"] == "num" else None
        return inner if x is None else f"({inner} - CASE WHEN {x} < {_number(node['lo'])} OR {x} > {_number(node['hi'])} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


def tree_sql(model: ForestModel, tree: int, *, enclose: str = "doublequotes", output_tree_num: bool = False, column_names: list[str] | None = None, column_names_categ: list[str] | None = None) -> str:
    """A tree's value, or its leaf's number, as one expression. Names given in place of the model's may be any expressions with enclose "none"."""
    numbers: dict[int, int] = {}
    for i, node in enumerate(model.nodes[(model.nodes["tree"] == tree) & (model.nodes["kind"] == "leaf")].sort_values("node")["node"]):
        numbers[int(node)] = i
    leaf = (lambda n: str(numbers[int(n["node"])])) if output_tree_num else (lambda n: _number(n["score"]))
    return _Writer(model, tree, enclose, leaf, _columns(model, column_names, column_names_categ)).expression()


def score_sql(model: ForestModel, *, enclose: str = "doublequotes", **names) -> str:
    """The standardised score as one expression over a row."""
    total = " + ".join(f"({tree_sql(model, t, enclose=enclose, **names)})" for t in range(model.ntrees))
    mean, metric = f"(({total}) / {_number(model.ntrees)})", model.params.scoring_metric
    if metric in ("depth", "adj_depth", "adj_density"):
        return f"POWER({_number(2)}, -{mean} / {_number(model.depth_norm)})"
    if metric in LOG_METRICS:
        return f"-EXP({mean})" if metric == "boxed_density" else f"-{mean}"
    return mean


def to_sql(model: ForestModel, *, enclose: str = "doublequotes", output_tree_num: bool = False, tree: int | None = None, table_from: str | None = None, select_as: str = "outlier_score", **names):
    """A list of expressions, one per tree (or one tree's); with table_from a whole SELECT of the score. names: column_names, column_names_categ."""
    if table_from:
        return f"SELECT *, {score_sql(model, enclose=enclose, **names)} AS {_quoted(select_as, enclose)} FROM {table_from}"
    trees = range(model.ntrees) if tree is None else [tree]
    return [tree_sql(model, t, enclose=enclose, output_tree_num=output_tree_num, **names) for t in trees]


def to_json(model: ForestModel, *, tree: int | None = None, as_str: bool = False, output_tree_num: bool = False, column_names: list[str] | None = None, column_names_categ: list[str] | None = None):
    """Per tree, nodes by number: terminal, score and leaf (output_tree_num: the leaf only), or the split, the share that goes left, the range and the children."""
    out = []
    s, columns = model.schema, _columns(model, column_names, column_names_categ)
    for t in range(model.ntrees) if tree is None else [tree]:
        nodes, leaf = {}, 0
        for r in model.nodes[model.nodes["tree"] == t].sort_values("node").to_dict("records"):
            if r["kind"] == "leaf":
                nodes[str(r["node"])] = {"terminal": "Yes"} | ({} if output_tree_num else {"score": float(r["score"])}) | {"leaf": leaf}
                leaf += 1
                continue
            d = {"terminal": "No", "fraction_yes": float(r["pct_left"]), "node_if_true": int(r["left"]), "node_if_false": int(r["right"])}
            if r["kind"] == "num":
                d |= {"condition": "<=", "column": columns[r["col"]], "value": float(r["split"])}
            elif r["kind"] == "hplane":
                combination = [{"column": columns[x["col"]]} | ({"coef": x["coef"], "center": x["mean"], "fill": x["fill"]} if x["cats"] is None else {"coefs": {s.levels[x["col"] - len(s.numeric)][k]: v for k, v in enumerate(x["cats"]) if v is not None and v == v}, "fill": x["fill"]}) for x in r["terms"]]
                d |= {"condition": "<=", "value": float(r["split"]), "combination": combination}
            else:
                names = s.levels[r["col"] - len(s.numeric)]
                d |= {"condition": "in", "column": columns[r["col"]], "value": [names[k] for k in r["cat_left"]], "otherwise": [names[k] for k in r["cat_right"]]}
            if model.params.penalize_range and r["lo"] is not None and r["lo"] == r["lo"]:
                d["range"] = [float(r["lo"]), float(r["hi"])]
            nodes[str(r["node"])] = d
        out.append(nodes)
    result = out if tree is None else out[0]
    return json.dumps(result) if as_str else result


def to_dot(model: ForestModel, tree: int = 0, *, output_tree_num: bool = False, **names) -> str:
    """A tree as a DOT digraph; its leaves show their scores, or their numbers. names: column_names, column_names_categ."""
    lines = ["digraph tree {", "  node [shape=box];"]
    for number, d in to_json(model, tree=tree, output_tree_num=output_tree_num, **names).items():
        if d["terminal"] == "Yes":
            told = f"leaf {d['leaf']}" if output_tree_num else f"score {d['score']:.6g}"
            lines.append(f'  n{number} [label="{told}", style=rounded];')
            continue
        what = " + ".join(x["column"] for x in d["combination"]) if "combination" in d else d["column"]
        value = ", ".join(d["value"]) if isinstance(d["value"], list) else f"{d['value']:.6g}"
        label = f"{what} {d['condition']} {value}".replace("\\", "\\\\").replace('"', '\\"')
        lines.append(f'  n{number} [label="{label}"];')
        lines.append(f'  n{number} -> n{d["node_if_true"]} [label="yes"];')
        lines.append(f'  n{number} -> n{d["node_if_false"]} [label="no"];')
    return "\n".join([*lines, "}"])


def to_treelite(model: ForestModel):
    raise NotImplementedError("this export needs a third-party library; use to_sql or to_json")
