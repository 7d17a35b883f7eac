"""Missing values from terminal nodes: weighted means of numbers and the level with most weight, over all trees a row ends in."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copse.operators.forest import ForestModel, Schema, _free_name, columns_of
from copse.operators.stored import CHUNK, chunks, dealt, opened, read_alike, unlike
from copse.operators.traverse import Rows, Tree


def with_values(trees: list[Tree], nodes: pd.DataFrame, schema: Schema) -> None:
    """Gives trees the imputer's values of their leaves from the node rows."""
    starts = np.cumsum([len(schema.numeric), *[len(x) for x in schema.levels]])
    for tree, (_, part) in zip(trees, nodes.groupby("tree", sort=True), strict=True):
        found = part[part["kind"] == "leaf"].sort_values("node")["imp"]
        values, weights = np.zeros((len(found), starts[-1])), np.zeros((len(found), len(schema.columns)))
        for i, imp in enumerate(found):
            for x in imp if imp is not None else ():
                c = x["col"]
                values[i, c if x["level"] < 0 else starts[c - len(schema.numeric)] + x["level"]], weights[i, c] = x["value"], x["weight"]
        tree.imp = values, weights


def _gathered(forest: Iterator[list[Tree]], num: np.ndarray, cat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the columns that a row misses, over the leaves of all trees: sums of value * weight, and of the numeric columns' weights."""
    n, n_num = num.shape
    sums, weights = np.zeros((starts[-1], n)), np.zeros((n_num, n))
    bad = [~np.isfinite(x) for x in num.T] + [x < 0 for x in cat.T]
    lost = [c for c, x in enumerate(bad) if x.any()]
    for trees in forest:
        rows = Rows.of(num, cat, trees[0])
        for t in trees:
            values = {}  # by row of sums, what every leaf adds
            for c in lost:
                for v in [c] if c < n_num else range(starts[c - n_num], starts[c - n_num + 1]):
                    values[v] = t.imp[1][:, c] * t.imp[0][:, v]
            for a, b, at, ends, share in t.pieces(rows) if t.fast else [(0, n, *t.leaves(num, cat)[:3])]:
                leaf = t.leaf_number.take(ends)
                for c in lost:
                    k = np.flatnonzero(bad[c][a:b].take(at))
                    mine, here = at.take(k), leaf.take(k)
                    part = None if share is None else share.take(k)
                    adds = [(weights[c], np.ascontiguousarray(t.imp[1][:, c]))] if c < n_num else []
                    adds += [(sums[v], values[v]) for v in ([c] if c < n_num else range(starts[c - n_num], starts[c - n_num + 1]))]
                    for total, by_leaf in adds:
                        x = by_leaf.take(here)
                        total[a:b] += np.bincount(mine, x if part is None else x * part, b - a)
    return sums.T, weights.T


def _misses(features: str, schema: Schema) -> Column:
    """Whether a row lacks a value of the model's columns, which are fields of features; never null."""
    out = F.lit(False)
    for c in schema.columns:
        x = F.col(features)[c]
        out = out | x.isNull()
        if c in schema.numeric:
            out = out | F.isnan(x) | (F.abs(F.coalesce(x, F.lit(0.0))) == float("inf"))
    return out


def impute(model: ForestModel, df: DataFrame) -> DataFrame:
    """df with missing values of the model's columns filled; other columns and the column order stay.

    Numbers fall back to the column's mean over the fitted table, categories to its mode. Rows without missing values are not changed.
    """
    if not model.params.build_imputer:
        raise ValueError("the forest was fitted without an imputer")
    schema = model.schema
    if schema.elements:
        raise TypeError("elements of array columns are not imputed; select them as columns of their own")
    n_num, defaults = len(schema.numeric), model.defaults
    starts = np.cumsum([n_num, *[len(x) for x in schema.levels]])

    def fill(pdf: pd.DataFrame, forest: Iterator[list[Tree]]) -> pd.DataFrame:
        num, cat = schema.arrays(pdf)
        holes = ~np.isfinite(num).all(axis=1) | (cat < 0).any(axis=1)
        at = np.flatnonzero(holes)
        filled_levels = {}
        if len(at):
            sums, weights = _gathered(forest, num[at], cat[at], starts)
            for c in range(n_num):
                bad = ~np.isfinite(num[at, c])
                with np.errstate(all="ignore"):
                    value = np.where(weights[:, c] > 0, sums[:, c] / weights[:, c], np.nan if defaults[c] is None else defaults[c])
                num[at[bad], c] = value[bad]
            for k, levels in enumerate(schema.levels):
                part = sums[:, starts[k] : starts[k + 1]]
                bad = cat[at, k] < 0
                value = np.full(len(at), defaults[n_num + k], object)
                if part.shape[1]:
                    value = np.where(part.max(axis=1) > 0, np.array(levels, object)[part.argmax(axis=1)], value)
                full = pdf[schema.categorical[k]].to_numpy(object, copy=True)
                full[at[bad]] = value[bad]
                filled_levels[schema.categorical[k]] = full
        out = {c: num[:, i] for i, c in enumerate(schema.numeric)} | {c: filled_levels.get(c, pdf[c]) for c in schema.categorical}
        return pd.DataFrame(out, columns=list(schema.columns))

    name = _free_name(df, "filled")
    features = F.struct(*schema.select(df))
    kind = T.StructType([*[T.StructField(c, T.DoubleType()) for c in schema.numeric], *[T.StructField(c, T.StringType()) for c in schema.categorical]])
    if "stored" in model.__dict__ and not df.isStreaming:
        given, shape = _free_name(df, "features"), pa.struct([(c, pa.float64()) for c in schema.numeric] + [(c, pa.string()) for c in schema.categorical])

        def filled(rows: pa.Table, forest: Iterator[list[Tree]]) -> pa.Array:
            pdf = columns_of(rows, given)
            first, place = unlike(*schema.arrays(pdf))
            found = fill(pdf.iloc[first].reset_index(drop=True), forest)
            for _ in forest:
                pass  # where no row misses anything
            return pa.StructArray.from_arrays([pa.array(found[f.name], f.type, from_pandas=True) for f in shape], fields=list(shape)).take(pa.array(place))

        rows = df.withColumn(given, features)
        lost, whole = rows, None
        if read_alike(df):  # else rows that are read twice may change sides
            holes = _misses(given, schema)
            lost, whole = rows.where(holes), rows.where(~holes).withColumn(name, F.lit(None).cast(kind))
        rows = model.stored.over(lost, name, kind, filled, given)
        rows = rows if whole is None else rows.unionByName(whole)
    else:
        runs = model.sent(df.sparkSession, imputer=True)
        many = len(runs) > 1

        @F.pandas_udf(kind)
        def in_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for held in chunks(batches, CHUNK if many else 1):
                yield fill(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0], opened(runs))

        rows = (dealt(df) if many else df).withColumn(name, in_batches(features))
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def back(c: str):
        value = F.col(name)[c]
        if c in schema.temporal:
            value = F.timestamp_micros(value.cast("long"))
        elif isinstance(kinds[c], T.IntegralType):
            value = F.round(value)
        have = F.col(c).isNull() if c in schema.categorical or c in schema.temporal or isinstance(kinds[c], T.IntegralType) else F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
        return F.when(have, value.cast(kinds[c])).otherwise(F.col(c)).alias(c)

    return rows.select(*[back(c) if c in schema.columns else F.col(c) for c in df.columns])
