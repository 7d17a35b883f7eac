"""Small forests that are the same in every session: grown by this package over a sample that a seed determines, without any table."""

from functools import lru_cache

import numpy as np
import pandas as pd

from copse.functions.special import expected_depth, expected_separation
from copse.operators.forest import _NODE_COLUMNS, ForestModel, Schema
from copse.operators.grow import Grower, Sample
from copse.plans.params import ForestParams

LINEITEM = Schema(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus"), (("A", "N", "R"), ("F", "O")))
NUMERIC = Schema(LINEITEM.numeric)
SUPPLIER = Schema(("s_acctbal", "s_nationkey"))
_VECTOR = tuple((f"embedding[{i}]", "embedding", i) for i in range(64))
VECTORS = Schema(tuple(f for f, _, _ in _VECTOR), elements=_VECTOR)


def _sample(schema: Schema, rows: int, seed: int, holes: float) -> Sample:
    rng = np.random.default_rng(seed)
    if schema is SUPPLIER:
        num = np.column_stack([rng.uniform(-999, 9999, rows), rng.integers(0, 25, rows)])
    elif schema is VECTORS:
        num = rng.normal(0, 0.125, (rows, len(schema.numeric)))
    else:
        q = rng.integers(1, 51, rows).astype(float)
        num = np.column_stack([q, q * rng.uniform(900, 2000, rows), rng.integers(0, 11, rows) / 100, rng.integers(0, 9, rows) / 100])
    cat = np.column_stack([rng.integers(0, len(x), rows) for x in schema.levels]) if schema.levels else np.empty((rows, 0), np.int64)
    num[rng.random(num.shape) < holes] = np.nan
    return Sample(num, cat, [len(x) for x in schema.levels], np.ones(rows))


@lru_cache(64)
def pinned(name: str, seed: int = 3, rows: int = 64, holes: float = 0.0, **given) -> ForestModel:
    schema = {"lineitem": LINEITEM, "numeric": NUMERIC, "supplier": SUPPLIER, "embeddings": VECTORS}[name]
    p = ForestParams.of(**dict(ntrees=5, max_depth=4, sample_size=rows) | given).resolved()
    nodes = []
    for tree in range(p.ntrees):
        rng = np.random.default_rng([seed, tree])
        nodes += Grower(_sample(schema, rows, seed * 1000 + tree, holes), p, rng, p.max_depth).grow(tree)
    return ForestModel(p, schema, pd.DataFrame(nodes, columns=_NODE_COLUMNS), rows, expected_depth(rows), expected_separation(rows), (25.0, 40_000.0, 0.05, 0.04, "N", "O")[: len(schema.columns)])
