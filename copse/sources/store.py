"""A forest as files: node rows in Parquet and one JSON row of metadata. Appended trees are further files of the same table."""

import json
import re
import tempfile
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.operators.forest import ForestModel, Schema
from copse.operators.grow import NODE_SCHEMA
from copse.plans.params import ForestParams

VERSION = 1


def nodes_to_spark(spark: SparkSession, nodes: pd.DataFrame) -> DataFrame:
    def plain(v):
        if v is None or isinstance(v, float) and v != v:
            return None
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if hasattr(v, "__len__") and not isinstance(v, str):
            return [plain(x) for x in v]
        return v.item() if hasattr(v, "item") else v

    rows = [tuple(plain(v) for v in row) for row in nodes.itertuples(index=False)]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def metadata(model: ForestModel) -> dict:
    s = model.schema
    return {
        "version": VERSION,
        "data_info": {"numeric": s.numeric, "categorical": s.categorical, "levels": s.levels, "temporal": s.temporal, "elements": s.elements},
        "model_info": {"ntrees": model.ntrees, "sample_size": model.sample_size, "depth_norm": model.depth_norm, "sep_norm": model.sep_norm, "defaults": model.defaults},
        "params": asdict(model.params),
    }


def save(spark: SparkSession, model: ForestModel, path: str) -> None:
    nodes_to_spark(spark, model.nodes).write.parquet(f"{path}/nodes")
    spark.createDataFrame([(json.dumps(metadata(model)),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def append(spark: SparkSession, model: ForestModel, path: str) -> int:
    """Adds the trees that the saved forest lacks, as new files; returns how many."""
    saved = spark.read.parquet(f"{path}/nodes").agg(F.max("tree")).first()[0]
    more = model.nodes[model.nodes["tree"] > saved]
    if len(more):
        nodes_to_spark(spark, more).write.mode("append").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(metadata(model)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return int(more["tree"].nunique())


def load(spark: SparkSession, path: str) -> ForestModel:
    found = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if found.get("version") != VERSION:
        raise ValueError(f"unknown version of a saved forest: {found.get('version')}")
    info, about = found["data_info"], found["model_info"]
    schema = Schema(tuple(info["numeric"]), tuple(info["categorical"]), tuple(tuple(x) for x in info["levels"]), tuple(info["temporal"]), tuple(tuple(x) for x in info.get("elements", ())))
    return from_nodes(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"), ForestParams.of(**found["params"]), schema, about["sample_size"], about["depth_norm"], about["sep_norm"], tuple(about["defaults"]))


def from_nodes(nodes: DataFrame, params: ForestParams, schema: Schema, sample_size: int, depth_norm: float, sep_norm: float, defaults: tuple = ()) -> ForestModel:
    """A model from a table of nodes, such as a pinned or hand-built forest."""
    rows = nodes.orderBy("tree", "node").toArrow().to_pandas()
    return ForestModel(params, schema, rows, sample_size, depth_norm, sep_norm, defaults)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session may use one of its own; on a cluster others could not read that."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that the driver and all executors share")
        root = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="copse-shared-")
        shared_folder.own = root
    return root.rstrip("/")
