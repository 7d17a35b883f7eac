"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where a local session leaves it unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that the driver and all executors share")
        root = getattr(shared_root, "own", None) or tempfile.mkdtemp(prefix="copse-shared-")
        shared_root.own = root
    return root.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later stages have no lineage to recompute, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/copse-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes stashed tables that no later stage reads."""
    for df in tables:
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished phases now; it does when the driver's objects that refer to them are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
