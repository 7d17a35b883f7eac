"""Shard assignment by a hierarchical weighted hash tree. DataFrame operations only.

A document descends region, rack and shard. At each node every child draws -ln(u)/weight, u being a hash of the document's id
and the child's name, and the smallest draw wins; a node's weight is the sum of the shards below it. A changed weight therefore
moves documents only into or out of the subtrees whose weights change. grow() opens a region of its own for a new shard, so
growth moves documents only into the new shard (law "key").

Defined results: a null text has size 16 and checksum 0. A null id hashes like any value and takes one fixed place. Rows that
repeat an id go to the same shard and get different slots. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.llm.common import free_name, shuffle_width, stash, whole_text


@dataclass(frozen=True)
class Topology:
    """regions -> racks -> {shard: weight}. Names are hashed, so they must stay when weights change."""

    regions: dict[str, dict[str, dict[int, float]]]

    @staticmethod
    def regular(shards: int, *, per_rack: int = 5, racks_per_region: int = 2) -> Topology:
        regions: dict[str, dict[str, dict[int, float]]] = {}
        for s in range(shards):
            rack = s // per_rack
            regions.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
        return Topology(regions)

    def shards(self) -> list[int]:
        return [s for racks in self.regions.values() for shards in racks.values() for s in shards]

    def grow(self, weight: float = 1.0) -> Topology:
        """With one more shard, alone in a new region: no other subtree's weight changes."""
        new = max(self.shards(), default=-1) + 1
        return Topology(self.regions | {f"region-of-{new}": {f"rack-of-{new}": {new: weight}}})

    def reweighted(self, shard: int, weight: float) -> Topology:
        return Topology({r: {k: {s: weight if s == shard else w for s, w in shards.items()} for k, shards in racks.items()} for r, racks in self.regions.items()})


def _weight(tree) -> float:
    return float(tree) if isinstance(tree, (int, float)) else math.fsum(_weight(x) for x in tree.values())


def _winner(key: Column, names: Column, weights: Column) -> Column:
    """Position (from 1) of the child with the smallest draw; u has 52 bits of a hash of the key and the child's name. Equal draws go to the first."""

    def draw(name: Column, weight: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, name), 12).cast("double")
        return F.when(weight > 0, -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / weight).otherwise(F.lit(math.inf))

    draws = F.zip_with(names, weights, draw)
    return F.array_position(draws, F.array_min(draws)).cast("int")


def with_shard(df: DataFrame, key: Column, topology: Topology, into: str) -> DataFrame:
    """df with its key's shard, found level by level; the tree is a literal of a size set by the topology."""
    tree = topology.regions
    racks = [list(x) for x in tree.values()]
    rack_weights = [[_weight(x) for x in racks.values()] for racks in tree.values()]
    shards = [[list(x) for x in racks.values()] for racks in tree.values()]
    shard_weights = [[[float(w) for w in x.values()] for x in racks.values()] for racks in tree.values()]
    region, rack = free_name(df, f"{into}_region"), free_name(df, f"{into}_rack")
    out = df.withColumn(region, _winner(key, F.lit(list(tree)), F.lit([_weight(x) for x in tree.values()])))
    at = lambda x: F.element_at(F.lit(x), F.col(region))
    out = out.withColumn(rack, _winner(key, at(racks), at(rack_weights)))
    ids, weights = F.element_at(at(shards), F.col(rack)), F.element_at(at(shard_weights), F.col(rack))
    names = F.transform(ids, lambda s: F.concat(F.lit("shard"), s.cast("string")))
    return out.withColumn(into, F.element_at(ids, _winner(key, names, weights)).cast("int")).drop(region, rack)


def assign_shards(docs: DataFrame, topology: Topology, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard.

    The text is read once and not shuffled. Slots: rows are numbered inside (shard, bucket) and moved up by the rows of earlier
    buckets, so no task holds a whole shard; the offsets are shards x buckets rows, a bound set by parameters.
    """
    spark = docs.sparkSession
    buckets = buckets or max(8, shuffle_width(spark))
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    part = F.spark_partition_id()
    rows = rows.select(
        "*",
        F.lit("key").alias("law"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size", part), F.lit(buckets)).cast("int").alias("bucket"),
    )
    for into, tree in (("shard", topology), ("grown_shard", topology.grow())):
        rows = with_shard(rows, F.col("doc_id"), tree, into)
    rows = stash(rows, "shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(within))
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, topology: Topology, *, id_col: str = "doc_id") -> None:
    """docs as Parquet files in folders shard=N; each task writes its own rows, so a large shard has many files."""
    with_shard(docs, F.col(id_col), topology, "shard").write.partitionBy("shard").parquet(path)
