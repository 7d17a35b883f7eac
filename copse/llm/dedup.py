"""Exact deduplication by 128-bit content hash with byte comparison inside the groups. DataFrame operations only.

Defined results: a null text counts as empty, so nulls and empty texts form one group. A null id sorts below every id and is
kept only where its whole group has none. Rows that repeat both id and text are counted, and one of them is kept. An empty
table gives an empty result. Extra columns are ignored by exact_groups and passed through by drop_copies, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import free_name, stash, whole_text


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _split_collisions(docs: DataFrame, keyed: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """keyed (h, sha, id, copies) with a variant number that tells different bytes under one hash apart.

    Grouping by (hash, text) compares the bytes natively, and map-side aggregation ships a text once per task, so a group of
    copies of any size meets as a few rows. Only where a hash really has several texts are its documents numbered by text.
    """
    texts = docs.select(digest(whole_text(text_col)).alias("h"), whole_text(text_col).alias("t")).groupBy("h", "t").agg(F.count(F.lit(1)).alias("rows"))
    collided = stash(texts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h"), "collided")
    if collided.isEmpty():
        return keyed.withColumn("variant", F.lit(""))
    variants = (
        docs.select(F.col(id_col).alias("id"), digest(whole_text(text_col)).alias("h"), whole_text(text_col).alias("variant"))
        .join(collided, "h", "left_semi")
        .withColumn("sha", F.sha2(F.col("variant").cast("binary"), 256))
        .withColumn("variant", F.concat(F.lit("="), F.col("variant")))
        .groupBy("h", "sha", "id", "variant")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    alone = keyed.join(collided, "h", "left_anti").withColumn("variant", F.lit(""))
    return alone.unionByName(variants)


def exact_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = md5_128
) -> DataFrame:
    """One row per distinct (id, text): id, h, variant, sha256, copies (rows alike), keep_id, group_size, keeper (its id stays).

    keep: "smallest" or "largest" id of a group. The id-level table and the group table are narrow (no text) and are written to
    the shared folder, so that the join back deals both sides by hash and a hot group's partition can be split at run time.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text = whole_text(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), digest(text).alias("h"), F.sha2(text.cast("binary"), 256).alias("sha"))
    keyed = keyed.groupBy("h", "sha", "id").agg(F.count(F.lit(1)).alias("copies"))
    keyed = stash(_split_collisions(docs, keyed, id_col, text_col, digest), "keyed")
    best = F.max("id") if keep == "largest" else F.min("id")
    groups = stash(keyed.groupBy("h", "variant").agg(best.alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return (
        keyed.join(groups, ["h", "variant"])
        .withColumn("keeper", F.col("id").eqNullSafe(F.col("keep_id")))
        .withColumnRenamed("sha", "sha256")
    )


def dedup_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = exact_groups(docs, **options)
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.withColumn("nth", nth).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("keeper") & (F.col("nth") == 1)).alias("kept"), F.col("sha256").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """docs without the copies: all columns of the rows that stay. Rows alike in id and text leave one row."""
    keepers = exact_groups(docs, id_col=id_col, text_col=text_col, keep=keep, digest=digest).where("keeper")
    h, id2, variant = (free_name(docs, x) for x in ("copse_h", "copse_id", "copse_variant"))
    again = not keepers.where("copies > 1").isEmpty()
    keepers = keepers.select(F.col("h").alias(h), F.col("id").alias(id2), F.col("variant").alias(variant))
    rows = docs.withColumn(h, digest(whole_text(text_col)))
    same = F.concat(F.lit("="), F.coalesce(rows[text_col].cast("string"), F.lit("")))
    on = (rows[h] == keepers[h]) & rows[id_col].eqNullSafe(keepers[id2]) & ((keepers[variant] == "") | (keepers[variant] == same))
    if not again:
        return rows.join(keepers, on, "left_semi").select(*docs.columns)
    kept = rows.join(keepers, on).select(*[rows[c] for c in docs.columns], rows[h], keepers[variant])
    return kept.dropDuplicates([id_col, h, variant]).select(*docs.columns)
