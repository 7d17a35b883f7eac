"""Column statistics and exhaustive split searches over whole tables, as aggregations and windows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def raw_kurtosis(col: str) -> Column:
    """n M4 / M2^2; Spark's own is 3 less."""
    return F.kurtosis(col) + F.lit(3.0)


def expected_level_sd(df: DataFrame, col: str) -> DataFrame:
    """Standard deviation expected of a categorical column whose levels take values from U(0, 1): one row, expected_sd."""
    p = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = p.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"))
    share = F.col("q") / (F.col("t") * F.col("t"))
    return sums.select(F.sqrt(F.greatest(F.lit(0.0), (F.lit(1.0) - share) / 3 - (F.lit(1.0) - share) / 4)).alias("expected_sd"))


def split_gains(df: DataFrame, col: str, parts: int = 256) -> DataFrame:
    """Every cut of a numeric column: value, n_left, n_right, pooled and averaged gain, density gain.

    Rows are first summed by distinct value. The distinct values are dealt by range, at approximate quantiles, into at most `parts`
    ranges of about equal size; running sums go over one range each, and start from the sums of the ranges before it. Only those, a
    row per range, meet in one task. Without values there are no cuts.
    """
    x = F.col(col).cast("double")
    by = df.where(x.isNotNull()).groupBy(x.alias("value")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    edges = F.percentile_approx("value", [i / parts for i in range(1, parts)], 100 * parts).alias("edges")
    # One row to the driver, so that the ranges are the same wherever they are read, also when a lost task runs again.
    total = by.agg(F.sum("n").alias("tn"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"), edges).first()
    c = F.col("value") - F.lit(total["mean"])
    one = df.sparkSession.createDataFrame([(total["tn"], total["lo"], total["hi"], total["edges"])], "tn double, lo double, hi double, edges array<double>")
    part = F.size(F.filter("edges", lambda e: e < F.col("value")))
    rows = by.crossJoin(F.broadcast(one)).select("value", "n", "tn", "lo", "hi", (F.col("n") * c).alias("s1"), (F.col("n") * c * c).alias("s2"), part.alias("part"))
    ranges = rows.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("s1").alias("p1"), F.sum("s2").alias("p2"), F.min("value").alias("first"))
    in_order = Window.orderBy("part")
    before, all_ = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "part", *[F.coalesce(F.sum(p).over(before), F.lit(0.0)).alias(b) for p, b in (("pn", "bn"), ("p1", "b1"), ("p2", "b2"))], F.lead("first").over(in_order).alias("beyond"),
        F.sum("p1").over(all_).alias("t1"), F.sum("p2").over(all_).alias("t2"),
    )
    inside = Window.partitionBy("part").orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("part", "value", "tn", "lo", "hi", F.lead("value").over(inside).alias("near"), F.sum("n").over(upto).alias("n"), F.sum("s1").over(upto).alias("s1"), F.sum("s2").over(upto).alias("s2"))
    rows = rows.join(F.broadcast(ranges), "part").select(  # at most `parts` rows
        "value", "tn", "lo", "hi", F.coalesce("near", "beyond").alias("next"), (F.col("n") + F.col("bn")).alias("nl"), (F.col("s1") + F.col("b1")).alias("a1"), (F.col("s2") + F.col("b2")).alias("a2"), "t1", "t2",
    ).where("next is not null")
    sd = lambda n, s1, s2: F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s1 / n) * (s1 / n)))
    nl, nr = F.col("nl"), F.col("tn") - F.col("nl")
    sl, sr = sd(nl, F.col("a1"), F.col("a2")), sd(nr, F.col("t1") - F.col("a1"), F.col("t2") - F.col("a2"))
    whole = sd(F.col("tn"), F.col("t1"), F.col("t2"))
    cut = F.col("value") + (F.col("next") - F.col("value")) / 2
    rl = (cut - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return rows.select(
        cut.alias("cut"), nl.alias("n_left"), nr.alias("n_right"),
        (1 - (nl * sl + nr * sr) / (F.col("tn") * whole)).alias("pooled_gain"), (1 - (sl + sr) / (2 * whole)).alias("avg_gain"),
        ((nl / F.col("tn")) * (nl / F.col("tn")) / rl + (nr / F.col("tn")) * (nr / F.col("tn")) / (1 - rl) - 1).alias("dens_gain"),
    )
