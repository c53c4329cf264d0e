"""Seams: windows of low likeness, chained to seams; histogram and mean/deviation colour matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity(score: Column) -> Column:
    return F.when(score < 0.85, "high").when(score < 0.92, "medium").otherwise("low")


def chain(seams: DataFrame, distance: float = 16.0, window: int = 16) -> DataFrame:
    """Seams in order of (y, x) join the one before unless it is ``distance`` away; ``seams``: image_id, wy, wx, score."""
    order = Window.partitionBy("image_id").orderBy("wy", "wx")
    gap = F.sqrt(F.pow(F.col("wy") - F.lag("wy").over(order), 2) + F.pow(F.col("wx") - F.lag("wx").over(order), 2))
    grouped = seams.withColumn("new", F.when(gap < distance, 0).otherwise(1)).withColumn("seam", F.sum("new").over(order))
    out = grouped.groupBy("image_id", "seam").agg(
        F.min("wx").alias("x"), F.min("wy").alias("y"), (F.max("wx") - F.min("wx") + window).alias("width"),
        (F.max("wy") - F.min("wy") + window).alias("height"), F.avg("score").alias("score"), F.count("*").alias("n_windows"),
    )
    return out.withColumn("severity", severity(F.col("score")))


def cdf(px: DataFrame, value: str) -> DataFrame:
    """(level, share): the cumulative histogram over levels 0 to 255."""
    levels = px.sparkSession.range(256).select(F.col("id").cast("int").alias("level"))
    counts = px.groupBy(F.col(value).alias("level")).agg(F.count("*").alias("n"))
    order = Window.orderBy("level")  # 256 rows
    n = F.coalesce("n", F.lit(0))
    return levels.join(F.broadcast(counts), "level", "left").select("level", (F.sum(n).over(order) / F.sum(n).over(Window.partitionBy())).alias("share"))


def histogram_match(source: DataFrame, target: DataFrame) -> DataFrame:
    """(level, mapped): for each source level the target level of nearest cumulative share, the lowest where several are."""
    a, b = source.withColumnRenamed("share", "s"), target.select(F.col("level").alias("to"), F.col("share").alias("t"))
    return a.join(F.broadcast(b)).groupBy("level").agg(F.min(F.struct(F.round(F.abs(F.col("s") - F.col("t")), 9), "to"))["to"].alias("mapped"))  # 256 x 256 levels


def mean_std_match(px: DataFrame, other: DataFrame) -> DataFrame:
    """``px`` with its values moved to the mean and deviation of ``other``."""
    a = px.agg(F.avg("g").alias("ma"), F.stddev_pop("g").alias("sa"))
    b = other.agg(F.avg("h").alias("mb"), F.stddev_pop("h").alias("sb"))
    value = (F.col("g") - F.col("ma")) * F.col("sb") / (F.col("sa") + 1e-6) + F.col("mb")
    return px.join(F.broadcast(a)).join(F.broadcast(b)).select("y", "x", F.greatest(F.lit(0.0), F.least(F.lit(255.0), value)).alias("value"))  # one-row sides


def fix(score: Column) -> Column:
    """What is suggested for a seam of this likeness."""
    return F.when(score < 0.85, "poisson_refinement").when(score < 0.92, "increase_blend_width").otherwise("none")


def apply_levels(px: DataFrame, mapped: DataFrame, value: str = "g") -> DataFrame:
    """``px`` with ``value`` as ``mapped`` (level, mapped; 256 rows at most) gives it, in a column of that name."""
    return px.join(F.broadcast(mapped), F.col(value) == F.col("level")).drop("level")
