"""Weighted fusion of overlapping tiles: sums of weighted values over sums of weights, by output pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators.quality import ssim
from pixelweave.operators.tiling import in_tiles


def ramp(i: Column, lap: Column) -> Column:
    return F.when(lap > 1, F.least(F.lit(1.0), i / (lap - 1))).otherwise(1.0)


def feather_weight() -> Column:
    """The product of linear ramps over a tile's inner overlaps."""
    i, j = F.col("y") - F.col("tile_y"), F.col("x") - F.col("tile_x")
    return (
        ramp(i, F.col("overlap_top")) * ramp(F.col("h") - 1 - i, F.col("overlap_bottom"))
        * ramp(j, F.col("overlap_left")) * ramp(F.col("w") - 1 - j, F.col("overlap_right"))
    )


def distance_weight(kind: str = "cosine") -> Column:
    """A function of the distance to the tile's edge, relative to an eighth of its shorter side."""
    i, j = F.col("y") - F.col("tile_y"), F.col("x") - F.col("tile_x")
    edge = F.least(i, j, F.col("h") - 1 - i, F.col("w") - 1 - j)
    d = F.least(F.lit(1.0), edge / F.greatest(F.lit(1), F.floor(F.least("h", "w") / 8)))
    if kind == "linear":
        return d
    return 0.5 * (1 - F.cos(d * F.lit(3.141592653589793))) if kind == "cosine" else 1 / (1 + F.exp(-10 * (d - 0.5)))


def fuse(px: DataFrame, tiles: DataFrame, weight: Column, value: Column | None = None) -> DataFrame:
    """(y, x, value) of ``px`` cut into ``tiles`` and fused again; ``value``: what a tile shows at a place, if not ``g``."""
    each = in_tiles(px, tiles).withColumns({"weight": weight, "shown": F.col("g") if value is None else value})
    return each.groupBy("y", "x").agg((F.sum(F.col("weight") * F.col("shown")) / F.greatest(F.sum("weight"), F.lit(1e-6))).alias("value"))


def running_sums(px: DataFrame) -> DataFrame:
    """``px`` with sums along its row and its column up to each place: a line of the image is a window's group."""
    across, down = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    return px.withColumn("across", F.sum("g").over(across)).withColumn("down", F.sum("g").over(down))


def to_levels(value: Column) -> Column:
    """A fused value cut to whole levels from 0 to 255."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))).cast("int")


def blend_quality(px: DataFrame, tiles: DataFrame, weight: Column, value: Column | None = None) -> DataFrame:
    """One row: mean, least and deviation over the tiles of the likeness (SSIM from moments) of a tile and what was fused at its place.

    The fused value comes from a window over a pixel's few tiles, so pixels are shuffled once to be fused and once to their tiles.
    """
    each = in_tiles(px, tiles).withColumns({"weight": weight, "shown": F.col("g") if value is None else value})
    here = Window.partitionBy("y", "x")
    fused = F.sum(F.col("weight") * F.col("shown")).over(here) / F.greatest(F.sum("weight").over(here), F.lit(1e-6))
    per = each.withColumn("fused", fused).groupBy("image_id", "tile_row", "tile_col").agg(ssim("fused", "shown").alias("score"))
    return per.agg(F.avg("score").alias("mean_ssim"), F.min("score").alias("min_ssim"), F.stddev_pop("score").alias("std_ssim"))
