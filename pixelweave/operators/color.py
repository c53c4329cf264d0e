"""Colour spaces as column expressions in 8-bit units, and metrics of them over pixel relations (red, green, blue)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sRGB to XYZ, each row over the white point's component (0.950456, 1, 1.088754).
XYZ = ((0.412453, 0.357580, 0.180423, 0.950456), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.088754))


def lab(red: Column, green: Column, blue: Column) -> Column:
    """Struct (l, a, b): lightness times 255/100, a and b shifted by 128, rounded."""
    linear = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (red, green, blue)]
    x, y, z = ((linear[0] * r + linear[1] * g + linear[2] * b) / white for r, g, b, white in XYZ)
    root = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116)
    light = F.when(y > 0.008856, root(y) * 116.0 - 16).otherwise(y * 903.3)
    whole = lambda v: F.floor(v + 0.5)
    return F.struct(whole(light * 2.55).alias("l"), whole((root(x) - root(y)) * 500.0 + 128).alias("a"), whole((root(y) - root(z)) * 200.0 + 128).alias("b"))


def with_lab(px: DataFrame) -> DataFrame:
    return px.withColumn("lab", lab(F.col("red"), F.col("green"), F.col("blue"))).select("*", "lab.l", "lab.a", "lab.b").drop("lab")


def lab_stats(px: DataFrame) -> DataFrame:
    """One row: colourfulness, variance of lightness, and nearness of the mean colour to a skin tone."""
    away = F.sqrt(F.pow(F.avg("l") - 70, F.lit(2)) + F.pow(F.avg("a") - 15, F.lit(2)) + F.pow(F.avg("b") - 20, F.lit(2)))
    return with_lab(px).agg(
        F.sqrt(F.var_pop("a") + F.var_pop("b")).alias("colorfulness"), F.var_pop("l").alias("color_variance"), F.greatest(F.lit(0.0), 100 - away).alias("skin_tone"),
    )


def delta_e(px: DataFrame, reference: tuple[int, int, int]) -> DataFrame:
    """One row: distance of the mean colour, cut to whole levels, from a reference colour."""
    mean = px.agg(*[F.floor(F.avg(c)).alias(c) for c in ("red", "green", "blue")])
    both = mean.select(lab(F.col("red"), F.col("green"), F.col("blue")).alias("p"), lab(*map(F.lit, reference)).alias("q"))
    return both.select(F.sqrt(sum((F.pow(F.col(f"p.{c}") - F.col(f"q.{c}"), F.lit(2)) for c in ("l", "a", "b")), F.lit(0.0))).alias("delta_e"))


def face_naturalness(px: DataFrame) -> DataFrame:
    """One row: how near the share of skin-coloured pixels is to three in ten."""
    y = F.col("red") * 0.299 + F.col("green") * 0.587 + F.col("blue") * 0.114
    cr, cb = (F.col("red") - y) * 0.713 + 128, (F.col("blue") - y) * 0.564 + 128
    skin = cr.between(133, 173) & cb.between(77, 127)
    return px.agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.abs(F.avg(skin.cast("int")) - 0.3) * 100)).alias("naturalness"))
