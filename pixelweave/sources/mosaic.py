"""Pixel relations (image_id, y, x, g): from the image source, and a mosaic made of a table of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, y, x, r, g, b) of the images under ``path``; the source's bytes are BGR, row by row."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").where("nChannels = 3")
    rows = images.select(F.md5("data").alias("image_id"), "width", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    px = rows.select("image_id", "y", "width", "data", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    byte = lambda k: F.conv(F.hex(F.substring("data", (F.col("y") * F.col("width") + F.col("x")) * 3 + k + 1, F.lit(1))), 16, 10).cast("int")
    return px.select("image_id", "y", "x", byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def mosaic(vectors: DataFrame, across: int = 25) -> DataFrame:
    """(vec_id, y, x, g): each 64-vector is an 8x8 tile of gray values, ``across`` tiles to a row."""
    px = vectors.select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return px.select(
        "vec_id",
        (F.floor(F.col("vec_id") / across) * 8 + F.floor(F.col("p") / 8)).cast("int").alias("y"),
        (F.col("vec_id") % across * 8 + F.col("p") % 8).cast("int").alias("x"),
        F.floor((F.col("v").cast("double") + 1) * 127.5).cast("int").alias("g"),
    )


def colored(px: DataFrame) -> DataFrame:
    return px.select("*", F.col("g").alias("red"), ((F.col("g") * 3 + F.col("x")) % 256).alias("green"), ((F.col("g") * 5 + F.col("y")) % 256).alias("blue"))


def jittered(px: DataFrame) -> DataFrame:
    """The mosaic's places with their value (g) and that with a fixed jitter (h)."""
    return px.select("y", "x", "g", (F.col("g") + (F.col("x") * 7 + F.col("y") * 3) % 5 - 2).alias("h"))


def degraded(px: DataFrame) -> DataFrame:
    """The mosaic with a fixed jitter, for comparisons."""
    return jittered(px).select("y", "x", "h")
