"""Overlapping tile grids and the relations between tiles.

Tiles are joined by merging: they are made from few bytes of images, so Spark takes them for small and would gather them on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import blocks as B


def tile_grid(sizes: DataFrame, block: int = 1024, ratio: float = 0.2) -> DataFrame:
    """(image_id, tile_row, tile_col, x, y, w, h and the overlap with each side) for ``sizes`` (image_id, width, height)."""
    if not 0.1 <= ratio <= 0.3:
        raise ValueError("the overlap ratio must be from 0.1 to 0.3")
    lap = int(block * ratio)
    step = block - lap
    steps = lambda c: F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil((F.col(c) - lap) / step)).cast("int") - 1)
    at = sizes.withColumn("tile_row", F.explode(steps("height"))).withColumn("tile_col", F.explode(steps("width")))
    at = at.withColumn("x", F.col("tile_col") * step).withColumn("y", F.col("tile_row") * step)
    at = at.withColumn("w", F.least(F.lit(block), F.col("width") - F.col("x"))).withColumn("h", F.least(F.lit(block), F.col("height") - F.col("y")))
    near = lambda p: F.when(F.col(p) > 0, lap).otherwise(0)
    far = lambda p, s, full: F.when(F.col(p) + F.col(s) < F.col(full), lap).otherwise(F.greatest(F.lit(0), F.lit(block) - (F.col(full) - F.col(p)) - near(p)))
    return at.select(
        "image_id", "tile_row", "tile_col", "x", "y", "w", "h", near("y").alias("overlap_top"), far("y", "h", "height").alias("overlap_bottom"),
        near("x").alias("overlap_left"), far("x", "w", "width").alias("overlap_right"),
    )


def moved(tiles: DataFrame, places: DataFrame) -> DataFrame:
    """``tiles`` with x and y of ``places`` (image_id, tile_row, tile_col, x, y) where it has the tile."""
    keys = ["image_id", "tile_row", "tile_col"]
    to = places.select(*keys, F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    at = tiles.join(to, keys, "left")
    return at.withColumns({"x": F.coalesce("to_x", "x"), "y": F.coalesce("to_y", "y")}).select(*tiles.columns)


def neighbors(tiles: DataFrame) -> DataFrame:
    """(image_id, tile_row, tile_col, side, n_row, n_col): an equi-join on shifted grid places, one row for each side that has a tile."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), (F.col("tile_row") + r).alias("n_row"), (F.col("tile_col") + c).alias("n_col")) for s, r, c in (("top", -1, 0), ("bottom", 1, 0), ("left", 0, -1), ("right", 0, 1))])
    there = tiles.select("image_id", F.col("tile_row").alias("n_row"), F.col("tile_col").alias("n_col"))
    return tiles.select("image_id", "tile_row", "tile_col", F.inline(sides)).join(there.hint("merge"), ["image_id", "n_row", "n_col"]).select("image_id", "tile_row", "tile_col", "side", "n_row", "n_col")


def overlap_regions(tiles: DataFrame) -> DataFrame:
    """The rectangles in which adjacent tiles overlap: joined on grid places, not by comparing all pairs."""
    a = tiles.select("image_id", *[F.col(c).alias(f"{c}1") for c in ("tile_row", "tile_col", "x", "y", "w", "h")])
    b = tiles.select("image_id", *[F.col(c).alias(f"{c}2") for c in ("tile_row", "tile_col", "x", "y", "w", "h")])
    steps = F.array(F.struct(F.col("tile_row1").alias("tile_row2"), (F.col("tile_col1") + 1).alias("tile_col2"), F.lit("horizontal").alias("direction")), F.struct((F.col("tile_row1") + 1).alias("tile_row2"), F.col("tile_col1").alias("tile_col2"), F.lit("vertical").alias("direction")))
    both = a.select("*", F.inline(steps)).join(b.hint("merge"), ["image_id", "tile_row2", "tile_col2"])
    left, top = F.greatest("x1", "x2"), F.greatest("y1", "y2")
    w, h = F.least(F.expr("x1 + w1"), F.expr("x2 + w2")) - left, F.least(F.expr("y1 + h1"), F.expr("y2 + h2")) - top
    return both.select("image_id", "tile_row1", "tile_col1", "tile_row2", "tile_col2", "direction", left.alias("x"), top.alias("y"), w.alias("width"), h.alias("height")).where("width > 0 and height > 0")


def in_tiles(px: DataFrame, tiles: DataFrame, cell: int = 64) -> DataFrame:
    """Pixels with each tile that covers them: tiles are dealt to grid cells, so the join is on the cell.

    Where pixels tell their image (image_id), they meet that image's tiles only.
    """
    span = lambda p, s: F.sequence(F.floor(F.col(p) / cell), F.floor((F.col(p) + F.col(s) - 1) / cell))
    cells = tiles.select("*", F.explode(span("y", "h")).alias("cell_y")).select("*", F.explode(span("x", "w")).alias("cell_x"))
    cells = cells.withColumnRenamed("x", "tile_x").withColumnRenamed("y", "tile_y")
    px = px.withColumn("cell_y", F.floor(F.col("y") / cell)).withColumn("cell_x", F.floor(F.col("x") / cell))
    inside = "x >= tile_x and x < tile_x + w and y >= tile_y and y < tile_y + h"
    return px.join(cells, [*(["image_id"] if "image_id" in px.columns else []), "cell_y", "cell_x"]).where(inside)


def complexity(px: DataFrame, tile: str) -> DataFrame:
    return px.groupBy(tile).agg(F.stddev_pop("g").alias("complexity"))


def entropy(px: DataFrame, tile: str) -> DataFrame:
    """Shannon entropy of each tile's values."""
    counts = px.groupBy(tile, "g").agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("total")
    total = px.groupBy(tile).agg(F.count("*").alias("total"))
    return counts.join(total, tile).groupBy(tile).agg((-F.sum(share * F.log2(share + 1e-10))).alias("entropy"))


def proximity(tiles: DataFrame, block: int) -> DataFrame:
    """(image_id, tile1, tile2) of an image's tiles whose places differ by at most ``block`` both ways: each tile meets the nine cells around its own."""
    near = lambda c: F.sequence(F.floor(F.col(c) / block) - 1, F.floor(F.col(c) / block) + 1)
    a = tiles.select("image_id", F.col("tile_id").alias("tile1"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.explode(near("x")).alias("cx"), "y")
    a = a.select("image_id", "tile1", "x1", "y1", "cx", F.explode(near("y")).alias("cy"))
    b = tiles.select("image_id", F.col("tile_id").alias("tile2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.floor(F.col("x") / block).alias("cx"), F.floor(F.col("y") / block).alias("cy"))
    close = f"tile1 <> tile2 and abs(x1 - x2) <= {block} and abs(y1 - y2) <= {block}"
    return a.join(b.hint("merge"), ["image_id", "cx", "cy"]).where(close).select("image_id", "tile1", "tile2")


def filled(px: DataFrame) -> DataFrame:
    """(y, x, g) of every place of an image as far as its last row and column; places without a pixel are 0."""
    whole = B.to_pixels(B.mapped_values(B.one_image(px), lambda v: np.where(np.isnan(v), 0.0, v)))
    return whole.select("y", "x", F.col("value").cast(px.schema["g"].dataType).alias("g"))


def pad(px: DataFrame, bottom: int, right: int, mode: str = "mirror") -> DataFrame:
    """(y, x, g) with rows below and columns to the right: mirror (the border once), reflect (twice), replicate or constant 0.

    A pixel is sent to the places that show it, so nothing is joined but the image's size, one row; added parts must be smaller than
    the image. Places of the image without a pixel are 0, and are shown as such.
    """

    def places(c: str, n: str, more: int) -> Column:
        p, n = F.col(c), F.col(n)
        if mode in ("replicate", "constant"):
            shown = F.when(p == n - 1, F.sequence(n - 1, n - 1 + more))
        else:
            far = (2 * (n - 1) if mode == "mirror" else 2 * n - 1) - p
            shown = F.when((far >= n) & (far < n + more), F.array(p, far))
        return F.explode(F.coalesce(shown, F.array(p)))

    size = px.agg((F.max("y") + 1).alias("hh"), (F.max("x") + 1).alias("ww"))
    out = filled(px).join(F.broadcast(size)).select(places("y", "hh", bottom).alias("y"), "x", "g", "hh", "ww").select("y", places("x", "ww", right).alias("x"), "g", "hh", "ww")
    if mode == "constant":
        out = out.withColumn("g", F.when((F.col("y") >= F.col("hh")) | (F.col("x") >= F.col("ww")), 0).otherwise(F.col("g")))
    return out.select("y", "x", "g")
