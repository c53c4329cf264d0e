"""Whole assessments of images in blocks: one row for each image, with every metric, its level and the scores made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import blocks as B
from pixelweave.operators.blocks import BLOCK
from pixelweave.operators.edges import oversharpened
from pixelweave.operators.quality import commercial
from pixelweave.operators.spectrum import high_frequency_ratio
from pixelweave.staging import staged

#: Where a metric's levels end (excellent, good, fair), and whether more is better.
LEVELS = {
    "psnr": (40.0, 35.0, 30.0, True), "ssim": (0.98, 0.95, 0.9, True), "ms_ssim": (0.98, 0.95, 0.9, True), "lpips": (0.02, 0.05, 0.1, False),
    "niqe": (3.0, 5.0, 8.0, False), "brisque": (20.0, 35.0, 50.0, False), "delta_e": (1.0, 3.0, 5.0, False),
}
NAMES = ("excellent", "good", "fair")


def level(metric: str, value: Column | None = None) -> Column:
    """The level of a metric's value; null where there is none."""
    value = F.col(metric) if value is None else value
    *cuts, rising = LEVELS[metric]
    out = F.when(value.isNull(), None)
    for cut, name in zip(cuts, NAMES, strict=True):
        out = out.when(value >= cut if rising else value <= cut, name)
    return out.otherwise("poor")


def artifacts(blocks: DataFrame, block: int = BLOCK, cell: int = 8) -> DataFrame:
    """(image_id, artifact_score) of plane 0: 100 less the variance of its cells' variances over 100, at least 0.

    Cells that don't end before the last row and column don't count; with one or none the score is 100. ``block`` is a multiple of ``cell``.
    """
    if block % cell:
        raise ValueError("blocks must hold whole cells")

    def spread(areas, y, x, h, w):
        a = areas[0].kept(areas[0].around(y, x, h, w, 0), y, x)
        ny, nx = (sum(1 for k in range(o, o + n, cell) if k < full - cell) for o, n, full in ((y, h, areas[0].height), (x, w, areas[0].width)))
        cells = a[: ny * cell, : nx * cell].reshape(ny, cell, nx, cell).transpose(0, 2, 1, 3).reshape(ny * nx, cell * cell)
        return {"cells": np.nanvar(cells[~np.isnan(cells).all(1)], 1)}  # of the pixels that are there

    sums = B.summed(blocks, spread, 0, block)
    variance = F.greatest(F.lit(0.0), F.col("square") / F.col("n") - F.pow(F.col("total") / F.col("n"), 2))
    return sums.select("image_id", F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 100 - variance / 100)).otherwise(100.0).alias("artifact_score"))


def uniformity(blocks: DataFrame, block: int = BLOCK, regions: int = 4) -> DataFrame:
    """(image_id, brightness_uniformity) of plane 0: 100 less the deviation of the means of 4 x 4 regions, at least 0; null where a region would be empty."""

    def parts(areas, image_id, y, x, h, w):
        a, tall, wide = areas[0].around(y, x, h, w, 0), areas[0].height // regions, areas[0].width // regions
        a = areas[0].kept(a, y, x)
        ys, xs = (np.arange(o, o + n) // max(1, size) for o, n, size in ((y, h, tall), (x, w, wide)))
        rows = []
        for i in np.unique(ys[ys < regions]):
            for j in np.unique(xs[xs < regions]):
                v = a[np.ix_(ys == i, xs == j)]
                v = v[~np.isnan(v)]
                rows.append((image_id, int(i), int(j), v.size, float(v.sum())))
        return pd.DataFrame(rows, columns=["image_id", "i", "j", "n", "total"])

    sums = B.gather(blocks, parts, "image_id string, i int, j int, n long, total double", B.halo(0), block=block)
    means = sums.where("n > 0").groupBy("image_id", "i", "j").agg((F.sum("total") / F.sum("n")).alias("mean"))
    whole = B.sizes(blocks).where(f"height >= {regions} and width >= {regions}").select("image_id")
    return means.join(whole, "image_id", "left_semi").groupBy("image_id").agg(F.greatest(F.lit(0.0), 100 - F.stddev_pop("mean")).alias("brightness_uniformity"))


def report(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each image of plane 0 (original) and plane 1 (result): what the result is worth against the original, by itself, and as an advertisement.

    Against the original: psnr, ssim, ms_ssim with levels, and overall, their mean (psnr cut to 0..100, ms_ssim times 100). By itself: niqe and
    brisque with levels, sharpness, contrast, noise. As an advertisement: hf_ratio, oversharpen_score, artifact_score,
    brightness_uniformity and commercial_score. Metrics that an image is too small for are null and count in no score. Every
    metric is sums by block; only a row for each image is joined. The blocks are a written stage, so they are made once, not for each metric.
    An empty table gives no rows.
    """
    blocks = staged(blocks, "report")
    result = blocks.where("plane = 1").withColumn("plane", F.lit(0))
    full = B.full_reference(blocks, block)
    parts = [B.no_reference(result, block), high_frequency_ratio(result, block), oversharpened(result, block=block), artifacts(result, block), uniformity(result, block)]
    out = B.sizes(blocks).select("image_id").join(full, "image_id", "left")
    for part in parts:
        out = out.join(part, "image_id", "left")
    scores = F.array_compact(F.array(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("psnr"))), F.col("ms_ssim") * 100))
    overall = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.0)
    ad = commercial(F.col("sharpness"), F.col("hf_ratio"), F.col("oversharpen_score"), F.col("artifact_score"))
    return out.select(
        "image_id", *[c for m in ("psnr", "ssim", "ms_ssim") for c in (F.col(m), level(m).alias(f"{m}_level"))], overall.alias("overall"),
        *[c for m in ("niqe", "brisque") for c in (F.col(m), level(m).alias(f"{m}_level"))], "sharpness", "contrast", "noise", "hf_ratio", "oversharpen_score", "artifact_score",
        "brightness_uniformity", ad.alias("commercial_score"),
    )


def long_form(reports: DataFrame) -> DataFrame:
    """(image_id, metric, value, level) of ``report``'s rows; metrics without levels have none."""
    metrics = [c for c in reports.columns if c != "image_id" and not c.endswith("_level")]
    lines = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), (F.col(f"{m}_level") if m in LEVELS else F.lit(None).cast("string")).alias("level")) for m in metrics])
    return reports.select("image_id", F.inline(lines)).where("value is not null")


def text(reports: DataFrame) -> DataFrame:
    """(image_id, report): a line for each metric, with its level where it has one."""
    line = F.concat(F.rpad("metric", 24, " "), F.format_number("value", 4), F.coalesce(F.concat(F.lit("  "), "level"), F.lit("")))
    lines = long_form(reports).groupBy("image_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return lines.select("image_id", F.array_join("lines", "\n").alias("report"))
