"""What must not grow with the table: what is sent to the driver, and how often a pixel is sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import blending, blocks, quality, reports
from pixelweave.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tile_neighbors", "overlap_regions", "proximity_neighbors"])
def test_tiles_are_not_gathered_on_the_driver(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_equal_rectangles_are_measured_once(spark):
    px = spark.range(30 * 40).select(F.floor(F.col("id") / 40).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"), (F.col("id") * 7 % 251).cast("int").alias("g"))
    rois = spark.range(3000).selectExpr("id as roi_id", "cast(id % 3 * 9 as int) as x0", "cast(id % 2 * 20 as int) as y0", "cast(18 + id % 2 as int) as w", "cast(id % 3 as int) * 7 as h")
    assert quality.in_rectangles(px, rois).count() == 18 * 7 + 18 * 14 + 19 * 7 * 1 + 19 * 10  # four that have pixels; the last one is cut off by the image
    got = {r.roi_id: r for r in quality.roi_moments(px, rois).collect()}
    g = (np.arange(1200) * 7 % 251).reshape(30, 40)
    for k in range(3000):
        v = g[k % 2 * 20 :, k % 3 * 9 :][: k % 3 * 7, : 18 + k % 2]
        assert (k in got) == (v.size > 0)
        if v.size:
            assert got[k].n == v.size and got[k]["mean"] == pytest.approx(v.mean()) and got[k].contrast == pytest.approx(v.std())


def test_stencils_send_borders_only(spark):
    """Of one image's stencils no join holds a row for each value under the kernel."""
    for name in ("texture_score", "sharpness", "noise_level", "pyramid_down"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate inline" not in plan and "mapInPandas" in plan.replace("MapInPandas", "mapInPandas").replace("MapInArrow", "mapInPandas")


def test_a_report_makes_its_blocks_once(spark):
    px = spark.range(40 * 30).select(F.lit("a").alias("image_id"), F.floor(F.col("id") / 30).cast("int").alias("y"), (F.col("id") % 30).cast("int").alias("x"), (F.col("id") * 7 % 251).alias("g"), (F.col("id") * 5 % 241).alias("h"))
    plan = reports.report(blocks.to_blocks(px, ("g", "h"), 16), 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "FlatMapGroupsInPandas" not in plan  # a written stage is read; no step holds a group, or a batch of it, as a frame


def test_small_images_are_cloned_and_repaired_in_one_pass(spark, monkeypatch):
    """And as larger ones are, in many squares and by rounds."""
    px = spark.range(40 * 52).select(F.lit("a").alias("image_id"), F.floor(F.col("id") / 52).cast("int").alias("y"), (F.col("id") % 52).cast("int").alias("x"), (F.col("id") * 7 % 251).alias("t"), (F.col("id") * 5 % 241).alias("s"))
    px = px.withColumn("m", ((F.col("y") > 3) & (F.col("y") < 33) & (F.col("x") > 2) & (F.col("x") < 47)).cast("int")).where("not (y = 20 and x between 20 and 22)")
    made = blocks.to_blocks(px, ("t", "s", "m"), 16)
    values = lambda df: df.orderBy("plane", "by", "bx").toPandas()
    whole, rounds = blending.poisson_clone(made, "mixed", 1e-5, block=16)
    assert rounds == 1
    parts, rounds = blending.poisson_clone(made, "mixed", 1e-5, block=16, side=32)
    assert rounds > 1
    for a, b in zip(values(whole).itertuples(), values(parts).itertuples(), strict=True):
        assert (a.by, a.bx, a.h, a.w, a.height, a.width) == (b.by, b.bx, b.h, b.w, b.height, b.width)
        np.testing.assert_allclose(np.frombuffer(a.data), np.frombuffer(b.data), atol=1e-3)
    seams = spark.range(30).selectExpr("'a' as image_id", "id as place", "cast(id * 11 % 50 as int) as x", "cast(id * 7 % 38 as int) as y", "cast(3 + id % 5 as int) as width", "4 as height", "'increase_blend_width' as fix")
    rounds = []
    monkeypatch.setattr(blending, "conflicts", lambda *at, made=blending.conflicts: rounds.append(1) or made(*at))
    once = values(blending.repaired(made, seams, 16))
    assert not rounds
    assert values(blending.repaired(made, seams, 16, at_once=0)).equals(once) and rounds
