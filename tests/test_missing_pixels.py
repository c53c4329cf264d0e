"""Images some of whose pixels are missing: the registered queries against their SQL where vectors are missing, and the operators without SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import blending, blocks, reports, spectrum
from pixelweave.plans import queries
from pixelweave.plans.images import SIZE  # noqa: F401  (registers the queries)

VECTORS = "/root/testdata/sf0.001/embeddings.parquet"
CASES = {
    "a last band of one row and a part": "vec_id < 282",
    "holes, a tile without pixels": "vec_id < 400 and vec_id not in (0, 24, 60, 124, 127, 152, 177, 202) and not (vec_id between 131 and 139) and not (vec_id between 380 and 390)",
}
NAMES = [
    "image_metadata", "image_round_trip", "laplacian_collapse", "batch_psnr", "bicubic_down", "bicubic_up", "bilinear_resize", "feather_fusion", "gradient_fusion", "guided_filter",
    "high_frequency_ratio", "image_levels", "mask_blend", "no_reference", "oversharpen", "gaussian_pyramid_level", "ssim_7x7", "ssim_fallback", "seams_drawn", "pad_constant", "pad_mirror",
]


@pytest.fixture(scope="module", params=sorted(CASES))
def folder(request, tmp_path_factory):
    at = tmp_path_factory.mktemp("missing")
    duckdb.sql(f"copy (select * from '{VECTORS}' where {CASES[request.param]}) to '{at}/embeddings.parquet'")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), duck.execute(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if not (got[c].astype(str) == want[c].astype(str)).all():
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)


@pytest.mark.parametrize("name", ["laplacian_fusion", "multi_band_fusion", "seam_repair", "poisson_clone"])
def test_gives_the_pixels_there_are(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    n = duckdb.sql(f"select count(*) * 64 from '{folder}/embeddings.parquet'").fetchall()[0][0]
    key = "canvas" if name.endswith("fusion") else "image_id"
    assert len(got) == len(got.drop_duplicates([key, "y", "x"])) == n and not got["value"].isna().any()


def image(spark):
    rows = spark.range(40 * 30).select(F.lit("a").alias("image_id"), F.floor(F.col("id") / 30).cast("int").alias("y"), (F.col("id") % 30).cast("int").alias("x"), (F.col("id") * 7 % 251).alias("g"))
    return rows.where("not (y between 10 and 19 and x between 5 and 14)")


def test_operators_keep_missing_places_missing(spark):
    made = blocks.to_blocks(image(spark), ("g",), 16, (48, 48))
    assert made.count() == 9  # also those without pixels
    assert blocks.to_pixels(made, 16).count() == 1100
    assert blocks.to_pixels(spectrum.saliency(made, 16), 16).count() == 1100
    assert blocks.to_pixels(blending.running(made, 0, 16), 16).count() == 1100
    assert blocks.to_pixels(blocks.collapse(blocks.laplacian_levels(made, 3, 16), 16), 16).join(image(spark), ["y", "x"]).where("abs(value - g) < 1e-9").count() == 1100
    assert reports.uniformity(made, 16).first()["brightness_uniformity"] is not None
