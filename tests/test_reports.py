"""Whole assessments against whole arrays, and tiles of several images."""

import numpy as np
from pyspark.sql import functions as F

from pixelweave.operators import blocks, reports, tiling
from tests.test_blending import pixel_rows
from tests.test_spectrum_and_edges import whole_canny


def test_report(spark):
    rng = np.random.default_rng(5)
    yy, xx = np.mgrid[:53, :64]
    wave = np.floor(128 + 60 * np.sin(yy / 6) * np.cos(xx / 8))
    images = {"fine": [wave, wave + rng.integers(-1, 2, wave.shape)], "rough": [wave, np.clip(wave + rng.integers(-60, 61, wave.shape), 0, 255)], "same": [wave, wave], "tiny": [np.full((3, 3), 5.0)] * 2}
    made = blocks.to_blocks(pixel_rows(spark, images, ["g", "h"]), ("g", "h"), 16)
    rows = {r.image_id: r for r in reports.report(made, 16).collect()}
    assert len(rows) == 4
    for name, (a, b) in images.items():
        r, (h, w) = rows[name], b.shape
        mse = ((a - b) ** 2).mean()
        assert r.psnr == np.inf if mse == 0 else abs(r.psnr - 10 * np.log10(255**2 / mse)) < 1e-9
        far = np.sqrt((np.arange(h)[:, None] - h // 2) ** 2 + (np.arange(w) - w // 2) ** 2) > min(h, w) // 4
        f = np.abs(np.fft.fftshift(np.fft.fft2(b)))
        assert abs(r.hf_ratio - f[far].sum() / (f.sum() + 1e-10)) < 1e-9
        assert abs(r.oversharpen_score - max(0, 100 - len(whole_canny(b, 50, 150)) / b.size * 500)) < 1e-9
        cells = [b[y : y + 8, x : x + 8].var() for y in range(0, h - 8, 8) for x in range(0, w - 8, 8)]
        assert abs(r.artifact_score - (max(0, 100 - np.var(cells) / 100) if len(cells) > 1 else 100)) < 1e-6
        if h >= 4:
            means = [b[i * (h // 4) : (i + 1) * (h // 4), j * (w // 4) : (j + 1) * (w // 4)].mean() for i in range(4) for j in range(4)]
            assert abs(r.brightness_uniformity - max(0, 100 - np.std(means))) < 1e-9
        else:
            assert r.brightness_uniformity is None and r.ssim is None
        own = [min(100, max(0, r.psnr))] + ([r.ms_ssim * 100] if r.ms_ssim is not None else [])
        assert abs(r.overall - np.mean(own)) < 1e-9
        ad = np.mean([min(100, r.sharpness / 10), min(100, r.hf_ratio * 500), r.oversharpen_score, r.artifact_score])
        assert abs(r.commercial_score - ad) < 1e-9
    assert (rows["fine"].psnr_level, rows["rough"].psnr_level, rows["rough"].ssim_level) == ("excellent", "poor", "poor")
    lines = {r.image_id: r.report.split("\n") for r in reports.text(reports.report(made, 16)).collect()}
    assert len(lines["fine"]) == 14 and any(x.startswith("psnr ") and x.endswith("excellent") for x in lines["fine"])
    assert not any(x.startswith("ssim") for x in lines["tiny"])


def test_tiles_meet_their_own_image(spark):
    sizes = spark.createDataFrame([("a", 30, 20), ("b", 50, 10)], "image_id string, width int, height int")
    tiles = tiling.tile_grid(sizes, 16, 0.2)
    px = sizes.select("image_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "width").select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    want = tiles.agg(F.sum(F.col("w") * F.col("h"))).first()[0]
    assert tiling.in_tiles(px, tiles, 8).count() == want
