"""Fusion and cloning on blocks against whole arrays."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import blending, blocks


def pixel_rows(spark, images, planes):
    rows = [(name, y, x, *[float(a[y, x]) for a in arrays]) for name, arrays in images.items() for y in range(arrays[0].shape[0]) for x in range(arrays[0].shape[1])]
    return spark.createDataFrame(rows, "image_id string, y int, x int, " + ", ".join(f"{p} double" for p in planes))


def back(df, block, shape):
    out = np.full(shape, np.nan)
    p = blocks.to_pixels(df, block).toPandas()
    out[p.y, p.x] = p.value
    return out


@pytest.mark.parametrize("axis", [0, 1])
def test_running_sums_cross_blocks(spark, axis):
    rng = np.random.default_rng(1)
    images = {"a": [rng.normal(size=(37, 50))], "b": [rng.normal(size=(5, 90))]}
    made = blending.running(blocks.to_blocks(pixel_rows(spark, images, ["g"]), block=16), axis, 16)
    for name, (a,) in images.items():
        assert np.abs(back(made.where(F.col("image_id") == name), 16, a.shape) - np.cumsum(a, axis)).max() < 1e-9


def test_distances(spark):
    rng = np.random.default_rng(2)
    mask = (rng.random((30, 41)) > 0.02).astype(float)
    padded = np.pad(mask, 9)
    ys, xs = np.nonzero(padded == 0)
    want = np.array([[min(9.0, np.sqrt(((ys - y - 9) ** 2 + (xs - x - 9) ** 2).min())) for x in range(41)] for y in range(30)])
    assert np.abs(blending.distance_to_zero(padded, 9) - want).max() < 1e-12


def dense(t, s, m, mode):
    """The clone by one system of linear equations."""
    h, w = t.shape
    free = [(y, x) for y in range(1, h - 1) for x in range(1, w - 1) if m[y, x]]
    number = {p: k for k, p in enumerate(free)}
    a, b = np.zeros((len(free), len(free))), np.zeros(len(free))
    for (y, x), k in number.items():
        for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            ds, dt = s[y, x] - s[q], t[y, x] - t[q]
            a[k, k] += 1
            b[k] += dt if mode == "mixed" and abs(dt) > abs(ds) else ds
            if q in number:
                a[k, number[q]] -= 1
            else:
                b[k] += t[q]
    out = t.astype(float).copy()
    if free:
        for p, v in zip(free, np.linalg.solve(a, b), strict=True):
            out[p] = v
    return np.clip(out, 0, 255)


@pytest.mark.parametrize("mode", ["normal", "mixed"])
def test_clone_is_the_dense_solution(spark, mode):
    rng = np.random.default_rng(3)
    yy, xx = np.mgrid[:40, :52]
    images = {"a": [100 + 3 * rng.normal(size=(40, 52)), 60 + 40 * np.sin(xx / 5) + yy, ((yy - 20) ** 2 + (xx - 25) ** 2 < 300).astype(float)],
              "b": [rng.uniform(50, 200, (40, 52)), rng.uniform(50, 200, (40, 52)), (rng.random((40, 52)) < 0.7).astype(float)],
              "c": [rng.uniform(0, 255, (9, 7)), rng.uniform(0, 255, (9, 7)), np.zeros((9, 7))]}
    got, rounds = blending.poisson_clone(blocks.to_blocks(pixel_rows(spark, images, ["t", "s", "m"]), ("t", "s", "m"), 16), mode, 1e-5, block=16)
    assert 1 <= rounds < 60
    for name, (t, s, m) in images.items():
        assert np.abs(back(got.where(F.col("image_id") == name), 16, t.shape) - dense(t, s, m, mode)).max() < 1e-3


def test_many_levels_are_planned_at_once(spark):
    rng = np.random.default_rng(4)
    made = blocks.to_blocks(pixel_rows(spark, {"a": [rng.uniform(0, 255, (70, 70))]}, ["g"]), block=32)
    nodes = {}
    for n in (2, 6):
        levels = blocks.laplacian_levels(made, n, 32)
        began = time.time()
        plan = blocks.collapse(levels, 32)
        nodes[n] = plan._jdf.queryExecution().optimizedPlan().toString().count("\n")
        assert time.time() - began < 5
    assert nodes[6] < 4 * nodes[2]
    a = blocks.to_pixels(made, 32).toPandas().sort_values(["y", "x"]).value.to_numpy()
    assert np.abs(blocks.to_pixels(plan, 32).toPandas().sort_values(["y", "x"]).value.to_numpy() - a).max() < 1e-9


def test_repairs_in_order(spark):
    """Overlapping boxes give what a loop over them gives."""
    rng = np.random.default_rng(6)
    images = {"a": [rng.integers(0, 256, (60, 75)).astype(float)], "b": [rng.integers(0, 256, (30, 33)).astype(float)]}
    seams, want = [], {}
    for name, (a,) in images.items():
        out, (h, w) = a.copy(), a.shape
        for place in range(14):
            x, y, width, height = (int(rng.integers(-3, w + 3)), int(rng.integers(-3, h + 3)), int(rng.integers(1, 9)), int(rng.integers(1, 9)))
            fix = rng.choice(["increase_blend_width", "increase_blend_width", "poisson_refinement", "none"])
            pad = max(width, height)
            y0, x0, y1, x1 = max(0, y - pad), max(0, x - pad), min(h, y + height + pad), min(w, x + width + pad)
            patch = rng.uniform(0, 255, (max(0, y1 - y0), max(0, x1 - x0)))
            seams.append((name, place, x, y, width, height, str(fix), patch.tobytes()))
            if fix == "none" or y1 <= y0 or x1 <= x0:
                continue
            roi = out[y0:y1, x0:x1]
            if fix == "increase_blend_width":
                k = np.exp(-0.5 * (np.arange(-7, 8) / 2.6) ** 2)
                k /= k.sum()
                mirrored = lambda n: [min(i % max(2 * (n - 1), 1), (2 * (n - 1) - i) % max(2 * (n - 1), 1)) for i in range(-7, n + 7)]
                p = roi[np.ix_(mirrored(y1 - y0), mirrored(x1 - x0))]
                new = sum(k[i] * k[j] * p[i : i + y1 - y0, j : j + x1 - x0] for i in range(15) for j in range(15))
            else:
                m = np.zeros(roi.shape)
                m[max(0, y - y0) : max(0, y + height - y0), max(0, x - x0) : max(0, x + width - x0)] = 1
                new = dense(roi, patch, m, "mixed") if min(roi.shape) > 2 else roi
            out[y0:y1, x0:x1] = np.floor(np.round(new, 4) + 0.5)
        want[name] = out
    table = spark.createDataFrame(seams, "image_id string, place long, x int, y int, width int, height int, fix string, patch binary")
    made = blocks.to_blocks(pixel_rows(spark, images, ["g"]), block=16)
    got = blending.repaired(made, table, 16)
    for name, a in want.items():
        off = np.abs(back(got.where(F.col("image_id") == name), 16, a.shape) - a)
        assert off.max() <= 1 and (off > 0).mean() < 0.01  # halves may round either way
    pairs = blending.conflicts(blending.boxes(table, blocks.sizes(made)), 16)
    assert pairs.where("before >= place").count() == 0 < pairs.count()
    again = blending.repaired(made, table.limit(0), 16)
    assert np.array_equal(back(again.where("image_id = 'a'"), 16, (60, 75)), images["a"][0])
