"""Transforms, saliency and Canny edges against whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import blocks, edges, spectrum
from tests.test_blending import back, pixel_rows


@pytest.mark.parametrize("strip", [1 << 22, 100])
def test_transform_of_odd_sizes(spark, monkeypatch, strip):
    monkeypatch.setattr(spectrum, "STRIP", strip)
    rng = np.random.default_rng(1)
    images = {"a": [rng.uniform(0, 255, (37, 50))], "b": [rng.uniform(0, 255, (5, 91))], "c": [rng.uniform(0, 255, (1, 1))]}
    made = blocks.to_blocks(pixel_rows(spark, images, ["g"]), block=16)
    there = spectrum.transform(spectrum.to_parts(made, 16))
    again = spectrum.on_grid(spectrum.inverse(there), 16)
    on_grid = spectrum.on_grid(spectrum.rolled(there, 1), 16)
    ratios = {r.image_id: r.hf_ratio for r in spectrum.high_frequency_ratio(made, 16).collect()}
    for name, (a,) in images.items():
        f = np.fft.fftshift(np.fft.fft2(a))
        for k, want in ((0, f.real), (1, f.imag)):
            assert np.abs(back(on_grid.where((F.col("image_id") == name) & (F.col("plane") == k)), 16, a.shape) - want).max() < 1e-6
        assert np.abs(back(again.where((F.col("image_id") == name) & (F.col("plane") == 0)), 16, a.shape) - a).max() < 1e-9
        yy, xx = np.ogrid[: a.shape[0], : a.shape[1]]
        far = np.sqrt((yy - a.shape[0] // 2) ** 2 + (xx - a.shape[1] // 2) ** 2) > min(a.shape) // 4
        assert abs(ratios[name] - np.abs(f)[far].sum() / (np.abs(f).sum() + 1e-10)) < 1e-9


def test_saliency(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(100, 120, (45, 52))
    a[20:26, 30:37] += 90
    f = np.fft.fftshift(np.fft.fft2(a))
    level = np.log(np.abs(f) + 1e-8)
    mean = sum(np.pad(level, 2, mode="reflect")[i : i + 45, j : j + 52] for i in range(5) for j in range(5)) / 25
    size = np.abs(np.fft.ifft2(np.fft.ifftshift(np.exp(level - mean + 1j * np.angle(f)))))
    k = np.exp(-0.5 * (np.arange(-2, 3) / 1.1) ** 2)
    k /= k.sum()
    smooth = sum(k[i] * k[j] * np.pad(size, 2, mode="reflect")[i : i + 45, j : j + 52] for i in range(5) for j in range(5))
    want = np.floor((smooth - smooth.min()) / (smooth.max() - smooth.min() + 1e-8) * 255)
    got = spectrum.saliency(blocks.to_blocks(pixel_rows(spark, {"a": [a]}, ["g"]), block=16), 16)
    off = back(got, 16, a.shape) != want
    assert off.sum() <= 2  # whole levels, rounded down
    assert np.array_equal(back(spectrum.salient(got), 16, a.shape) > 0, back(got, 16, a.shape) > 178)


def whole_canny(a, low, high):
    """Edges of one array, pixel by pixel."""
    h, w = a.shape
    p = np.pad(a, 1, mode="edge").astype(int)
    gx, gy = np.zeros((h, w), int), np.zeros((h, w), int)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            part = p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
            gx, gy = gx + dx * (2 - abs(dy)) * part, gy + dy * (2 - abs(dx)) * part
    m = np.pad(np.abs(gx) + np.abs(gy), 1)
    kind = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            own, ax, ay = m[y + 1, x + 1], abs(gx[y, x]), abs(gy[y, x]) * 32768
            at = lambda dy, dx: m[y + 1 + dy, x + 1 + dx]  # noqa: B023, E731
            if own <= low:
                continue
            if ay < ax * 13573:
                best = own > at(0, -1) and own >= at(0, 1)
            elif ay > ax * 13573 + ax * 65536:
                best = own > at(-1, 0) and own >= at(1, 0)
            else:
                s = -1 if (gx[y, x] ^ gy[y, x]) < 0 else 1
                best = own > at(-1, -s) and own > at(1, s)
            kind[y, x] = (2 if own > high else 1) if best else 0
    found = {(int(y), int(x)) for y, x in zip(*np.nonzero(kind == 2), strict=True)}
    todo = list(found)
    while todo:
        y, x = todo.pop()
        for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
            if 0 <= q[0] < h and 0 <= q[1] < w and kind[q] and q not in found:
                found.add(q)
                todo.append(q)
    return found


def test_edges_cross_blocks(spark):
    rng = np.random.default_rng(3)
    yy, xx = np.mgrid[:60, :75]
    # A long arc that is weak but for one end, rings, and noise.
    arc = 100 + 18 * (np.hypot(yy - 70, xx - 5) < 50) + 60 * ((yy < 25) & (np.hypot(yy - 70, xx - 5) < 50) & (xx < 10))
    images = {"arc": [np.floor(arc)], "rings": [np.floor(128 + 100 * np.sin(np.hypot(yy - 30, xx - 37) / 3))], "noise": [rng.integers(90, 120, (60, 75))], "flat": [np.full((20, 20), 7)]}
    made = blocks.to_blocks(pixel_rows(spark, images, ["g"]), block=8)
    found, candidates = edges.canny(made, 50, 150, 8)
    got = {}
    for r in edges.edge_map(found, candidates, 8).collect():
        got.setdefault(r.image_id, set()).add((r.y, r.x))
    for name, (a,) in images.items():
        assert got.get(name, set()) == whole_canny(a, 50, 150), name
    assert len(got["arc"]) > 40
    scores = {r.image_id: r.oversharpen_score for r in edges.oversharpened(made, block=8).collect()}
    assert scores["flat"] == 100 and scores["arc"] == max(0, 100 - len(got["arc"]) / 4500 * 500)
