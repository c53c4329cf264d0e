"""Two-dimensional Fourier transforms of images of any size, and what is measured on them.

An image is cut in strips of whole lines of bounded size, transformed along them, cut across, exchanged, and transformed along the
other axis: two exchanges, whatever the size. Planes 0 and 1 are real and imaginary parts. Parts are rectangles at any place
(image_id, plane, y, x, h, w, height, width, data); blocks are parts on a fixed grid.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import blocks as B
from pixelweave.operators.blocks import BLOCK, BLOCKS
from pixelweave.staging import staged

PARTS = "image_id string, plane int, y int, x int, h int, w int, height int, width int, data binary"
_NAMES = ["image_id", "plane", "y", "x", "h", "w", "height", "width", "data"]
Sent = namedtuple("Sent", ["image_id", "plane", "height", "width", "gy", "gx", "gh", "gw", "py", "px", "ph", "pw", "part"])
_SENT = "image_id string, " + ", ".join(f"{c} int" for c in Sent._fields[1:-1]) + ", part binary"
#: Values of a strip, about.
STRIP = 1 << 22


def to_parts(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    return blocks.select("image_id", "plane", (F.col("by") * block).alias("y"), (F.col("bx") * block).alias("x"), "h", "w", "height", "width", "data")


def regridded(parts: DataFrame, tall: Column, wide: Column, kernel: Callable, schema: str = PARTS) -> DataFrame:
    """``kernel(planes, image_id, y, x, height, width)`` for each rectangle of a grid of ``tall`` x ``wide`` cells over an image.

    Parts are read and given out a few at a time, as in ``blocks.gather``.
    """
    kinds, made_kinds = B.arrow_schema(_SENT), B.arrow_schema(schema)

    def cut(batches):
        rows, size = [], 0
        for image_id, plane, y, x, h, w, height, width, data, tall, wide in B.rows_of(batches):
            data = np.frombuffer(data).reshape(h, w)
            for gy in range(y // tall, (y + h - 1) // tall + 1):
                a, b = max(y, gy * tall), min(y + h, (gy + 1) * tall)
                for gx in range(x // wide, (x + w - 1) // wide + 1):
                    c, d = max(x, gx * wide), min(x + w, (gx + 1) * wide)
                    part = np.ascontiguousarray(data[a - y : b - y, c - x : d - x]).tobytes()
                    rows.append((image_id, plane, height, width, gy, gx, tall, wide, a - gy * tall, c - gx * wide, b - a, d - c, part))
                    size += len(part)
                    if size > B.AT_ONCE:
                        yield B.batch(rows, kinds)
                        rows, size = [], 0
        yield B.batch(rows, kinds)
        B.release()

    def made(parts):
        planes = {}
        for r in parts:
            y, x = r.gy * r.gh, r.gx * r.gw
            if r.plane not in planes:
                planes[r.plane] = np.zeros((min(r.gh, r.height - y), min(r.gw, r.width - x)))
            part = np.frombuffer(r.part).reshape(r.ph, r.pw)
            planes[r.plane][r.py : r.py + r.ph, r.px : r.px + r.pw] = np.where(np.isnan(part), 0.0, part)  # no pixel: 0
        out = kernel(planes, r.image_id, y, x, r.height, r.width)
        return list(zip(*[out[c].tolist() for c in made_kinds.names], strict=True))

    def run(batches):
        rows, size = [], 0
        for _, parts in groupby(map(Sent._make, B.rows_of(batches)), lambda p: (p.image_id, p.gy, p.gx)):
            new = made(parts)
            rows += new
            size += sum(len(v) if isinstance(v, bytes) else 8 for r in new for v in r)
            if size > B.AT_ONCE:
                yield B.batch(rows, made_kinds)
                rows, size = [], 0
        yield B.batch(rows, made_kinds)
        B.release()

    sent = parts.select(*_NAMES, tall.cast("int").alias("tall"), wide.cast("int").alias("wide"))
    place = ["image_id", "gy", "gx"]
    return sent.mapInArrow(cut, _SENT).repartition(*place).sortWithinPartitions(*place).mapInArrow(run, schema)


def _rows(image_id: str, planes: dict[int, np.ndarray], y: int, x: int, height: int, width: int) -> pd.DataFrame:
    rows = [(image_id, k, y, x, *v.shape, height, width, np.ascontiguousarray(v, float).tobytes()) for k, v in planes.items()]
    return pd.DataFrame(rows, columns=_NAMES)


def _lines(side: str) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(STRIP / F.col(side))))


def _transformed(parts: DataFrame, kind: Callable, last: Callable = _rows, schema: str = PARTS) -> DataFrame:
    """``kind`` (np.fft.fft or its inverse) along rows, then along columns; ``last`` makes rows of a strip of whole columns."""

    def complex_of(planes):
        return planes[0] + 1j * planes[1] if 1 in planes else planes[0]

    def along(planes, *at):
        out = kind(complex_of(planes), axis=1)
        return _rows(at[0], {0: out.real, 1: out.imag}, *at[1:])

    def down(planes, *at):
        out = kind(complex_of(planes), axis=0)
        return last(at[0], {0: out.real, 1: out.imag}, *at[1:])

    rows = regridded(parts, _lines("width"), F.col("width"), along)
    return regridded(rows, F.col("height"), _lines("height"), down, schema)


def transform(parts: DataFrame) -> DataFrame:
    """Parts of the Fourier transform, planes 0 and 1, of images of plane 0 (and 1, if they are complex)."""
    return _transformed(parts, np.fft.fft)


def inverse(parts: DataFrame) -> DataFrame:
    return _transformed(parts, np.fft.ifft)


def high_frequency_ratio(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(image_id, hf_ratio): the share of the spectrum's magnitude further from its centre than a quarter, rounded down, of the shorter side.

    Of plane 0; an image of zeros has 0. An empty table gives no rows.
    """

    def shares(image_id, planes, y, x, height, width):
        magnitude = np.hypot(planes[0], planes[1])
        ys, xs = (np.arange(height) + height // 2) % height - height // 2, (np.arange(x, x + magnitude.shape[1]) + width // 2) % width - width // 2
        far = np.sqrt(ys[:, None] ** 2 + xs**2) > min(height, width) // 4
        return pd.DataFrame([(image_id, float(magnitude[far].sum()), float(magnitude.sum()))], columns=["image_id", "high", "total"])

    sums = _transformed(to_parts(blocks.where("plane = 0"), block), np.fft.fft, shares, "image_id string, high double, total double")
    return sums.groupBy("image_id").agg((F.sum("high") / (F.sum("total") + 1e-10)).alias("hf_ratio"))


def rolled(parts: DataFrame, sign: int) -> DataFrame:
    """Parts moved by half the image's size (``sign`` 1), or back (-1); those that cross the border are cut in two."""

    def roll(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                data = np.frombuffer(r.data).reshape(r.h, r.w)
                spans = []
                for at, n, full in ((r.y, r.h, r.height), (r.x, r.w, r.width)):
                    to = (at + sign * (full // 2)) % full
                    head = min(n, full - to)
                    spans.append([(0, head, to)] + [(head, n, 0)] * (head < n))
                for a, b, y in spans[0]:
                    for c, d, x in spans[1]:
                        rows.append((r.image_id, r.plane, y, x, b - a, d - c, r.height, r.width, np.ascontiguousarray(data[a:b, c:d]).tobytes()))
            yield pd.DataFrame(rows, columns=_NAMES)

    return parts.mapInPandas(roll, PARTS)


def on_grid(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of parts that cover their images."""

    def kernel(planes, image_id, y, x, height, width):
        return B.block_rows(image_id, planes, y, x, block).assign(height=height, width=width)[B._NAMES]

    return regridded(parts, F.lit(block), F.lit(block), kernel, BLOCKS)


def saliency(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of whole levels from 0 to 255: the spectral residual of plane 0.

    The log magnitude of the centred spectrum less its 5 x 5 mean, with the phase as it was, is transformed back; its size, smoothed
    by a 5 x 5 Gaussian, is stretched from its least to its greatest value. Borders are mirrored. An empty table gives no rows.
    """

    def residual(areas, image_id, y, x, h, w):
        re, im = (areas[k].around(y, x, h, w, 2) for k in (0, 1))
        level = np.log(np.hypot(re, im) + 1e-8)
        out = np.exp((level[2:-2, 2:-2] - B.filtered(level, np.ones(5) / 5)) + 1j * np.arctan2(im, re)[2:-2, 2:-2])
        return B.block_rows(image_id, {0: out.real, 1: out.imag}, y, x, block)

    def size(image_id, planes, y, x, height, width):
        return _rows(image_id, {0: np.hypot(planes[0], planes[1])}, y, x, height, width)

    centred = on_grid(rolled(transform(to_parts(blocks.where("plane = 0"), block)), 1), block)
    changed = rolled(to_parts(B.gather(centred, residual, BLOCKS, B.halo(2), block=block), block), -1)
    back = on_grid(_transformed(changed, np.fft.ifft, size), block)
    taps = B.gaussian(2, 1.1)
    smooth = B.mapped(back, lambda a, y, x, h, w: B.filtered(a.around(y, x, h, w, 2), taps), B.halo(2), block=block)
    smooth = staged(B.plane_sum(smooth, B.mapped_values(blocks.where("plane = 0"), lambda v: v * 0)), "saliency")  # pixels only where the image has them

    def ends(batches):
        for pdf in batches:
            values = [v[~np.isnan(v)] for v in map(np.frombuffer, pdf["data"])]
            ends = [(i, v.min(), v.max()) for i, v in zip(pdf["image_id"], values, strict=True) if len(v)]
            yield pd.DataFrame(ends, columns=["image_id", "least", "most"])

    span = smooth.mapInPandas(ends, "image_id string, least double, most double").groupBy("image_id").agg(F.min("least").alias("least"), F.max("most").alias("most"))

    def stretch(batches):
        for pdf in batches:
            levels = [np.floor((np.frombuffer(r.data) - r.least) / (r.most - r.least + 1e-8) * 255).tobytes() for r in pdf.itertuples(index=False)]
            yield pdf.drop(columns=["least", "most"]).assign(data=levels)

    return smooth.join(span, "image_id").select(*B._NAMES, "least", "most").mapInPandas(stretch, BLOCKS)


def salient(levels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Blocks of 1 where a saliency level is above ``threshold`` of 255, rounded down, and of 0 elsewhere."""
    least = int(255 * threshold)
    return B.mapped_values(levels, lambda v: (v > least).astype(float))
