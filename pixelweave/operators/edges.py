"""Canny edges of images in blocks: thinning by direction in a halo, then hysteresis over components that cross blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import blocks as B
from pixelweave.operators.blocks import BLOCK, BLOCKS
from pixelweave.staging import staged

#: The tangent of 22.5 degrees in 15 binary places.
TANGENT, PLACES = 13573, 15
_AROUND = [(0, 1), (1, -1), (1, 0), (1, 1)]  # half of the eight neighbours


def labelled(on: np.ndarray) -> np.ndarray:
    """For each place that is on, the first place, counted row by row, of its component of eight neighbours; -1 elsewhere."""
    h, w = on.shape
    at = np.where(on, np.arange(h * w).reshape(h, w), -1)
    pairs = []
    for dy, dx in _AROUND:
        a, b = at[: h - dy, max(0, -dx) : w - max(0, dx)], at[dy:, max(0, dx) : w + min(0, dx)]
        both = (a >= 0) & (b >= 0)
        pairs.append(np.stack([a[both], b[both]]))
    a, b = np.concatenate(pairs, axis=1)
    up = np.arange(h * w)
    while len(a):
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
    return np.where(on, up[at], -1)


def thinned(a: np.ndarray, low: float, high: float, inside: np.ndarray) -> np.ndarray:
    """0, 1 (weak) or 2 (strong) of whole levels with two pixels more on each side; beyond ``inside``, one more, there is no gradient."""
    rise = lambda p: p[:-2] + 2 * p[1:-1] + p[2:]
    gx, gy = (rise(a)[:, 2:] - rise(a)[:, :-2]).astype(np.int64), (rise(a.T)[:, 2:] - rise(a.T)[:, :-2]).T.astype(np.int64)
    size = np.where(inside, np.abs(gx) + np.abs(gy), 0)
    own, gx, gy = size[1:-1, 1:-1], gx[1:-1, 1:-1], gy[1:-1, 1:-1]
    next_to = lambda dy, dx: size[1 + dy : size.shape[0] - 1 + dy, 1 + dx : size.shape[1] - 1 + dx]
    x, y = np.abs(gx), np.abs(gy) << PLACES
    flat, steep = y < x * TANGENT, y > x * TANGENT + (x << PLACES + 1)
    falling = (gx ^ gy) < 0
    slant = np.where(falling, (own > next_to(-1, 1)) & (own > next_to(1, -1)), (own > next_to(-1, -1)) & (own > next_to(1, 1)))
    most = np.where(flat, (own > next_to(0, -1)) & (own >= next_to(0, 1)), np.where(steep, (own > next_to(-1, 0)) & (own >= next_to(1, 0)), slant))
    return np.where(most & (own > low), np.where(own > high, 2, 1), 0)


def candidates(blocks: DataFrame, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """Blocks of plane 0's weak (1) and strong (2) pixels, and, plane 1, of their components' labels within the block (first place in the image + 1)."""

    def kernel(areas, image_id, y, x, h, w):
        area = areas[0]
        ys, xs = np.arange(y - 2, y + h + 2), np.arange(x - 2, x + w + 2)
        a = area.take(ys, xs, B.edge)
        inside = ((ys >= 0) & (ys < area.height))[1:-1, None] & ((xs >= 0) & (xs < area.width))[1:-1] & area.take(ys, xs, B.edge, "seen")[1:-1, 1:-1]
        kind = thinned(a, low, high, inside)
        local = labelled(kind > 0)
        place = (y + local // w) * area.width + x + local % w + 1
        return B.block_rows(image_id, {0: kind, 1: np.where(local >= 0, place, 0)}, y, x, block)

    return B.gather(blocks.where("plane = 0"), kernel, BLOCKS, B.halo(2), block=block)


def canny(blocks: DataFrame, low: float = 50, high: float = 150, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(image_id, label, n) of the components, within blocks, of plane 0's Canny edges, and ``candidates`` whose labels these are.

    Sobel gradients of repeated borders, sizes by sums; a weak pixel is an edge if a chain of eight neighbours leads to a strong
    one. Chains cross blocks: labels that touch across a border are linked, and strong labels spread over links, a round for each
    border that the longest chain crosses. Only labels at borders take part, not pixels. An empty table gives no rows.
    """
    made = staged(candidates(blocks, low, high, block), "candidates")

    def touching(areas, image_id, y, x, h, w):
        area = areas[1]
        around = np.zeros((h + 2, w + 2))
        a, b, c, d = max(0, y - 1), min(area.height, y + h + 1), max(0, x - 1), min(area.width, x + w + 1)
        around[a - y + 1 : b - y + 1, c - x + 1 : d - x + 1] = area.values[a - area.y0 : b - area.y0, c - area.x0 : d - area.x0]
        outer = np.ones((h + 2, w + 2), bool)
        outer[1:-1, 1:-1] = False
        pairs = []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                mine, other, out = around[1:-1, 1:-1], around[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx], outer[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx]
                both = (mine > 0) & (other > 0) & out
                pairs.append(np.stack([mine[both], other[both]], 1))
        found = np.unique(np.concatenate(pairs), axis=0).astype(np.int64)
        return pd.DataFrame({"image_id": image_id, "a": found[:, 0], "b": found[:, 1]})

    def counted(areas, image_id, y, x, h, w):
        kind, label = (areas[k].around(y, x, h, w, 0).ravel() for k in (0, 1))
        names, at = np.unique(label[label > 0].astype(np.int64), return_inverse=True)
        strong = np.zeros(len(names), bool)
        np.logical_or.at(strong, at, kind[label > 0] == 2)
        return pd.DataFrame({"image_id": image_id, "label": names, "n": np.bincount(at, minlength=len(names)), "strong": strong})

    labels = staged(B.gather(made, counted, "image_id string, label long, n long, strong boolean", B.halo(0), block=block), "labels")
    links = staged(B.gather(made, touching, "image_id string, a long, b long", B.halo(1), block=block), "links")
    found = front = staged(labels.where("strong").select("image_id", "label"), "edges")
    while not front.isEmpty():  # a component may lie in two blocks at once, and a label is its component's in its own block
        reached = links.join(front.withColumnRenamed("label", "a"), ["image_id", "a"]).select("image_id", F.col("b").alias("label")).distinct()
        front = staged(reached.join(found, ["image_id", "label"], "left_anti"), "front")
        found = staged(found.unionByName(front), "edges")
    return labels.join(found, ["image_id", "label"]).select("image_id", "label", "n"), made


def edge_map(edges: DataFrame, made: DataFrame, block: int = BLOCK) -> DataFrame:
    """(image_id, y, x) of the pixels of ``canny``'s components."""
    labels = B.to_pixels(made.where("plane = 1"), block).where("value > 0").withColumn("label", F.col("value").cast("long"))
    return labels.join(edges.select("image_id", "label"), ["image_id", "label"]).select("image_id", "y", "x")


def oversharpened(blocks: DataFrame, low: float = 50, high: float = 150, block: int = BLOCK) -> DataFrame:
    """(image_id, edge_density, oversharpen_score): the share of edge pixels, and 100 less 500 times that, at least 0."""
    edges, _ = canny(blocks, low, high, block)
    share = F.coalesce(F.col("n"), F.lit(0)) / (F.col("height").cast("double") * F.col("width"))
    sums = edges.groupBy("image_id").agg(F.sum("n").alias("n"))
    out = B.sizes(blocks).join(sums, "image_id", "left").select("image_id", share.alias("edge_density"))
    return out.withColumn("oversharpen_score", F.greatest(F.lit(0.0), 100 - F.col("edge_density") * 500))
