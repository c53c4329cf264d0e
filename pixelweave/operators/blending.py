"""Fusion of tiles on a canvas from their gradients, their feathered masks, and cloning by Poisson's equation, all on blocks.

Tiles are images of their own (see ``blocks``); places are (image_id, canvas, tile_y, tile_x).
"""

from __future__ import annotations

from collections import namedtuple
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import blocks as B
from pixelweave.operators.blocks import BLOCK, BLOCKS
from pixelweave.staging import staged

_KEYS = ["image_id", "plane", "by", "bx"]


def running(blocks: DataFrame, axis: int, block: int = BLOCK) -> DataFrame:
    """Blocks of the running sums down the columns (axis 0) or along the rows (1) of whole images.

    A block is summed for itself; the sums that it passes on, one number for each of its lines, are all that meets by line of
    blocks, and come back to the blocks as carries.
    """
    along, across = ("by", "bx") if axis == 0 else ("bx", "by")

    def totals(batches):
        for pdf in batches:
            sums = [np.nansum(np.frombuffer(d).reshape(h, w), axis).tobytes() for d, h, w in zip(pdf["data"], pdf["h"], pdf["w"], strict=True)]
            yield pdf[_KEYS].assign(carry=sums)

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(along)
        sums = np.stack([np.frombuffer(c) for c in pdf["carry"]])
        before = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, 0)[:-1]])
        return pdf.assign(carry=[b.tobytes() for b in before])

    def add(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                carry, data = np.frombuffer(r.carry), np.frombuffer(r.data).reshape(r.h, r.w)
                out.append(np.where(np.isnan(data), np.nan, np.nancumsum(data, axis) + (carry[None] if axis == 0 else carry[:, None])).tobytes())
            yield pdf.drop(columns="carry").assign(data=out)

    kinds = "image_id string, plane int, by int, bx int, carry binary"
    carries = blocks.mapInPandas(totals, kinds).groupBy("image_id", "plane", across).applyInPandas(carried, kinds)
    return blocks.join(carries, _KEYS).select(*B._NAMES, "carry").mapInPandas(add, BLOCKS)


def cosine_weight(y: int, x: int, h: int, w: int, height: int, width: int) -> np.ndarray:
    """Rises from a tile's edge to 1 at an eighth of its shorter side."""
    ys, xs = np.arange(y, y + h), np.arange(x, x + w)
    edge = np.minimum(np.minimum(ys, height - 1 - ys)[:, None], np.minimum(xs, width - 1 - xs))
    return 0.5 * (1 - np.cos(np.pi * np.minimum(1, edge / max(1, min(height, width) // 8))))


def gradient_fusion(tiles: DataFrame, places: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks, by canvas: Sobel gradients of tiles (plane 0), averaged with cosine weights, then summed up again.

    A value is the mean of its row's running sum of gradients across and its column's of gradients down, cut to 0..255.
    Places that no tile covers have no gradient. An empty table gives no rows.
    """

    def graded(areas, image_id, y, x, h, w):
        a = areas[0].around(y, x, h, w, 1)
        rise = lambda p: p[:-2] + 2 * p[1:-1] + p[2:]
        gx, gy = rise(a)[:, 2:] - rise(a)[:, :-2], (rise(a.T)[:, 2:] - rise(a.T)[:, :-2]).T
        weight = cosine_weight(y, x, h, w, areas[0].height, areas[0].width)
        return B.block_rows(image_id, {k: areas[0].kept(v, y, x) for k, v in enumerate((gx * weight, gy * weight, weight))}, y, x, block)

    mean = lambda s: {k: s[k] / np.maximum(s[2], 1e-6) for k in (0, 1)}
    made = B.gather(tiles.where("plane = 0"), graded, BLOCKS, B.halo(1), block=block)
    slopes = staged(B.on_canvas(made, places, mean, block), "slopes")
    across, down = (running(slopes.where(F.col("plane") == k), 1 - k, block).withColumn("plane", F.lit(0)) for k in (0, 1))

    def half(batches):
        for pdf in batches:
            yield pdf.assign(data=[np.clip(np.frombuffer(d) / 2, 0, 255).tobytes() for d in pdf["data"]])

    return B.plane_sum(across, down).mapInPandas(half, BLOCKS)


def _inside(area: B.Area, y: int, x: int, h: int, w: int, r: int) -> np.ndarray:
    """The block with ``r`` pixels more on each side; what lies beyond the image is 0."""
    out = np.zeros((h + 2 * r, w + 2 * r))
    a, b, c, d = max(0, y - r), min(area.height, y + h + r), max(0, x - r), min(area.width, x + w + r)
    out[a - y + r : b - y + r, c - x + r : d - x + r] = area.values[a - area.y0 : b - area.y0, c - area.x0 : d - area.x0]
    return out


def distance_to_zero(mask: np.ndarray, most: int) -> np.ndarray:
    """Exact Euclidean distances to the nearest 0 of a mask, up to ``most``, for all places at least ``most`` from its border.

    First down the columns; then along rows, where each column's distance is a parabola and the lowest one counts.
    """
    n = mask.shape[0]
    at = np.arange(n)[:, None]
    above = np.maximum.accumulate(np.where(mask == 0, at, -2 * n - most), 0)
    below = np.minimum.accumulate(np.where(mask == 0, at, 3 * n + most)[::-1], 0)[::-1]
    square = np.minimum(np.minimum(at - above, below - at), most).astype(float)[most : n - most] ** 2
    width = mask.shape[1] - 2 * most
    best = np.full((square.shape[0], width), float(most) ** 2)
    for d in range(-most, most + 1):
        np.minimum(best, square[:, most + d : most + d + width] + d * d, out=best)
    return np.sqrt(best)


def feather_fusion(tiles: DataFrame, places: DataFrame, feather_width: int = 50, block: int = BLOCK) -> DataFrame:
    """Blocks, by canvas, of tiles (plane 0) weighted by how far a pixel is inside its tile's mask (plane 1, 0 where nothing is shown).

    The weight is a cosine step over the exact distance to the nearest place that is masked or outside, from 0 to ``feather_width``,
    where it reaches 1. Only distances up to there matter, so blocks need that much of their neighbours. Places without any
    weight are 0. An empty table gives no rows.
    """

    def weighted(areas, image_id, y, x, h, w):
        far = distance_to_zero(_inside(areas[1], y, x, h, w, feather_width), feather_width)
        weight = 0.5 * (1 - np.cos(np.pi * far / feather_width))
        values = areas[0].around(y, x, h, w, 0) * weight
        return B.block_rows(image_id, {0: areas[0].kept(values, y, x), 1: areas[0].kept(weight, y, x)}, y, x, block)

    return B.on_canvas(B.gather(tiles, weighted, BLOCKS, B.halo(feather_width), block=block), places, B.weighted_mean, block)


# Cloning

def _slopes(src: np.ndarray, dst: np.ndarray, mode: str) -> np.ndarray:
    """Divergence of the wanted gradients, one pixel smaller on each side: those of the source, or of each pair of neighbours the
    steeper of source and target (mixed)."""
    total = 0.0
    for axis in (0, 1):
        s, d = np.diff(src, axis=axis), np.diff(dst, axis=axis)
        g = np.where(np.abs(d) > np.abs(s), d, s) if mode == "mixed" else s
        total = total + (np.diff(g, axis=0)[:, 1:-1] if axis == 0 else np.diff(g, axis=1)[1:-1])
    return total


def relaxed(u: np.ndarray, rhs: np.ndarray, free: np.ndarray, tolerance: float) -> np.ndarray:
    """Solves laplace(u) = rhs on the ``free`` places (none on the border), the others kept, by red and black over-relaxation."""
    u, n = u.copy(), max(3, *u.shape)
    omega = 2 / (1 + np.sin(np.pi / n))
    parity = np.add.outer(np.arange(u.shape[0]), np.arange(u.shape[1]))[1:-1, 1:-1] % 2
    inner, on = u[1:-1, 1:-1], free[1:-1, 1:-1]
    for _ in range(20 * n):
        change = 0.0
        for colour in (0, 1):
            off = (u[:-2, 1:-1] + u[2:, 1:-1] + u[1:-1, :-2] + u[1:-1, 2:] - 4 * inner - rhs[1:-1, 1:-1]) * (on & (parity == colour))
            inner += omega / 4 * off
            change = max(change, float(np.abs(off).max(initial=0)))
        if change < tolerance:
            break
    return u


def poisson_clone(images: DataFrame, mode: str = "normal", tolerance: float = 1e-4, overlap: int | None = None, rounds: int = 200, block: int = BLOCK, side: int | None = None) -> tuple[DataFrame, int]:
    """Blocks of the target (plane 0) with the source (plane 1) cloned in where the mask (plane 2) is not 0, and the rounds it took.

    The three planes are of one size: a source is put at its place by ``on_canvas`` before. Inside the mask the result has the source's
    gradients (mode "normal") or each time the steeper ones ("mixed"), and at the mask's edge the target's values. Masked places on
    the image's border, or beside places without a pixel, keep the target. Smaller blocks are put together to squares of ``side`` (``BLOCK``, or the
    blocks' own side where that is more). These solve for themselves with ``overlap`` pixels of their neighbours around (a half square), take over the neighbours' new
    values and solve again, a written stage a round, until no value moves by more than ``tolerance``; an image of one square is solved in
    the first. Values are cut to 0..255; an image with an empty mask stays as it is; an empty table gives no rows.
    """
    side = side or max(block, BLOCK)
    r = overlap or max(2, side // 2)

    def start(areas, image_id, y, x, h, w):
        t, s = (areas[k].around(y, x, h, w, 1) for k in (0, 1))
        ys, xs = np.arange(y, y + h), np.arange(x, x + w)
        inner = ((ys > 0) & (ys < areas[0].height - 1))[:, None] & (xs > 0) & (xs < areas[0].width - 1)
        seen = areas[0].around(y, x, h, w, 1, "seen")
        inner = inner & seen[1:-1, 1:-1] & seen[:-2, 1:-1] & seen[2:, 1:-1] & seen[1:-1, :-2] & seen[1:-1, 2:]
        free = (areas[2].around(y, x, h, w, 0) != 0) & inner
        return B.block_rows(image_id, {0: areas[0].kept(t[1:-1, 1:-1], y, x), 1: _slopes(s, t, mode), 2: free.astype(float), 3: np.full((h, w), np.inf)}, y, x, side)

    def solve(areas, image_id, y, x, h, w):
        a = areas[0]
        y0, y1, x0, x1 = max(0, y - r), min(a.height, y + h + r), max(0, x - r), min(a.width, x + w + r)
        u, rhs, free = (areas[k].values for k in (0, 1, 2))
        free = free != 0
        free[0] = free[-1] = free[:, 0] = free[:, -1] = False  # what surrounds the region is given
        own = np.s_[y - y0 : y - y0 + h, x - x0 : x - x0 + w]
        new = u
        if free.any():
            ys, xs = (np.flatnonzero(free.any(k)) for k in (1, 0))
            box = np.s_[ys[0] - 1 : ys[-1] + 2, xs[0] - 1 : xs[-1] + 2]  # what is solved, and what surrounds it
            new = u.copy()
            new[box] = relaxed(u[box], rhs[box], free[box], tolerance / 100)
        alone = u.shape == (a.height, a.width)  # all of the image, so no neighbour will bring other values
        moved = np.full((h, w), 0 if alone else np.abs(new[own] - u[own]).max(initial=0))
        assert u.shape == (y1 - y0, x1 - x0)
        return B.block_rows(image_id, {0: a.kept(new[own], y, x), 1: rhs[own], 2: areas[2].values[own], 3: moved}, y, x, side)

    def most(batches):
        for pdf in batches:
            yield pd.DataFrame({"moved": [np.frombuffer(d).max(initial=0) for d in pdf["data"]]})

    def cut(areas, image_id, y, x, h, w):
        return B.block_rows(image_id, {0: areas[0].kept(np.clip(areas[0].around(y, x, h, w, 0), 0, 255), y, x)}, y, x, block)

    now, done = staged(B.gather(images, start, BLOCKS, B.halo(1), block=side, source_block=block), "clone"), 0
    while done < rounds:
        now, done = staged(B.gather(now.where("plane < 3"), solve, BLOCKS, B.halo(r), block=side), "clone"), done + 1
        moved = now.where("plane = 3").mapInPandas(most, "moved double").agg(F.max("moved")).first()[0]
        if moved is None or moved <= tolerance:
            break
    return B.gather(now.where("plane = 0"), cut, BLOCKS, B.halo(0), block=block, source_block=side), done


def mask_blend(images: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of target (plane 0) and source (plane 1) mixed by the mask (plane 2, from 0 to 255), cut to whole levels."""
    return B.combined(images, lambda t, s, m: np.floor(t * (1 - m / 255) + s * m / 255), block=block)



# Repair of seams

#: The Gaussian that widens a blend: 15 taps, its deviation by the usual rule for a kernel's size.
_WIDE = B.gaussian(7, 0.3 * ((15 - 1) * 0.5 - 1) + 0.8)
_BOX = ["y0", "x0", "y1", "x1"]


def boxes(seams: DataFrame, images: DataFrame) -> DataFrame:
    """``seams`` (image_id, place, x, y, width, height, fix) that need a repair, with the box around each: its longer side more on all
    sides, as far as the image (image_id, image_h, image_w) goes."""
    pad = F.greatest("width", "height")
    size = images.select("image_id", F.col("height").alias("image_h"), F.col("width").alias("image_w"))
    out = seams.where("fix <> 'none'").join(size, "image_id")
    edges = {"y0": F.greatest(F.lit(0), F.col("y") - pad), "x0": F.greatest(F.lit(0), F.col("x") - pad),
             "y1": F.least("image_h", F.col("y") + F.col("height") + pad), "x1": F.least("image_w", F.col("x") + F.col("width") + pad)}
    return out.withColumns({k: v.cast("int") for k, v in edges.items()}).where("y1 > y0 and x1 > x0")


def _cells(df: DataFrame, block: int) -> DataFrame:
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block).cast("int"), F.floor((F.col(b) - 1) / block).cast("int")))
    return df.withColumn("by", span("y0", "y1")).withColumn("bx", span("x0", "x1"))


def conflicts(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """(image_id, before, place): boxes that share pixels, the one repaired first and the later one; they meet by the blocks they lie in."""
    cells = _cells(found.select("image_id", "place", *_BOX), block)
    first = cells.select("image_id", "by", "bx", F.col("place").alias("before"), *[F.col(c).alias(f"b_{c}") for c in _BOX])
    touch = "before < place and b_y0 < y1 and y0 < b_y1 and b_x0 < x1 and x0 < b_x1"
    return first.join(cells, ["image_id", "by", "bx"]).where(touch).select("image_id", "before", "place").distinct()


def blurred(roi: np.ndarray) -> np.ndarray:
    """A box smoothed by the wide Gaussian, its own borders mirrored."""
    area = B.Area(roi, 0, 0, *roi.shape)
    return B.filtered(area.around(0, 0, *roi.shape, 7), _WIDE)


def refined(roi: np.ndarray, patch: np.ndarray, inner: tuple[int, int, int, int], tolerance: float = 1e-4) -> np.ndarray:
    """A box with a patch of its size cloned into ``inner`` (y0, x0, y1, x1 within the box), the steeper gradients counting."""
    free = np.zeros(roi.shape, bool)
    free[inner[0] : inner[2], inner[1] : inner[3]] = True
    free[0] = free[-1] = free[:, 0] = free[:, -1] = False
    if not free.any() or min(roi.shape) < 3:
        return roi
    rhs = np.zeros(roi.shape)
    rhs[1:-1, 1:-1] = _slopes(patch, roi, "mixed")
    return np.clip(relaxed(roi, rhs, free, tolerance), 0, 255)


def _mended(roi: np.ndarray, r, tall: int, wide: int, whole: bool) -> np.ndarray:
    """A box after the repair ``r`` (its fix, patch and places) of a seam of ``tall`` x ``wide``; places without a pixel count as 0 and stay without."""
    missing = np.isnan(roi)
    roi = np.where(missing, 0.0, roi)
    if r.fix == "increase_blend_width":
        roi = blurred(roi)
    elif r.fix == "poisson_refinement" and r.patch is not None:
        at = (max(0, r.y - r.y0), max(0, r.x - r.x0), max(0, r.y + tall - r.y0), max(0, r.x + wide - r.x0))
        roi = refined(roi, np.frombuffer(r.patch).reshape(roi.shape), at)
    return np.where(missing, np.nan, np.floor(roi + 0.5) if whole else roi)


#: Pixels of an image, at most, that one task repairs.
AT_ONCE = 1 << 20
Step = namedtuple("Step", ["image_id", "later", "place", "by", "bx", "h", "w", "height", "width", "data", *_BOX, "y", "x", "tall", "wide", "fix", "patch"])


def _by_image(image: DataFrame, found: DataFrame, whole: bool, block: int) -> DataFrame:
    """``repaired`` of images that a task can hold, ``found`` being their boxes: an image's blocks come first, then its boxes in order, one at a time."""
    pixels = image.select("image_id", F.lit(False).alias("later"), "by", "bx", "h", "w", "height", "width", "data")
    steps = found.select("image_id", F.lit(True).alias("later"), "place", *_BOX, *[F.col(a).cast("int").alias(b) for a, b in (("y", "y"), ("x", "x"), ("height", "tall"), ("width", "wide"))], "fix", "patch")
    rows = pixels.unionByName(steps, allowMissingColumns=True).select(*Step._fields)
    kinds = B.arrow_schema(BLOCKS)

    def run(batches):
        made, size = [], 0
        for image_id, own in groupby(map(Step._make, B.rows_of(batches)), lambda s: s.image_id):
            data, places = None, []
            for s in own:
                if s.later:
                    box = np.s_[s.y0 : s.y1, s.x0 : s.x1]
                    data[box] = _mended(data[box], s, s.tall, s.wide, whole)
                else:
                    data = np.full((s.height, s.width), np.nan) if data is None else data
                    data[s.by * block : s.by * block + s.h, s.bx * block : s.bx * block + s.w] = np.frombuffer(s.data).reshape(s.h, s.w)
                    places.append((s.by, s.bx, s.h, s.w))
            for by, bx, h, w in places:
                part = np.ascontiguousarray(data[by * block : by * block + h, bx * block : bx * block + w]).tobytes()
                made.append((image_id, 0, by, bx, h, w, *data.shape, part))
                size += len(part)
            if size > B.AT_ONCE:
                yield B.batch(made, kinds)
                made, size = [], 0
        yield B.batch(made, kinds)
        B.release()

    return rows.repartition("image_id").sortWithinPartitions("image_id", "later", "place").mapInArrow(run, BLOCKS)


def repaired(image: DataFrame, seams: DataFrame, block: int = BLOCK, whole: bool = True, at_once: int = AT_ONCE) -> DataFrame:
    """Blocks of plane 0 after the repair of ``seams``, one after the other in order of ``place`` (unique in an image).

    ``seams``: image_id, place, x, y, width, height, fix and, for "poisson_refinement", patch (binary, float64 values of the box's size; null
    leaves the box as it is). "increase_blend_width" smooths the box. A box reads what earlier ones left. An image of at most ``at_once`` pixels
    is repaired by one task, whose boxes come to it in order. In larger ones, of boxes that share pixels the later waits; all that wait
    for nothing are repaired at once, and there are as many rounds as the longest chain of waiting boxes. A round touches only
    blocks with boxes; the others are carried along. ``whole``: values are
    rounded after each repair. Seams outside their image, and seams of other fixes, change nothing; without seams the image stays.
    """
    patch = F.col("patch") if "patch" in seams.columns else F.lit(None).cast("binary")
    seams = seams.withColumn("patch", patch)
    image = staged(image.where("plane = 0"), "image")
    found = staged(boxes(seams, B.sizes(image)), "boxes")
    fits = lambda h, w: F.col(h).cast("long") * F.col(w) <= at_once
    small = _by_image(image.where(fits("height", "width")), found.where(fits("image_h", "image_w")), whole, block)
    now, todo = image.where(~fits("height", "width")), found.where(~fits("image_h", "image_w"))
    return small.unionByName(_by_rounds(now, todo, block, whole)) if not now.isEmpty() else small


def _by_rounds(now: DataFrame, todo: DataFrame, block: int, whole: bool) -> DataFrame:
    """``repaired`` of images of any size, ``todo`` being their boxes."""
    waits = staged(conflicts(todo, block), "waits")
    names = ["image_id", "place", *_BOX]
    inner = ["y", "x", "height", "width", "fix", "patch"]
    kinds = "image_id string, place long, y0 int, x0 int, y1 int, x1 int, y int, x int, height int, width int, fix string, patch binary, py int, px int, ph int, pw int, part binary"
    changes = "image_id string, by int, bx int, py int, px int, ph int, pw int, part binary"

    def cut(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b, c, d = max(r.y0, r.by * block), min(r.y1, r.by * block + r.h), max(r.x0, r.bx * block), min(r.x1, r.bx * block + r.w)
                part = np.frombuffer(r.data).reshape(r.h, r.w)[a - r.by * block : b - r.by * block, c - r.bx * block : d - r.bx * block]
                rows.append((*[getattr(r, n) for n in [*names, *inner]], a, c, b - a, d - c, np.ascontiguousarray(part).tobytes()))
            yield pd.DataFrame(rows, columns=[*names, *inner, "py", "px", "ph", "pw", "part"])

    def mend(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        roi = np.zeros((r.y1 - r.y0, r.x1 - r.x0))
        for p in pdf.itertuples(index=False):
            roi[p.py - r.y0 : p.py - r.y0 + p.ph, p.px - r.x0 : p.px - r.x0 + p.pw] = np.frombuffer(p.part).reshape(p.ph, p.pw)
        roi = _mended(roi, r, r.height, r.width, whole)
        rows = []
        for p in pdf.itertuples(index=False):
            part = roi[p.py - r.y0 : p.py - r.y0 + p.ph, p.px - r.x0 : p.px - r.x0 + p.pw]
            by, bx = p.py // block, p.px // block
            rows.append((r.image_id, by, bx, p.py - by * block, p.px - bx * block, p.ph, p.pw, np.ascontiguousarray(part).tobytes()))
        return pd.DataFrame(rows, columns=["image_id", "by", "bx", "py", "px", "ph", "pw", "part"])

    def put(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(old) or not len(new):
            return old
        r = old.iloc[0]
        data = np.frombuffer(r["data"]).reshape(r.h, r.w).copy()
        for p in new.itertuples(index=False):
            data[p.py : p.py + p.ph, p.px : p.px + p.pw] = np.frombuffer(p.part).reshape(p.ph, p.pw)
        return old.assign(data=[data.tobytes()])

    while not todo.isEmpty():
        left = todo.select("image_id", F.col("place").alias("before"))
        held = waits.join(left, ["image_id", "before"], "left_semi").select("image_id", "place").distinct()
        ready = staged(todo.join(held, ["image_id", "place"], "left_anti"), "ready")
        cells = _cells(ready.select(*names, *[F.col(c) if c not in ("height", "width") else F.col(c).cast("int") for c in inner]), block)
        pixels = now.select("image_id", "by", "bx", "h", "w", "data")
        made = staged(cells.join(pixels, ["image_id", "by", "bx"]).mapInPandas(cut, kinds).groupBy("image_id", "place").applyInPandas(mend, changes), "changes")
        keys = ["image_id", "by", "bx"]
        touched = made.select(*keys).distinct()
        same = now.join(touched, keys, "left_anti")
        changed = now.join(touched, keys, "left_semi").groupBy(*keys).cogroup(made.groupBy(*keys)).applyInPandas(put, BLOCKS)
        now = staged(same.unionByName(changed), "repaired")
        todo = staged(todo.join(ready.select("image_id", "place"), ["image_id", "place"], "left_anti"), "boxes")
    return now


#: Red, green and blue of a seam's frame by severity; others are green.
FRAMES = {"high": (255, 0, 0), "medium": (255, 255, 0)}


def drawn(image: DataFrame, seams: DataFrame, thickness: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks of planes 0 to 2 with a frame around each of ``seams`` (image_id, place, x, y, width, height, severity), coloured by severity.

    A frame's lines run from (x, y) to (x + width, y + height); a thickness of 2 or 3 is a pixel more on both sides, 4 or 5 are two. Later places lie
    over earlier ones. What reaches beyond the image is cut off. Blocks meet the frames of their own place only.
    """
    r = thickness // 2
    pad = {"y0": F.col("y") - r, "x0": F.col("x") - r, "y1": F.col("y") + F.col("height") + r + 1, "x1": F.col("x") + F.col("width") + r + 1}
    frames = seams.select("image_id", "place", "x", "y", F.col("width").alias("fw"), F.col("height").alias("fh"), "severity", *[v.cast("int").alias(k) for k, v in pad.items()])
    frames = _cells(frames, block).drop(*_BOX)

    def draw(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(old) or not len(new):
            return old
        planes = [np.frombuffer(d).reshape(h, w).copy() for d, h, w in zip(old["data"], old["h"], old["w"], strict=True)]
        ys, xs = int(key[1]) * block + np.arange(planes[0].shape[0])[:, None], int(key[2]) * block + np.arange(planes[0].shape[1])
        for f in new.sort_values("place").itertuples(index=False):
            inside = (ys >= f.y - r) & (ys <= f.y + f.fh + r) & (xs >= f.x - r) & (xs <= f.x + f.fw + r)
            hollow = (ys > f.y + r) & (ys < f.y + f.fh - r) & (xs > f.x + r) & (xs < f.x + f.fw - r)
            for plane, data in zip(old["plane"], planes, strict=True):
                data[inside & ~hollow & ~np.isnan(data)] = FRAMES.get(f.severity, (0, 255, 0))[plane]
        return old.assign(data=[p.tobytes() for p in planes])

    keys = ["image_id", "by", "bx"]
    return image.groupBy(*keys).cogroup(frames.groupBy(*keys)).applyInPandas(draw, BLOCKS)
