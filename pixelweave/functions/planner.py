"""Size, cost and prompt expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named target sizes.
TARGETS = {"100MP": (12245, 8163), "150MP": (15000, 10000), "200MP": (17320, 11547)}


def target_size(width: Column, height: Column, label: Column) -> Column:
    """The named target, fitted to the picture's proportions; a size as "W x H" as it stands; the default, 100MP as it stands, for anything else."""
    pick = lambda k: F.coalesce(*[F.when(label == name, float(v[k])) for name, v in TARGETS.items()])
    fit = F.least(pick(0) / width, pick(1) / height)
    own = [F.regexp_extract(label, r"^\s*(\d{1,9})\s*x\s*(\d{1,9})\s*$", k) for k in (1, 2)]
    side = lambda size, k: F.when(label.isin(*TARGETS), F.floor(size * fit).cast("int")).when(own[0] != "", own[k].cast("int")).otherwise(TARGETS["100MP"][k])
    return F.struct(side(width, 0).alias("w"), side(height, 1).alias("h"))


def estimate(width: Column, height: Column, megapixels: Column, block: int = 1024, ratio: float = 0.2) -> Column:
    """Tiles, calls, cost and seconds of enlarging a picture."""
    scale = F.sqrt(megapixels * 1e6 / (width * height))
    step = int(block * (1 - ratio))
    tiles = F.ceil(F.floor(width * scale) / step) * F.ceil(F.floor(height * scale) / step)
    calls = F.floor(tiles * 1.2)
    return F.struct(tiles.cast("long").alias("tiles"), calls.cast("long").alias("calls"), (calls / 1e6 * 5).alias("cost"), (tiles * 5).cast("long").alias("least_s"), (tiles * 15).cast("long").alias("most_s"))


def size_bucket(remaining: Column) -> Column:
    return F.when(remaining >= 4, 4096).when(remaining >= 3, 3072).when(remaining >= 2, 2048).otherwise(1536)


def seed(block: Column, content: Column) -> Column:
    """A number below 2**31 that depends on the tile and its content."""
    return (F.conv(F.substring(F.md5(F.concat(block, F.lit(":"), F.md5(content))), 1, 8), 16, 10).cast("long") % 2147483648)


def backoff(attempt: Column, first: float = 1.0, most: float = 8.0) -> Column:
    return F.least(F.lit(most), first * F.pow(F.lit(2.0), attempt))


def prompt(category: Column, custom: Column, templates: dict[str, tuple[str, str, str, str]], default: str, avoid: Column | None = None) -> Column:
    """The custom part (if any), subject, style and quality, comma-joined; where ``avoid`` is true, ### and what to avoid. ``templates``: those four by category."""
    wanted = F.lit(False) if avoid is None else avoid
    parts = lambda t: F.concat(F.concat_ws(", ", custom, *map(F.lit, t[:3])), F.when(wanted, "###" + t[3]).otherwise(""))
    out = parts(templates[default])
    for name, t in templates.items():
        out = F.when(category == name, parts(t)).otherwise(out)
    return out


def with_tag(text: Column, tag: Column) -> Column:
    """``text`` with a tag appended after a comma, unless it is one of its comma-separated parts already; a text without anything becomes the tag."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", tag).when(F.array_contains(parts, F.trim(tag)), text).otherwise(F.concat(text, F.lit(", "), tag))
