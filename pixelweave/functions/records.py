"""Expressions over descriptive columns: regions, files, progress and report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reads_as_text(w: Column, h: Column, image_width: Column) -> Column:
    """Whether a box is of a text line's shape."""
    return (w > 20) & (h > 10) & (w < 0.5 * image_width)


def with_margin(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, share: float = 0.2) -> Column:
    """The box grown on all sides by a share of its longer side and cut to the image: struct x, y, w, h."""
    m = F.floor(F.greatest(w, h) * share)
    x0, y0 = F.greatest(F.lit(0), x - m), F.greatest(F.lit(0), y - m)
    x1, y1 = F.least(width, x + w + m), F.least(height, y + h + m)
    return F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), (x1 - x0).cast("int").alias("w"), (y1 - y0).cast("int").alias("h"))


def clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The box cut to the image; w or h of 0 or less: nothing is left."""
    x0, y0 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    return F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), F.least(w, width - x0).cast("int").alias("w"), F.least(h, height - y0).cast("int").alias("h"))


def crop_presets(width: Column, height: Column) -> Column:
    """Map from the preset's name to (left, top, right, bottom)."""
    size, cx, cy = F.least(width, height), F.floor(width / 2), F.floor(height / 2)
    box = lambda half: F.array(*[v.cast("int") for v in (cx - half, cy - half, cx + half, cy + half)])
    return F.create_map(F.lit("center"), box(F.floor(size / 2)), F.lit("full"), F.array(F.lit(0), F.lit(0), width.cast("int"), height.cast("int")), F.lit("square"), box(F.floor(size / 2)))


def progress_stages(progress: Column) -> Column:
    """Percent of each stage of a run by its overall percent."""
    late = lambda start, rate: F.when(progress < start, 0).otherwise((progress - start) * rate)
    stages = [("split", F.lit(100)), ("process", progress), ("fuse", late(80, 5)), ("finish", late(95, 20)), ("write", F.when(progress < 99, 0).otherwise(100))]
    return F.array(*[F.struct(F.lit(n).alias("stage"), v.cast("int").alias("percent")) for n, v in stages])


def minutes_left(total: Column, done: Column) -> Column:
    return F.floor((total - done) * 0.5).cast("int")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def encoding(name: Column) -> Column:
    """What an image sink writes for a name: TIFF with LZW, PNG of level 3, or a format of quality 95."""
    ext = extension(name)
    return F.when(ext.isin(".tif", ".tiff"), "tiff:lzw").when(ext == ".png", "png:3").otherwise("other:95")


def megabytes(n: Column) -> Column:
    return n / (1024 * 1024)


def short_name(name: Column, most: int = 20) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most), F.lit("..."))).otherwise(name)


def get_or(m: Column, key: str, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), default)


def duration(start: Column, end: Column, now: Column) -> Column:
    """Seconds from start to end, or to now while there is no end."""
    return F.coalesce(end, now).cast("double") - start.cast("double")


def stable_id(*parts: Column) -> Column:
    """An id of UUID's form that depends on the parts only."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def normalized(value: Column, top: Column) -> Column:
    """Values of an image whose largest one is at most 1 go to 0..255."""
    return F.when(top <= 1, F.floor(value * 255)).otherwise(F.floor(value)).cast("int")


#: The lines of a summary, by metric, with its number format.
SUMMARY = (("psnr", "PSNR:      %.2f dB"), ("ms_ssim", "MS-SSIM:   %.4f"), ("lpips_vgg", "LPIPS:     %.4f"), ("niqe", "NIQE:      %.2f"), ("overall_score", "Overall:   %.2f/100"))


def summary(metrics: Column) -> Column:
    """The text of a summary report from a map of metrics; a metric that is not there has no line. Halves of the last
    digit, in a number's shortest decimal form, go up."""
    rule = F.lit("=" * 50)
    lines = [F.when(F.try_element_at(metrics, F.lit(k)).isNotNull(), F.format_string(form, F.try_element_at(metrics, F.lit(k)))) for k, form in SUMMARY]
    return F.concat_ws("\n", rule, F.lit("Image quality summary"), rule, F.lit(""), *lines, F.lit(""), rule)
