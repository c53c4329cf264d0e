"""Images in and out, regions, EXIF and metadata."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import blocks
from pixelweave.sources import pictures
from tests.test_blending import back, pixel_rows


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(1)
    yy, xx = np.mgrid[:70, :45]
    smooth = [np.floor(128 + 90 * np.sin(yy / 9 + k) * np.cos(xx / 7)) for k in range(3)]
    return {"a b/ü": smooth, "noise": [rng.integers(0, 256, (33, 64)).astype(float) for _ in range(3)], "one": [np.full((1, 1), float(v)) for v in (9, 200, 77)]}


def test_written_and_read_again(spark, tmp_path, images):
    made = blocks.to_blocks(pixel_rows(spark, images, ["r", "g", "b"]), ("r", "g", "b"), 16)
    pictures.save_png(made, str(tmp_path / "out"), 16)
    gray = made.where("plane = 1").withColumn("plane", F.lit(0)).withColumn("image_id", F.concat(F.lit("gray "), "image_id"))
    pictures.save_png(gray, f"file://{tmp_path}/out", 16)
    again = pictures.read_blocks(spark, str(tmp_path / "out"), 16).cache()
    names = {r.image_id.rsplit("/", 1)[1] for r in again.select("image_id").distinct().collect()}
    assert len(names) == 6
    for name, planes in images.items():
        for k, a in enumerate(planes):
            for prefix, plane in (("", k), ("gray ", 0)):
                if prefix and k != 1:
                    continue
                from urllib.parse import quote

                end = pictures.file_name(prefix + name)
                mine = again.where((F.col("image_id").endswith("/" + end) | F.col("image_id").endswith("/" + quote(end))) & (F.col("plane") == plane))
                assert np.array_equal(back(mine, 16, a.shape), a)
    assert all(r.format == "PNG" and r.reason is None for r in pictures.metadata(spark.read.format("binaryFile").load(str(tmp_path / "out"))).collect())


def test_adler_sums_join():
    rng = np.random.default_rng(2)
    for n in (0, 1, 70_000):
        a, b = rng.bytes(1000), rng.bytes(n)
        assert pictures.joined_adler(zlib.adler32(a), zlib.adler32(b), n) == zlib.adler32(a + b)


def test_regions_are_pruned(spark, tmp_path, images):
    pictures.save_blocks(blocks.to_blocks(pixel_rows(spark, images, ["r", "g", "b"]), ("r", "g", "b"), 16), str(tmp_path / "kept"))
    region = pictures.read_region(spark, str(tmp_path / "kept"), "a b/ü", 20, 10, 30, 99, 16)
    p = region.toPandas()
    assert len(p) == 3 * 30 * 35
    for k in range(3):
        q = p[p.plane == k]
        assert np.array_equal(q.value, images["a b/ü"][k][q.y, q.x])
    plan = region._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(image_id" in plan and "PushedFilters: [IsNotNull(bx)" in plan
    assert pictures.read_region(spark, str(tmp_path / "kept"), "none", 0, 0, 5, 5, 16).count() == 0


def directory(order, entries, at, after=0):
    """A directory at a place, with values that don't fit behind it."""
    body, tail, place = struct.pack(order + "H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, n, raw in entries:
        body += struct.pack(order + "HHI", tag, kind, n)
        body += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", place + len(tail))
        tail += raw if len(raw) > 4 else b""
    return body + struct.pack(order + "I", after) + tail


def tiff(order):
    mark = b"II*\0" if order == "<" else b"MM\0*"
    first = [(256, 3, 1, struct.pack(order + "H", 640)), (257, 4, 1, struct.pack(order + "I", 480)), (258, 3, 3, struct.pack(order + "HHH", 8, 8, 8)), (277, 3, 1, struct.pack(order + "H", 3)),
             (0x010F, 2, 6, b"Maker\0"), (0x8769, 4, 1, struct.pack(order + "I", 400)), (0x9999, 99, 1, b"??")]
    out = mark + struct.pack(order + "I", 8) + directory(order, first, 8, after=600)
    out = out.ljust(400, b"\0") + directory(order, [(0x829D, 5, 1, struct.pack(order + "II", 28, 10)), (0x8827, 3, 1, struct.pack(order + "H", 200)), (0xA434, 2, 9, b"Lens 50mm")], 400)
    return out.ljust(600, b"\0") + directory(order, [(0x0112, 3, 1, struct.pack(order + "H", 6))], 600, after=8)


def test_exif_and_metadata(spark):
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 40, 3) + b"\0" * 3
    app = b"Exif\0\0" + tiff("<")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(app) + 2) + app + frame + b"\xff\xd9"
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + b"crc!"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 16, 6, 0, 0, 0)) + chunk(b"eXIf", tiff(">"))
    files = {"j": jpeg, "p": png, "t": tiff(">"), "cut": tiff("<")[:420], "gif": b"GIF89a" + struct.pack("<HH", 3, 4), "bmp": b"BM" + b"\0" * 16 + struct.pack("<iiHH", 5, -6, 1, 24),
             "text": b"hello", "empty": b"", "null": None, "short": b"\x89PNG\r\n\x1a\n12", "noframe": b"\xff\xd8\xff\xe0\x00\x04ab"}
    df = spark.createDataFrame([(k, v) for k, v in files.items()], "path string, content binary").withColumn("value", F.lit(1))
    rows = pictures.exif(df).collect()
    for path in ("j", "p", "t"):
        mine = {(r.directory, r.name or r.tag): (r.value, r.reason) for r in rows if r.path == path}
        assert mine["image", "Make"] == ("Maker", None) and mine["exif", "FNumber"] == ("28/10", None) and mine["exif", "LensModel"] == ("Lens 50mm", None)
        assert mine["image", 258] == ("8 8 8", None) and mine["thumbnail", "Orientation"] == ("6", None) and mine["image", 0x9999] == (None, "unknown type")
        assert ("thumbnail", 0) in mine  # the chain of directories comes back to the first
    assert {r.reason for r in rows if r.path == "cut"} >= {"entry beyond the end", "unknown type"}
    assert not {r.path for r in rows} & {"gif", "bmp", "text", "empty", "null", "noframe"}
    got = {r.path: (r.format, r.width, r.height, r.mode, r.bits, r.reason) for r in pictures.metadata(df).collect()}
    assert got == {
        "j": ("JPEG", 40, 30, "RGB", 8, None), "p": ("PNG", 7, 9, "RGBA", 16, None), "t": ("TIFF", 640, 480, "RGB", 8, None), "cut": ("TIFF", 640, 480, "RGB", 8, None), "gif": ("GIF", 3, 4, "P", 8, None),
        "bmp": ("BMP", 5, 6, "RGB", 8, None), "text": (None, None, None, None, None, "unknown format"), "empty": (None, None, None, None, None, "empty"), "null": (None, None, None, None, None, "empty"),
        "short": (None, None, None, None, None, "header cut short"), "noframe": ("JPEG", None, None, None, None, "no frame"),
    }
