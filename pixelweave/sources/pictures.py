"""Images in and out: blocks of image files, PNG files of blocks, stored blocks by region, and what files say of themselves.

Files come as the columns path and content, as Spark's binaryFile source gives them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pixelweave.operators import blocks as B
from pixelweave.operators.blocks import BLOCK, BLOCKS

# In

def read_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of the images under ``path``, planes 0 to 2 red, green and blue (one plane, if gray); image_id is the file's address.

    Files are decoded by Spark's image source, whose bytes are blue, green, red; those that are no image are left out, and a fourth
    channel too. Each image is cut in its own task, a batch at a time, and its bytes are not copied to pixels.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def cut(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows, size = [], 0
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                planes = [pixels[:, :, k] for k in ((2, 1, 0) if r.nChannels >= 3 else (0,))]
                for y in range(0, r.height, block):
                    for x in range(0, r.width, block):
                        for k, p in enumerate(planes):
                            v = p[y : y + block, x : x + block].astype(float)
                            rows.append((r.origin, k, y // block, x // block, *v.shape, r.height, r.width, v.tobytes()))
                            size += v.nbytes
                    if size > 1 << 26:
                        yield pd.DataFrame(rows, columns=B._NAMES)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=B._NAMES)

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(cut, BLOCKS)


def save_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks as Parquet, a folder for each image and row of blocks, so that a region's rows are found without opening the others."""
    blocks.repartition("image_id", "by").sortWithinPartitions("image_id", "by", "bx").write.mode("overwrite").partitionBy("image_id", "by").parquet(path)


def read_region(spark: SparkSession, path: str, image_id: str, y: int, x: int, height: int, width: int, block: int = BLOCK) -> DataFrame:
    """(image_id, plane, y, x, value) of a rectangle of an image saved by ``save_blocks``, as far as it lies inside the image.

    The image and the rows of blocks are picked by folder, columns of blocks by the files' statistics.
    """
    if height <= 0 or width <= 0:
        raise ValueError("an empty region")
    first, last = y // block, (y + height - 1) // block
    schema = BLOCKS.replace("by int, ", "").replace("image_id string, ", "") + ", image_id string, by int"
    near = spark.read.schema(schema).parquet(path).where((F.col("image_id") == image_id) & F.col("by").between(first, last) & F.col("bx").between(x // block, (x + width - 1) // block))
    inside = F.col("y").between(y, y + height - 1) & F.col("x").between(x, x + width - 1)
    return B.to_pixels(near.select(*B._NAMES), block).where(inside)


# Out

def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def joined_adler(first: int, second: int, length: int) -> int:
    """The Adler-32 sum of two strings in a row, from their own and the second one's length."""
    base = 65521
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % base
    return a | (b1 + b2 + length * (a1 - 1)) % base << 16


def filtered_rows(pixels: np.ndarray) -> bytes:
    """PNG rows of uint8 (height, width, channels), each with its filter's number: of none, left and up the one with the least sum of sizes.

    The first row, which doesn't know the one above it, is not filtered by that.
    """
    left, up = pixels.copy(), pixels.copy()
    left[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    kinds = np.stack([pixels, left, up])
    sums = np.abs(kinds.view(np.int8).astype(np.int64)).sum((2, 3))
    sums[2, 0] = sums.max() + 1
    choice = sums.argmin(0)
    rows = kinds[choice, np.arange(len(pixels))].reshape(len(pixels), -1)
    return np.concatenate([choice[:, None].astype(np.uint8), rows], axis=1).tobytes()


BANDS = "image_id string, by int, height int, width int, channels int, raw long, adler long, data binary"


def png_bands(blocks: DataFrame, block: int = BLOCK, level: int = 3) -> DataFrame:
    """(image_id, by, height, width, channels, raw, adler, data): rows of blocks, filtered and deflated each for itself, that end at a byte.

    Planes are channels: one (gray) or three. Values are cut to 0..255 and rounded down; a place without a pixel is black.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        planes = sorted(pdf["plane"].unique())
        band = np.zeros((int(r.h), int(r.width), len(planes)), np.uint8)
        for p in pdf.itertuples(index=False):
            band[:, p.bx * block : p.bx * block + p.w, planes.index(p.plane)] = np.clip(np.nan_to_num(np.frombuffer(p.data)).reshape(p.h, p.w), 0, 255)
        raw = filtered_rows(band)
        squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
        data = squeeze.compress(raw) + squeeze.flush(zlib.Z_FULL_FLUSH)
        return pd.DataFrame([(r.image_id, int(r.by), int(r.height), int(r.width), len(planes), len(raw), zlib.adler32(raw), data)], columns=[c.split()[0] for c in BANDS.split(", ")])

    return blocks.groupBy("image_id", "by").applyInPandas(pack, BANDS)


class PngSink(DataSource):
    """``bands.write.format("png")``: a file for each image, from rows of ``png_bands`` that come by image and in order (see ``save_png``).

    A file is written under another name and renamed when it is whole, so a task that is tried again leaves no half files.
    """

    @classmethod
    def name(cls) -> str:
        return "png"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PngWriter(self.options["path"])


class PngWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid

        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        system.create_dir(folder, recursive=True)
        current, out, adler, hidden = None, None, 1, ""

        def close():
            if out is not None:
                out.write(_chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + _chunk(b"IEND", b""))  # an empty last block
                out.close()
                system.move(hidden, f"{folder}/{file_name(current)}")

        for r in rows:
            if r.image_id != current:
                close()
                current, adler, hidden = r.image_id, 1, f"{folder}/.{uuid.uuid4().hex}"
                out = system.open_output_stream(hidden)
                head = struct.pack(">IIBBBBB", r.width, r.height, 8, 0 if r.channels == 1 else 2, 0, 0, 0)
                out.write(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"\x78\x5e"))
            adler = joined_adler(adler, r.adler, r.raw)
            out.write(_chunk(b"IDAT", bytes(r.data)))
        close()
        return WriterCommitMessage()


def file_name(image_id: str) -> str:
    """A file's name for an image: what is no letter, digit, point, dash or underscore is written as a percent sign and its code."""
    from urllib.parse import quote

    return quote(image_id, safe="") + ".png"


def save_png(blocks: DataFrame, path: str, block: int = BLOCK) -> None:
    """Writes each image of blocks to a PNG file under ``path``, a folder that all executors reach.

    Bands are filtered and deflated wherever their blocks are; the task that writes a file only joins the deflated bands.
    """
    blocks.sparkSession.dataSource.register(PngSink)
    png_bands(blocks, block).repartition("image_id").sortWithinPartitions("image_id", "by").write.format("png").mode("append").save(path)


# What files say of themselves

#: Bytes of each type of a TIFF entry, the tags that lead to further directories, and names of common tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
DIRECTORIES = {0x8769: "exif", 0x8825: "gps"}
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software",
    0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal",
    0x9209: "Flash", 0x920A: "FocalLength", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA434: "LensModel",
}
_FORMS = {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d"}


def exif_block(data: bytes) -> bytes | None:
    """The TIFF structure that a JPEG, PNG or TIFF file holds, or null."""
    if data[:2] in (b"II", b"MM"):
        return data
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"eXIf":
                return data[at + 8 : at + 8 + n]
            at += 12 + n
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            (n,) = struct.unpack(">H", data[at + 2 : at + 4])
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + n]
            at += 2 + n
    return None


def exif_entries(tiff: bytes) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(directory, tag, value, reason) of a TIFF structure's entries, either byte order; an entry that can't be read has a reason."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8 or struct.unpack(order + "H", tiff[2:4])[0] != 42:
        yield "image", 0, None, "no TIFF header"
        return
    todo, seen = [("image", struct.unpack(order + "I", tiff[4:8])[0])], set()
    while todo:
        name, at = todo.pop(0)
        if at in seen:
            yield name, 0, None, "directories in a circle"
            continue
        seen.add(at)
        if at + 2 > len(tiff):
            yield name, 0, None, "directory beyond the end"
            continue
        (count,) = struct.unpack(order + "H", tiff[at : at + 2])
        for k in range(count):
            entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                yield name, 0, None, "entry beyond the end"
                break
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            size = SIZES.get(kind, 0) * n
            if not size and n:
                yield name, tag, None, "unknown type"
                continue
            place = 8 if size <= 4 else struct.unpack(order + "I", entry[8:])[0]
            raw = entry[8 : 8 + size] if size <= 4 else tiff[place : place + size]
            if len(raw) < size:
                yield name, tag, None, "value beyond the end"
                continue
            if tag in DIRECTORIES and kind == 4 and n == 1:
                todo.append((DIRECTORIES[tag], struct.unpack(order + "I", raw)[0]))
                continue
            if kind == 2:
                value = raw.split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (5, 10):
                pairs = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * n, raw)
                value = " ".join(f"{a}/{b}" for a, b in zip(pairs[::2], pairs[1::2], strict=True))
            elif kind in _FORMS:
                value = " ".join(str(x) for x in struct.unpack(order + _FORMS[kind] * n, raw))
            else:
                value = raw.hex()
            yield name, tag, value, None
        after = tiff[at + 2 + 12 * count : at + 6 + 12 * count]
        if name in ("image", "thumbnail") and len(after) == 4 and struct.unpack(order + "I", after)[0]:
            todo.append(("thumbnail", struct.unpack(order + "I", after)[0]))


def exif(files: DataFrame) -> DataFrame:
    """(path, directory, tag, name, value, reason) of the EXIF entries of files (path, content); files without any give no rows.

    A null content gives none. An entry, a directory or a header that can't be read is a row with a reason and no value.
    """

    def walk(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                found = exif_block(bytes(data)) if data is not None else None
                rows += [(path, d, tag, TAGS.get(tag), value, reason) for d, tag, value, reason in (exif_entries(found) if found is not None else ())]
            yield pd.DataFrame(rows, columns=["path", "directory", "tag", "name", "value", "reason"])

    return files.select("path", "content").mapInPandas(walk, "path string, directory string, tag int, name string, value string, reason string")


#: Modes by a PNG's colour type and by a JPEG's components.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}


def header(data: bytes) -> tuple[str | None, int | None, int | None, str | None, int | None, str | None]:
    """(format, width, height, mode, bits, reason) from a file's first bytes, without decoding it."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            width, height, bits, colour = struct.unpack(">IIBB", data[16:26])
            return "PNG", width, height, PNG_MODES.get(colour), bits, None
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "GIF", *struct.unpack("<HH", data[6:10]), "P", 8, None
        if data[:2] == b"BM":
            width, height, _, bits = struct.unpack("<iiHH", data[18:30])
            return "BMP", width, abs(height), "RGBA" if bits == 32 else "RGB" if bits == 24 else "P", min(bits, 8), None
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(data):
                if data[at] != 0xFF:
                    return "JPEG", None, None, None, None, "no marker where one must be"
                if data[at + 1] in range(0xC0, 0xD0) and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                    bits, height, width, n = struct.unpack(">BHHB", data[at + 4 : at + 10])
                    return "JPEG", width, height, JPEG_MODES.get(n), bits, None
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
            return "JPEG", None, None, None, None, "no frame"
        if data[:4] in (b"II*\0", b"MM\0*"):
            tags = {tag: value for directory, tag, value, _ in exif_entries(data) if directory == "image" and value is not None}
            samples = int(tags.get(277, "1"))
            mode = {1: "L", 3: "RGB", 4: "RGBA"}.get(samples)
            return "TIFF", int(tags[256]), int(tags[257]), mode, int(tags.get(258, "1").split()[0]), None
    except (struct.error, KeyError, ValueError):
        return None, None, None, None, None, "header cut short"
    return None, None, None, None, None, "unknown format" if data else "empty"


def metadata(files: DataFrame) -> DataFrame:
    """(path, size, format, width, height, megapixels, mode, bits, reason) of files (path, content); a reason where it can't be told.

    Of a null content the size is 0 and the reason "empty".
    """

    def look(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(data) if data is not None else b""
                kind, width, height, mode, bits, reason = header(data)
                rows.append((path, len(data), kind, width, height, width * height / 1e6 if width is not None else None, mode, bits, reason))
            out = pd.DataFrame(rows, columns=["path", "size", "format", "width", "height", "megapixels", "mode", "bits", "reason"])
            yield out.astype({"width": "Int64", "height": "Int64", "bits": "Int64"})

    return files.select("path", "content").mapInPandas(look, "path string, size long, format string, width long, height long, megapixels double, mode string, bits long, reason string")
