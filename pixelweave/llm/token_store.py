"""Token ids in files of a binary format with Elias-Fano coded document boundaries.

A file holds a run of documents in ascending doc_id order. Its boundaries, the running counts of ids, rise, and so do
its doc_ids; both are Elias-Fano coded: the low bits of each value in a packed array, the high bits in unary in a bit
vector, with the place of every 256th one kept so that a select needs one short scan. That is about 2 + log2(ids per
document) bits for a boundary, and any document's ids are found without a table of 64-bit offsets.

File layout, little-endian: magic ``PWEF0001``; uint64: documents, ids, null doc_ids (first in order), bytes of each
id; int64 least doc_id; then two Elias-Fano sequences (boundaries, doc_ids less the least) and the ids.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import new_folder, stage, width
from pixelweave.llm.tokens import encoder

MAGIC = b"PWEF0001"
SAMPLE = 256
#: A task starts a new file when it holds so many bytes of ids; only a longer document makes a longer file.
FILE_BYTES = 32 << 20


class EliasFano:
    """A rising sequence of integers below 2**64 in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) + 1 if n else 0), np.uint8)
        bits[high] = 1
        low = np.zeros(0, np.uint8)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), high[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_buffer(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<QQQQQ", data, at)
        at += 40
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(n, low_bits, low, high, samples), at + a + b + 4 * c

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        piece = self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes()
        return int.from_bytes(piece, "little") >> first % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one on, whole bytes are counted, then bits of one byte."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = int(self.high[byte]) >> at % 8 << at % 8
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return (place - i << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        """All values, decoded at once."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        out = high << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: bytes, id_bytes: int) -> bytes:
    nulls = sum(d is None for d in doc_ids)
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.uint64)
    head = MAGIC + struct.pack("<QQQQq", len(doc_ids), int(ends[-1]), nulls, id_bytes, least)
    gaps = np.array([d - least for d in known], np.uint64)
    return b"".join([head, EliasFano.of(ends).to_bytes(), EliasFano.of(gaps).to_bytes(), ids])


class TokenFile:
    """A file's documents: ``doc_ids``, ``bounds`` (Elias-Fano) and the id array."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n, total, nulls, id_bytes, least = struct.unpack_from("<QQQQq", data, 8)
        view = memoryview(data)
        self.bounds, at = EliasFano.from_buffer(view, 48)
        gaps, at = EliasFano.from_buffer(view, at)
        self.n, self.doc_ids = n, [None] * nulls + [int(g) + least for g in gaps.values()]
        self.ids = np.frombuffer(view, f"<u{id_bytes}", total, at)

    def __len__(self) -> int:
        return self.n

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all, so that a task that runs twice does no harm."""
    scheme, _, rest = folder.partition(":")
    if scheme != "file" and not folder.startswith("/"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        own = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            f.write(data)
        store.move(own, f"{path}/{name}")
        return
    path = "/" + (rest if scheme == "file" else folder).lstrip("/")
    os.makedirs(path, exist_ok=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(data)
    os.replace(own, f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes token files ``part-<part>-<k>.pwef`` to ``folder``, doc_ids ascending over files and in each (nulls first).

    A null text is empty: ``end_id`` only. Rows that share a doc_id follow each other, ordered by a hash of their text, then by
    it, and may be in several files. A task writes a file as soon as it holds ``file_bytes`` of ids, so neither memory nor the
    size of files grows with the data. Returns the manifest (part, k, n_docs, n_ids), a row for each file.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), "mark"]
    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
        .repartitionByRange(2 * width(spark), *order)
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions(*order, "text")
    )

    def write(batches):
        enc, part, k, doc_ids, ids, size = encoder(vocabulary), None, 0, [], [], 0
        end = np.array([end_id], enc.dtype).tobytes()

        def put() -> pd.DataFrame:
            lengths = np.array([len(x) // enc.dtype.itemsize for x in ids])
            _put(folder, f"part-{part:06d}-{k:06d}.pwef", encode_file(doc_ids, lengths, b"".join(ids), enc.dtype.itemsize))
            return pd.DataFrame({"part": [part], "k": [k], "n_docs": [len(doc_ids)], "n_ids": [int(lengths.sum())]})

        for pdf in batches:
            part = int(pdf["part"].iloc[0]) if len(pdf) else part
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array, strict=True):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                ids.append(b"".join([enc[p] for p in enc.pieces(text)]) + end if isinstance(text, str) else end)
                size += len(ids[-1]) + 16
                if size >= file_bytes:
                    yield put()
                    k, doc_ids, ids, size = k + 1, [], [], 0
        if doc_ids:
            yield put()

    return stage(ordered.mapInPandas(write, "part int, k int, n_docs long, n_ids long"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """(part, k, place, doc_id, begin, n_tokens, ids_crc32[, ids]) of every document in the files of ``folder``."""

    def read(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                held = TokenFile(content)
                rows, begin = [], 0
                for i in range(len(held)):
                    ids = held.document(i)
                    row = (i, held.doc_ids[i], begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    rows.append((*row, ids.astype(np.int32)) if keep_ids else row)
                    begin += len(ids)
                names = ["place", "doc_id", "begin", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
                frame = pd.DataFrame(rows, columns=names)
                part, k = path.rpartition("part-")[2].partition(".")[0].split("-")
                frame.insert(0, "part", int(part))
                frame.insert(1, "k", int(k))
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    schema = "part int, k int, place long, doc_id long, begin long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pwef").load(folder).select("path", "content")
    return files.mapInPandas(read, schema)


def store_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all documents' ids and reads them back: doc_id, start (over all files), n_tokens, ids_crc32.

    An empty table writes no file and gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    manifest = write_token_files(docs, folder, vocabulary, end_id, file_bytes)
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # Running sums over the parts (a row for each task) and inside a part.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("k")) - F.col("n_ids")
    before = manifest.join(parts, "part").select("part", "k", (F.col("base") + inside).alias("before"))
    return read_token_files(spark, folder).join(F.broadcast(before), ["part", "k"]).select(  # a row for each file
        "doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )
