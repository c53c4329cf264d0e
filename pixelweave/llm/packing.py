"""Best-fit packing of documents' tokens into sequences of a fixed capacity.

Best-fit decreasing is decided on the histogram of piece lengths: it has at most ``capacity`` rows whatever the number
of documents, and best fit treats pieces of one length, and bins of one remaining capacity, alike. A segment tree over
remaining capacities finds the tightest open bins for a length in logarithmic time, for whole runs of equal pieces at
once. The plan it gives (which ranks of a length go to which bins) is joined back to the pieces by length and rank.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm.common import stage, width
from pixelweave.llm.tokens import CACHE, encoder


class OpenBins:
    """Open bins by remaining capacity: a tree of maxima's presence, and runs [first, last) of bin numbers at its leaves."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = np.zeros(2 * self.size, np.int64)
        self.runs = [deque() for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at //= 2

    def put(self, room: int, first: int, last: int) -> None:
        if first < last:
            self.runs[room].append((first, last))
            self._add(room, last - first)

    def take(self, room: int) -> tuple[int, int]:
        first, last = self.runs[room].popleft()
        self._add(room, first - last)
        return first, last

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of an open bin that is at least ``need``."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, from_rank, to_rank, first_bin, each, offset): the pieces of that length with ranks from_rank to
    to_rank - 1 go to bins first_bin, first_bin + 1, ..., ``each`` to a bin, the first of them at ``offset``.
    """
    bins, plan, opened = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, last = opened, opened + -(-left // each)
                opened = last
            else:
                each = room // length
                first, last = bins.take(room)
            whole = min(last - first, left // each)
            if whole:
                plan.append((length, rank, rank + whole * each, first, each, capacity - room))
                bins.put(room - each * length, first, first + whole)
                rank, left, first = rank + whole * each, left - whole * each, first + whole
            if left and first < last:
                plan.append((length, rank, rank + left, first, left, capacity - room))
                bins.put(room - left * length, first, first + 1)
                rank, left, first = rank + left, 0, first + 1
            bins.put(room, first, last)
    return plan


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]
)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, keep_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Each document's ids, then ``end_id``, cut into pieces of at most ``capacity``; only the first piece may be shorter.

    A null text is empty: one piece that holds ``end_id`` only. With ``keep_ids`` the ids are returned too.
    """
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])

    def cut(batches):
        enc = encoder(vocabulary, cache)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                out: list[tuple] = []
                part = pdf.iloc[at : at + 1000]
                for doc_id, text in zip(part["doc_id"].array, part["text"].array, strict=True):
                    ids = np.append(enc.ids(text if isinstance(text, str) else ""), end_id).astype("<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        row = (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                        out.append((*row, ids[a:b].astype(np.int32)) if keep_ids else row)
                frame = pd.DataFrame(out, columns=schema.names)
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset``.

    Only ``doc_id`` and ``text`` of ``docs`` are read; other columns may have any name. Null texts are empty documents;
    null and repeated doc_ids are packed as rows of their own; an empty table gives no rows. Pieces of one length are
    ranked by salted groups whose sizes are summed first, so a length that many documents share is never one task's.
    Which of several equal rows takes which place is not defined; the set of rows is.
    """
    spark = docs.sparkSession
    salts = 4 * width(spark)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    pieces = stage(token_pieces(docs, vocabulary, capacity, end_id, keep_ids, cache).withColumn("salt", salt), "pieces")
    groups = stage(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    before = groups.select(
        "length", "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    histogram = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = best_fit_plan(histogram, capacity)
    plan_df = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "plan_length long, from_rank long, to_rank long, first_bin long, each long, at long")
    # Within a salted group pieces go in order; a group's ranks are cut against the plan's ranges of that length.
    in_group = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (
        pieces.withColumn("in_group", in_group)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("in_group") - 1)
    )
    placed = ranked.join(
        F.broadcast(plan_df),  # bounded by ``capacity``: a few rows for each length, none for each document
        (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")),
    )
    k = F.col("rank") - F.col("from_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.col("length") * (k % F.col("each"))).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
