"""What the operators of this subpackage share: written stages, word arrays and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as in ``[^\x20\x09-\x0D]+``.
WHITE_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    global _own_folder
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/pixelweave/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, onto: DataFrame | None = None) -> DataFrame:
    """``df`` as a written table in the shared folder: lineage is cut and lost executors cost no recomputation.

    With ``onto``, a staged table of the same columns, its rows and those of ``df``, in one table.
    """
    spark = df.sparkSession
    at = onto.staged_at if onto is not None else new_folder(spark, name)
    df.write.mode("append").option("compression", "zstd").parquet(at)
    settle(spark)
    out = spark.read.schema(df.schema).parquet(at)
    out.staged_at = at
    return out


#: Seconds from one collection of the driver's garbage to the next, at least.
SETTLE = 3.0
_settled = 0.0


def settle(spark: SparkSession) -> None:
    """Has the driver collect its garbage and give free memory back, now and then: after some hundred small plans it else keeps what they took."""
    global _settled
    if time.monotonic() - _settled < SETTLE:
        return
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Exception):  # only some Java versions have this command
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    _settled = time.monotonic()


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that hold more than one in so many of all rows are hot, so fewer than this many keys are.
HOT = 4096


def attach(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, whose column ``n`` says how many of the ``total`` rows have its keys.

    Hot keys, fewer than ``HOT``, go to every task; rows of the others are shuffled to their keys. So rows of a common key
    stay where they are, and what is sent to all tasks has a bound.
    """
    hot = table.where(F.col("n") > max(total // HOT, 64)).withColumn("is_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.where("is_hot is null").select(*rows.columns).join(table.where(F.col("n") <= max(total // HOT, 64)), keys)
    return marked.where("is_hot").drop("is_hot").unionByName(cold)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, by which stages are cut."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Gives a Python worker's free memory back to the system: Spark keeps workers, and what their allocators hold, from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


# Word arrays. A text's words are hashed without making a Python object for each: a word's hash is a polynomial in its
# bytes, taken from running sums over the whole buffer.

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LIMIT = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_LIMIT, 1 << int(n).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers.clear()
        _powers[size] = tuple(tables)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE_SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts: ``hashes`` in order, ``ends`` (running count by text), byte places in ``data``."""

    def __init__(self, texts: list[bytes], lower: bool = False, spaces: np.ndarray = _SPACE):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        if lower:
            raw = _LOWER[raw]
        inside = ~spaces[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.stops = edges[0::2], edges[1::2]
        text_stops = np.cumsum([len(t) + 1 for t in texts])
        self.ends = np.searchsorted(self.starts, text_stops)
        up, down = _power_tables(len(raw))
        sums = np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)])
        before = np.where(self.starts > 0, sums[np.maximum(self.starts, 1) - 1], U64(0))
        self.hashes = mix((sums[self.stops - 1] - before) * down[self.starts] + (self.stops - self.starts).astype(U64))
        self.begins = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.counts = self.ends - self.begins


def in_chunks(texts: list[bytes]):
    """(first, last) ranges of texts of bounded size together; a longer text is a range of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _LIMIT:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def to_bytes(texts) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def rolling(hashes: np.ndarray, k: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A hash of each ``k`` consecutive entries (none where fewer are left)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, q = np.zeros(n, U64), 1
    for j in range(k):
        out += hashes[j : j + n] * U64(q)
        q = q * seed & (1 << 64) - 1
    return mix(out)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node in ``edges`` (a, b); a, b of one ordered type.

    Large-star and small-star rounds: both only send each node to its smallest neighbour, so edges never multiply.
    A round is a written table; the rounds needed grow with the logarithm of the longest chain.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    before, written = None, [now]
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = low.where("u <> m").select("u", F.col("m").alias("v"))
        star = stage(large.union(kept).distinct(), f"{name}-large")
        unstage(*written)
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u")
        now = stage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct(),
            f"{name}-small",
        )
        unstage(star)
        written = [now]
        # Done when every node has one parent and no parent has a parent.
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == before:
            break
        before = (row.n, row.h)
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
