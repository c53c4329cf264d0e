"""Near-duplicate vectors by an exact metric range join.

The angle between unit vectors is a metric. Pivots partition the vectors: each belongs to the cell of its nearest pivot.
A cell's reach is the largest angle from its pivot to one of its own; by the triangle inequality only vectors within
that reach and the threshold of a pivot can have a partner there, so only they are replicated to the cell. Cells
then join by themselves, in tiles of bounded size, so a hot cell is many tasks. Equal vectors are one vector with a weight.

A tile holds at most about 2 x ``TILE`` vectors. It finds candidates in single precision with room for its rounding, decides
them in double precision, and folds each block of links to smallest labels at once, so dense groups take no memory.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import components, stage, width

#: At most so many pivots for a length of vectors, and so many lengths, the commonest, that have pivots; others are one cell each.
MAX_PIVOTS, PIVOT_LENGTHS = 256, 8
#: Vectors in one side of a tile, at most; fewer where there would be too few tiles for the session's width.
TILE = 16384
_BLOCK = 256
_SLACK = 1e-9
#: Single-precision cosines of unit vectors are off by less than this for a component.
_SINGLE = 2.0**-23


def _unit(batches):
    """Adds the unit vector in double precision; null where there is none."""
    for pdf in batches:
        units = []
        for v in pdf["vector"]:
            x = None if v is None else np.array([np.nan if y is None else y for y in v], float)
            if x is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
                x = x / np.abs(x).max()
                units.append(x / math.sqrt(float(x @ x)))
            else:
                units.append(None)
        yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "unit": units})


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _by_length(batch: pa.RecordBatch):
    """(row numbers, matrix) for each length of vectors in the column ``unit``."""
    column = batch.column(batch.schema.get_field_index("unit"))
    sizes = np.diff(column.offsets.to_numpy())
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield dims, rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Cells:
    """For each length of vectors: pivots, the reach of their cells, and the cells' numbers of member and guest parts."""

    def __init__(self, limit: float):
        self.limit, self.pivots, self.reach = limit, {}, {}
        self.parts: dict[int, np.ndarray] = {}

    def angles(self, dims: int, vectors: np.ndarray) -> np.ndarray:
        return _angles(vectors, self.pivots[dims]) if dims in self.pivots else np.zeros((len(vectors), 1))

    def guests(self, dims: int, angles: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Whether a vector may have a partner in a cell after its own; pairs meet in the later of their two cells."""
        if dims not in self.pivots:
            return np.zeros(angles.shape, bool)
        return (angles <= self.reach[dims] + self.limit + _SLACK) & (np.arange(angles.shape[1]) > home[:, None])

    def parts_of(self, dims: int) -> np.ndarray:
        return self.parts.get(dims, np.array([[1, 0]]))


def _census(cells: Cells, with_guests: bool):
    """(dims, cell, n, guests, reach) of each batch: bounded by the number of pivots."""

    def count(batches):
        for batch in batches:
            out = []
            for dims, _, vectors in _by_length(batch):
                angles = cells.angles(dims, vectors)
                home = angles.argmin(1)
                own = angles[np.arange(len(home)), home]
                n, reach = np.bincount(home, minlength=angles.shape[1]), np.full(angles.shape[1], -10.0)
                np.maximum.at(reach, home, own)
                guests = cells.guests(dims, angles, home).sum(0) if with_guests else n * 0
                out += [(dims, int(c), int(n[c]), int(guests[c]), float(reach[c])) for c in np.flatnonzero(n + guests)]
            yield pa.RecordBatch.from_pylist([dict(zip(("dims", "cell", "n", "guests", "reach"), r, strict=True)) for r in out], _CENSUS)

    return count


_CENSUS = pa.schema([("dims", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("guests", pa.int64()), ("reach", pa.float64())])


def _replicas(cells: Cells):
    """Each vector as a member of its own cell and as a guest of the cells after it that may hold a partner.

    Members are dealt to parts, and so are guests. A tile joins two parts of members or one of members with one of guests:
    a member goes to a tile for each part of its cell, a guest to one for each part of members there.
    """

    def spread(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy()
            for dims, rows, vectors in _by_length(batch):
                angles = cells.angles(dims, vectors)
                home, parts = angles.argmin(1), cells.parts_of(dims)
                mix = (keys[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                row, cell, low, high, own = [], [], [], [], []

                def send(r, c, a, b, mine):
                    row.append(rows[r]), cell.append(c), low.append(a), high.append(b), own.append(mine)  # noqa: B023

                n, g = parts[home, 0], parts[home, 1]
                part, every = mix % n, np.arange(len(home))
                for other in range(int((n + g).max(initial=0))):
                    r = every[other < n[every] + g[every]]
                    o = np.full(len(r), other)
                    guest = o >= n[r]
                    send(r, home[r], np.where(guest, part[r], np.minimum(part[r], o)), np.where(guest, o, np.maximum(part[r], o)), part[r])
                r, c = np.nonzero(cells.guests(dims, angles, home))
                n, g = parts[c, 0], parts[c, 1]
                part = n + mix[r] % np.maximum(g, 1)
                for other in range(int(n.max(initial=0))):
                    k = np.flatnonzero(other < n)
                    send(r[k], c[k], np.full(len(k), other), part[k], part[k])
                row, cell, low, high, own = (np.concatenate(x).astype(np.int64) for x in (row, cell, low, high, own))
                for a in range(0, len(row), 20_000):
                    s = slice(a, a + 20_000)
                    taken = batch.take(pa.array(row[s]))
                    more = [pa.array(np.full(len(taken), dims), pa.int32())] + [pa.array(x[s], pa.int32()) for x in (cell, low, high, own)]
                    yield pa.RecordBatch.from_arrays([*taken.columns, *more], [*taken.schema.names, "dims", "cell", "low", "high", "part"])

    return spread


class Labels:
    """Smallest labels over links that come in blocks: a forest whose trees are what the links so far connect."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.up[x]
        while ((higher := self.up[root]) != root).any():
            root = higher
        self.up[x] = root
        return root

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _join(cosine: float):
    def join(table: pa.Table) -> pa.Table:
        """A tile: how many others each vector links with here, and one that leads to the smallest it is connected with."""
        table = table.sort_by("key")  # a smaller place is a smaller key
        key, weight, part = (table[c].to_numpy() for c in ("key", "weight", "part"))
        low, high, dims = (int(table[c][0].as_py()) for c in ("low", "high", "dims"))
        x = table["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        a = np.flatnonzero(part == low)
        b = a if low == high else np.flatnonzero(part == high)
        found, labels = np.zeros(len(key), np.int64), Labels(len(key))
        left, right = x[a].astype(np.float32), x[b].astype(np.float32)
        for s in range(0, len(a), _BLOCK):
            # Within one part only the pairs on one side of the diagonal are compared.
            first = s if low == high else 0
            near = left[s : s + _BLOCK] @ right[first:].T >= cosine - _SINGLE * (dims + 4)
            for t in range(0, len(near), 32):  # the pairs of some rows at a time are decided
                r, c = np.nonzero(near[t : t + 32])
                r, c = s + t + r, first + c
                if low == high:
                    r, c = r[r < c], c[r < c]
                for u in range(0, len(r), 100_000):
                    p, q = a[r[u : u + 100_000]], b[c[u : u + 100_000]]
                    sure = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                    p, q = p[sure], q[sure]
                    np.add.at(found, p, weight[q])
                    np.add.at(found, q, weight[p])
                    labels.link(p, q)
        root = labels.find(np.arange(len(key)))
        some = found > 0
        return pa.table({"key": key[some], "links": found[some], "low": key[root[some]]})

    return join


def near_vectors(vectors: DataFrame, cosine: float = 0.9, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", tile: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links are cosines of at least ``cosine``, in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of different
    lengths, of which there may be any number. Equal vectors link. Rows with a null vec_id take part; a component of such only
    has a null component_id and kept false. Repeated vec_ids are rows of their own. Other columns are not read; an empty
    table gives no rows. Pivots are a fixed-size choice (by hash) of at most ``MAX_PIVOTS`` vectors of a length; they only
    decide where pairs meet. Equal vectors are told apart from others by 64-bit hashes.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    units = stage(rows.mapInPandas(_unit, "vec_id long, unit array<double>"), "units")
    groups = units.where("unit is not null").groupBy(F.xxhash64("unit").alias("key")).agg(F.first("unit").alias("unit"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    groups = stage(groups, "groups")
    held = groups.select("key", "unit", "weight")
    sizes = groups.groupBy(F.size("unit").alias("dims")).agg(F.count("*").alias("n"))
    # Parts of equal size, small enough for a tile's memory and for some tiles for each task that runs at once.
    common = sizes.orderBy(F.desc("n"), "dims").limit(PIVOT_LENGTHS).collect()
    most = max((r.n for r in common), default=0)
    tile = tile or max(1024, min(TILE, -(-most // math.ceil(math.sqrt(2 * width(spark))))))
    cells = Cells(math.acos(cosine))
    for r in common:
        if (k := min(pivots or -(-r.n // TILE), MAX_PIVOTS)) > 1:
            cells.pivots[r.dims] = np.array([x.unit for x in held.where(F.size("unit") == r.dims).orderBy("key").limit(k).collect()])
    # Members and reach of the cells, then, the reaches known, guests: a row for each cell; lengths of one part need none.
    census = "dims int, cell int, n long, guests long, reach double"
    for with_guests in (False, True) if cells.pivots else (True,):
        counted = held.mapInArrow(_census(cells, with_guests), census).groupBy("dims", "cell").agg(F.sum("n").alias("n"), F.sum("guests").alias("guests"), F.max("reach").alias("reach"))
        if not with_guests:
            for r in counted.where(F.col("dims").isin(*cells.pivots)).collect():
                cells.reach.setdefault(r.dims, np.full(len(cells.pivots[r.dims]), -10.0))[r.cell] = r.reach
            continue
        for r in counted.where((F.col("n") > tile) | F.col("dims").isin(*cells.pivots)).collect():
            parts = cells.parts.setdefault(r.dims, np.tile([1, 0], (len(cells.pivots.get(r.dims, [0])), 1)))
            parts[r.cell] = max(1, -(-r.n // tile)), -(-r.guests // tile)
    schema = "key long, unit array<double>, weight long, dims int, cell int, low int, high int, part int"
    spread = held.mapInArrow(_replicas(cells), schema)
    linked = stage(spread.groupBy("dims", "cell", "low", "high").applyInArrow(_join(cosine), "key long, links long, low long"), "vector-links")
    totals = linked.groupBy("key").agg(F.sum("links").alias("links"))
    named = components(linked.select(F.col("key").alias("a"), F.col("low").alias("b")), "vectors")
    groups = groups.select("weight", "least", "key").join(totals, "key", "left").join(named.withColumnRenamed("node", "key"), "key", "left")
    groups = groups.withColumn("component", F.coalesce("component", "key"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = groups.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = units.withColumn("key", F.when(F.col("unit").isNotNull(), F.xxhash64("unit"))).join(groups, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
