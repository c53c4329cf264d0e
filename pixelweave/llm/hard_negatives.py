"""Hard negatives by one-dimensional distance keys.

The largest inner product becomes the nearest neighbour: a row's vector gets one more component, sqrt(M^2 - |x|^2) with M the largest
norm of its length, an anchor's gets 0; then the squared distance is |q|^2 + M^2 - 2 q.x. Each row is stored under its key,
(nearest pivot, distance to it), sorted; ranges of keys are cells with a least and a greatest distance. By the triangle
inequality a cell bounds the scores of its rows for every anchor. A search scans the key intervals nearest to the annulus that it
wants, then wider ones, round by round, with its best scores so far as the bound, until no unread interval can hold a better row.
Where scores have a ceiling (negatives), the annulus starts there; so the rows that are too near are never read for themselves.

A round is one exchange: anchors go to the cells that they need, a cell's rows to the batches of anchors that need it, both in parts
of bounded size, and only the best few of a tile leave it. Cells are of bounded number, so what is sent to all tasks is too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import stage, unstage, width

#: At most so many pivots for a length of vectors, ranges of distance for each, and lengths, the commonest, that have any.
MAX_PIVOTS, MAX_RANGES, PIVOT_LENGTHS = 64, 64, 8
#: Rows of a cell's part, and anchors of a batch, at most; fewer where there would be too few tiles for the session's width.
TILE = 16384
#: Shares of all rows that the rounds of a search may read; the last ones read whatever is left.
SHARES = (1 / 64, 1 / 8, 1.0)
#: A null id's stand-in, which sorts last, and the bound of scores (of vectors that no real table holds).
NO_ID, MOST = (1 << 63) - 1, 1 << 61
_BLOCK = 256
_EXACT = 2.0**53

ROWS = "uid long, id long, label long, vector array<double>, dims int, norm double"


def _matrices(batch: pa.RecordBatch):
    """(length, row numbers, matrix) of the column ``vector``."""
    column = batch.column(batch.schema.get_field_index("vector"))
    sizes = np.diff(column.offsets.to_numpy())
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield dims, rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims)


class Cells:
    """Pivots, ranges of distance and what cells hold, for lengths of vectors that have pivots; others are one cell."""

    def __init__(self):
        self.most: dict[int, float] = {}  # M^2
        self.pivots: dict[int, np.ndarray] = {}
        self.bounds: dict[int, list[np.ndarray]] = {}
        self.low: dict[int, np.ndarray] = {}  # by cell, as high and n
        self.high: dict[int, np.ndarray] = {}
        self.n: dict[int, np.ndarray] = {}
        self.parts: dict[int, np.ndarray] = {}

    def more(self, dims: int, x: np.ndarray) -> np.ndarray:
        """The component that makes all norms equal."""
        return np.sqrt(np.maximum(self.most[dims] - np.einsum("ij,ij->i", x, x), 0))

    def distances(self, dims: int, x: np.ndarray, more: np.ndarray) -> np.ndarray:
        p = self.pivots[dims]
        square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", p, p) - 2 * x @ p.T
        return np.sqrt(np.maximum(square + (more[:, None] - self.more(dims, p)) ** 2, 0))

    def keys(self, dims: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if dims not in self.pivots:
            return np.zeros(len(x), np.int64), np.zeros(len(x))
        d = self.distances(dims, x, self.more(dims, x))
        pivot = d.argmin(1)
        return pivot, d[np.arange(len(x)), pivot]

    def cell(self, dims: int, pivot: np.ndarray, distance: np.ndarray) -> np.ndarray:
        if dims not in self.pivots:
            return np.zeros(len(pivot), np.int64)
        out = np.zeros(len(pivot), np.int64)
        for p in np.unique(pivot):
            own = pivot == p
            out[own] = p * MAX_RANGES + np.searchsorted(self.bounds[dims][p], distance[own], side="left")
        return out

    def parts_of(self, dims: int) -> np.ndarray:
        return self.parts.get(dims, np.ones(1, np.int64))

    def scores(self, dims: int, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each cell's rows can have with each anchor, with room for rounding."""
        if dims not in self.pivots:
            return np.full((len(anchors), 1), -np.inf), np.full((len(anchors), 1), np.inf)
        d = np.repeat(self.distances(dims, anchors, np.zeros(len(anchors))), MAX_RANGES, axis=1)
        near, far = np.maximum(0, np.maximum(d - self.high[dims], self.low[dims] - d)), d + self.high[dims]
        level = (np.einsum("ij,ij->i", anchors, anchors) + self.most[dims])[:, None]
        slack = 1e-9 * level + 1
        return (level - far**2) / 2 - slack, (level - near**2) / 2 + slack


def _keyed(cells: Cells):
    """Adds pivot, distance, cell and part."""

    def add(batches):
        for batch in batches:
            n = batch.num_rows
            pivot, distance, cell, part = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            uid = batch.column(0).to_numpy().astype(np.uint64)
            for dims, rows, x in _matrices(batch):
                p, d = cells.keys(dims, x)
                c = cells.cell(dims, p, d) if dims in cells.bounds or dims not in cells.pivots else p
                pivot[rows], distance[rows], cell[rows] = p, d, c
                parts = cells.parts_of(dims)
                if len(parts) > c.max(initial=0):
                    part[rows] = (uid[rows] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[c]
            more = [pa.array(pivot, pa.int32()), pa.array(distance), pa.array(cell, pa.int32()), pa.array(part, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "pivot", "distance", "cell", "part"])

    return add


_KEYED = ROWS + ", pivot int, distance double, cell int, part int"


class Index:
    """All rows by (length, pivot, distance), in cells; ``rows``: id, label, vector, with labels of any type."""

    def __init__(self, rows: DataFrame, pivots: int | None = None, tile: int | None = None):
        spark = rows.sparkSession
        vector = F.col("vector").cast("array<double>")
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label"), vector.alias("vector"))
        rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
        norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        rows = rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "vector", F.size("vector").alias("dims"), norm.alias("norm"))
        self.rows = stage(rows, "vectors")
        lengths = self.rows.groupBy("dims").agg(F.count("*").alias("n"), F.max("norm").alias("most"))
        common = lengths.orderBy(F.desc("n"), "dims").limit(PIVOT_LENGTHS).collect()
        largest = max((r.n for r in common), default=0)
        self.tile = tile or max(512, min(TILE, -(-largest // math.ceil(math.sqrt(2 * width(spark))))))
        self.cells = cells = Cells()
        for r in common:
            count = min(MAX_PIVOTS, pivots or math.ceil(math.sqrt(r.n / self.tile)))
            if count > 1 and r.dims and math.isfinite(r.most):
                cells.most[r.dims] = r.most
                some = self.rows.where(F.col("dims") == r.dims).orderBy(F.xxhash64("uid"), "uid").limit(count)
                cells.pivots[r.dims] = np.array([x.vector for x in some.collect()])
        # Of any length, those with more rows than a part: the larger their number, the longer the vectors, so they are few.
        for r in lengths.where(F.col("n") > self.tile).collect():
            if r.dims not in cells.pivots:
                cells.parts[r.dims] = np.array([-(-r.n // self.tile)])
        if cells.pivots:
            self._cut(common)
        keyed = self.rows.mapInArrow(_keyed(cells), _KEYED)
        order = ["dims", "pivot", "distance"]
        self.index = stage(keyed.repartitionByRange(width(spark), *order).sortWithinPartitions(*order), "index")
        self.total = self.index.count()

    def _cut(self, common) -> None:
        """Ranges of distance with about a tile of rows each, then what each cell holds: rows of a bounded number."""
        cells = self.cells
        long = self.rows.where(F.col("dims").isin(*cells.pivots))
        keys = long.mapInArrow(_keyed(cells), _KEYED).select("dims", "pivot", "distance")
        ranges = {r.dims: max(1, min(MAX_RANGES, round(r.n / len(cells.pivots[r.dims]) / self.tile))) for r in common if r.dims in cells.pivots}
        shares = [k / MAX_RANGES for k in range(1, MAX_RANGES)]
        for dims in cells.pivots:
            cells.bounds[dims] = [np.zeros(0)] * len(cells.pivots[dims])
        for r in keys.groupBy("dims", "pivot").agg(F.percentile_approx("distance", shares, 10_000).alias("at")).collect():
            step = MAX_RANGES / ranges[r.dims]
            cells.bounds[r.dims][r.pivot] = np.unique([r.at[round(k * step) - 1] for k in range(1, ranges[r.dims])])
        held = long.mapInArrow(_keyed(cells), _KEYED).groupBy("dims", "cell").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
        for dims, pivots in cells.pivots.items():
            size = len(pivots) * MAX_RANGES
            cells.n[dims], cells.parts[dims] = np.zeros(size, np.int64), np.ones(size, np.int64)
            cells.low[dims], cells.high[dims] = np.zeros(size), np.zeros(size)
        for r in held.collect():
            cells.n[r.dims][r.cell], cells.low[r.dims][r.cell], cells.high[r.dims][r.cell] = r.n, r.low, r.high
            cells.parts[r.dims][r.cell] = -(-r.n // self.tile)

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(uid, j, score, id): for each anchor (rows of the index with arrays low and high) and place j of the arrays its ``k`` best
        other rows with the same label, or with another, and a score from low to high."""
        parts = anchors.groupBy("dims", "pivot").agg(F.count("*").alias("anchors"))
        batch = F.pmod(F.xxhash64("uid"), F.ceil(F.col("anchors") / self.tile)).cast("int")
        state = anchors.join(parts, ["dims", "pivot"]).withColumn("batch", batch).withColumn("seen", F.lit(b""))
        state = state.select("uid", "label", "vector", "dims", "pivot", "batch", "low", "high", "seen")
        found = None
        for share in (*SHARES, 1.0):
            probes = stage(state.mapInArrow(_probes(self.cells, share * self.total, k), _PROBES), "probes")
            if probes.isEmpty():
                break
            keys = ["dims", "cell", "part"]
            # The same table read apart: both sides of the grouping must not share columns.
            pairs = probes.sparkSession.read.schema(probes.schema).parquet(probes.staged_at).select("batch", "home", *keys).distinct()
            sent = self.index.select("uid", "id", "label", "vector", *keys).join(pairs, keys)
            tile = ["batch", "home", *keys]
            best = probes.groupBy(*tile).cogroup(sent.groupBy(*tile)).applyInArrow(_tile(k, same), _BEST)
            ahead = Window.partitionBy("uid", "j").orderBy(F.desc("score"), "id", "other")
            every = best if found is None else best.unionByName(found)
            now = stage(every.withColumn("place", F.row_number().over(ahead)).where(F.col("place") <= k).drop("place"), "best")
            # The k-th score, once there are k, is the bound of what is worth reading.
            kth = now.groupBy("uid", "j").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            least = kth.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("j", "least"))).alias("least"))
            seen = probes.groupBy("uid").agg(F.max("after").alias("after"))
            raised = F.when(F.col("least").isNull(), F.col("low")).otherwise(F.transform("low", lambda x, j: F.greatest(x, F.coalesce(F.col("least")[j], x))))
            old = state
            state = stage(old.join(seen, "uid", "left").join(least, "uid", "left").withColumn("low", raised).withColumn("seen", F.coalesce("after", "seen")).select(*old.columns), "anchors")
            unstage(probes, *([found] if found is not None else []))
            found = now
        return found if found is not None else stage(self.index.sparkSession.createDataFrame([], _BEST), "best")


_PROBES = "uid long, label long, vector array<double>, low array<bigint>, high array<bigint>, dims int, cell int, part int, batch int, home int, after binary"
_BEST = "uid long, j int, score long, id long, other long"


def _probes(cells: Cells, rows: float, k: int):
    """Each anchor at the parts of the unread cells that it needs, the nearest to its annuli first, as far as ``rows`` rows go."""

    def choose(batches):
        for batch in batches:
            names = batch.schema.names
            lows, highs, seens = (batch.column(names.index(c)).to_pylist() for c in ("low", "high", "seen"))
            source, cell, part, after = [], [], [], []
            for dims, at, x in _matrices(batch):
                least, most = cells.scores(dims, x)
                size = cells.n.get(dims, np.ones(1, np.int64))
                parts = cells.parts_of(dims)
                for r, row in enumerate(at):
                    seen = np.unpackbits(np.frombuffer(seens[row], np.uint8), count=len(size)).astype(bool) if seens[row] else np.zeros(len(size), bool)
                    gap = np.full(len(size), np.inf)
                    for low, high in zip(map(float, lows[row]), map(float, highs[row]), strict=True):
                        wanted = (low <= high) & (least[r] <= high) & (most[r] >= low)
                        gap = np.where(wanted, np.minimum(gap, np.maximum(0.0, high - most[r])), gap)
                    gap[seen | (size == 0)] = np.inf
                    order = np.argsort(gap, kind="stable")
                    order = order[np.isfinite(gap[order])]
                    if not len(order):
                        continue
                    order = order[np.cumsum(size[order]) - size[order] < rows]
                    seen[order] = True
                    bits = np.packbits(seen).tobytes()
                    for c in order.tolist():
                        for p in range(int(parts[c])):
                            source.append(row), cell.append(c), part.append(p), after.append(bits)
            for a in range(0, len(source), 10_000):
                s = slice(a, a + 10_000)
                taken = batch.take(pa.array(source[s]))
                column = lambda c: taken.column(names.index(c))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [*(column(c) for c in ("uid", "label", "vector", "low", "high", "dims")), pa.array(cell[s], pa.int32()), pa.array(part[s], pa.int32()), column("batch"), column("pivot"), pa.array(after[s], pa.binary())],
                    ["uid", "label", "vector", "low", "high", "dims", "cell", "part", "batch", "home", "after"],
                )

    return choose


def _matrix(table: pa.Table, dims: int, name: str = "vector") -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), dims)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: exact ones, as doubles where these hold them, else cut to ``MOST``."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] * max(len(b), 1) >= _EXACT:
        whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
        return np.clip(whole(a) @ whole(b).T, -MOST, MOST)
    return a @ b.T


def _tile(k: int, same: bool):
    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """The best ``k`` of these rows for each anchor and place of its bounds."""
        out = {c: [] for c in ("uid", "j", "score", "id", "other")}
        if len(anchors) and len(rows):
            dims = int(anchors["dims"][0].as_py())
            rows = rows.sort_by([("id", "ascending"), ("uid", "ascending")])  # of equal scores the first row is the best
            a, b = _matrix(anchors, dims), _matrix(rows, dims)
            mine, my_label = anchors["uid"].to_numpy(), anchors["label"].to_numpy()
            uid, ids, label = (rows[c].to_numpy() for c in ("uid", "id", "label"))
            lows, highs = anchors["low"].to_pylist(), anchors["high"].to_pylist()
            n, back = len(uid), np.arange(len(uid))
            for s in range(0, len(a), _BLOCK):
                scores = _products(a[s : s + _BLOCK], b)
                alike = my_label[s : s + _BLOCK, None] == label
                fit = (alike & (mine[s : s + _BLOCK, None] != uid)) if same else ~alike
                keys = scores * n - back  # tells all apart: the higher score, then the earlier row
                for r in range(len(scores)):
                    for j, (low, high) in enumerate(zip(lows[s + r], highs[s + r], strict=True)):
                        at = np.flatnonzero(fit[r] & (scores[r] >= low) & (scores[r] <= high))
                        if len(at) > k:
                            at = at[np.argpartition(-keys[r][at], k)[:k]] if keys.dtype != object else np.array(sorted(at, key=lambda i: -keys[r][i])[:k])  # noqa: B023
                        for c, v in zip(out, (np.full(len(at), mine[s + r]), np.full(len(at), j), scores[r][at], ids[at], uid[at]), strict=True):
                            out[c].append(np.asarray(v, np.int64))
        flat = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
        return pa.table({c: pa.array(v, pa.int32() if c == "j" else pa.int64()) for c, v in flat.items()})

    return best


def _whole_tenths(score: Column, tenths: int, up: bool) -> Column:
    """A non-negative score's ``tenths`` tenths, rounded to a whole number up or down."""
    return F.floor((score.cast("decimal(38,0)") * tenths + (9 if up else 0)) / 10).cast("long")


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, pivots: int | None = None, tile: int | None = None
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows``: id, label, vector of whole numbers.

    Anchors are the rows for whose id ``anchors``, a condition, holds. A row's score is its inner product with the anchor, the higher the
    better, ties by smaller id. An anchor's positives are its best other rows of the same label; for each, the negatives are the
    best rows of other labels whose score is from ``low`` to ``high`` tenths of the positive's, so there are none where that is negative.

    Rows with a null label, a null vector or a null or non-finite component take no part. Vectors of different lengths have no
    score with each other; empty ones score 0. A null id is no anchor's, sorts last and stays null. Repeated ids are rows of their own. Scores
    are exact and cut at 2^61. Columns but those three are not read; an empty table gives no rows.
    """
    index = Index(rows.select("id", "label", "vector"), pivots, tile)
    chosen = index.index.where((F.col("id") != NO_ID) & anchors)
    bound = lambda v: F.array(F.lit(v)).cast("array<bigint>")
    first = chosen.withColumn("low", bound(-2 * MOST)).withColumn("high", bound(2 * MOST))
    best = index.search(first, positives, same=True)
    wanted = best.where("score >= 0").groupBy("uid").agg(F.sort_array(F.collect_set("score")).alias("levels"))
    second = chosen.join(wanted, "uid").withColumn("low", F.transform("levels", lambda s: _whole_tenths(s, low, True)))
    second = second.withColumn("high", F.transform("levels", lambda s: _whole_tenths(s, high, False)))
    found = index.search(second, negatives, same=False)
    level = wanted.select("uid", F.posexplode("levels").alias("j", "positive_score"))
    pairs = best.select("uid", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"), F.col("other").alias("positive")).join(level, ["uid", "positive_score"])
    out = pairs.join(found.select("uid", "j", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"), "other"), ["uid", "j"])
    rank = F.row_number().over(Window.partitionBy("uid", "positive").orderBy(F.desc("negative_score"), "negative_id", "other"))
    out = out.withColumn("rank", rank).join(chosen.select("uid", F.col("id").alias("anchor_id")), "uid")
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select("anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")


def mined(embeddings: DataFrame) -> DataFrame:
    """``hard_negatives`` of vec_id, embedding and label: every label of a vec_id that 7 divides is moved on by one of ten, components become
    floor(256 * x), and anchors are the rows whose vec_id 100 divides."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # Doubles beyond 2^52 are whole numbers already.
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < 2.0**44, F.floor(256 * x).cast("double")).otherwise(256 * x))
    return hard_negatives(embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("vector")), F.col("id") % 100 == 0)
