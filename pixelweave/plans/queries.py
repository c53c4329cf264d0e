"""The registered queries over the driver's tables, with the SQL that each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.functions import planner
from pixelweave.operators import color, fusion, quality, scheduling, seams, tiling
from pixelweave.sources.mosaic import colored, degraded, mosaic
from pixelweave.streaming import heartbeats
from pixelweave.streaming import tasks as task_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic(table(spark, sf_dir, "embeddings"))


def r6(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


PX = """with px as (
  select vec_id, ((vec_id // 25) * 8 + p // 8)::int as y, ((vec_id % 25) * 8 + p % 8)::int as x, floor((v::double + 1) * 127.5)::int as g
  from (select vec_id, unnest(embedding) as v, unnest(range(64)) as p from embeddings)),
other as (select y, x, g + (x * 7 + y * 3) % 5 - 2 as h from px),
both_px as (select * from px join other using (y, x)),
dims as (select max(y) + 1 as hh, max(x) + 1 as ww from px)
"""


@query(PX + "select count(*)::bigint as n, round(avg(g), 6) as mean, min(g) as low, max(g) as high, round(stddev_pop(g), 6) as contrast from px")
def px_stats(spark, d):
    return px(spark, d).agg(F.count("*").alias("n"), F.avg("g").alias("mean"), F.min("g").alias("low"), F.max("g").alias("high"), F.stddev_pop("g").alias("contrast")).select("n", *r6("mean"), "low", "high", *r6("contrast"))


@query(PX + "select round(avg(floor(.299::double * g + .587::double * ((g * 3 + x) % 256) + .114::double * ((g * 5 + y) % 256) + .5::double)), 6) as gray from px")
def px_gray(spark, d):
    gray = F.floor(F.col("red") * 0.299 + F.col("green") * 0.587 + F.col("blue") * 0.114 + 0.5)
    return colored(px(spark, d)).agg(F.avg(gray).alias("gray")).select(*r6("gray"))


@query(PX + "select vec_id, round(stddev_pop(g), 6) as complexity from px group by vec_id")
def tile_complexity(spark, d):
    return tiling.complexity(px(spark, d), "vec_id").select("vec_id", *r6("complexity"))


@query(PX + ", c as (select vec_id, g, count(*) / 64.0::double as p from px group by vec_id, g) select vec_id, round(-sum(p * log2(p + 1e-10::double)), 6) as entropy from c group by vec_id")
def tile_entropy(spark, d):
    return tiling.entropy(px(spark, d), "vec_id").select("vec_id", *r6("entropy"))


GRID = """with sizes as (select p_partkey as image_id, (p_size * 97 + 400)::int as width, (p_size * 61 + 300)::int as height from part),
n as (select *, greatest(1, ceil((width - 204) / 820.0))::int as nc, greatest(1, ceil((height - 204) / 820.0))::int as nr from sizes),
r as (select *, unnest(range(nr))::int as tile_row from n), c as (select *, unnest(range(nc))::int as tile_col from r),
placed as (select *, (tile_col * 820)::int as x, (tile_row * 820)::int as y from c),
box as (select *, least(1024, width - x)::int as w, least(1024, height - y)::int as h from placed),
grid as (select image_id, tile_row, tile_col, x, y, w, h,
  case when y > 0 then 204 else 0 end as overlap_top,
  case when y + h < height then 204 else greatest(0, 1024 - (height - y) - case when y > 0 then 204 else 0 end) end::int as overlap_bottom,
  case when x > 0 then 204 else 0 end as overlap_left,
  case when x + w < width then 204 else greatest(0, 1024 - (width - x) - case when x > 0 then 204 else 0 end) end::int as overlap_right from box)
"""


def grid(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 97 + 400).cast("int").alias("width"), (F.col("p_size") * 61 + 300).cast("int").alias("height"))
    return tiling.tile_grid(sizes)


@query(GRID + "select * from grid")
def tile_grid(spark, d):
    return grid(spark, d)


@query(GRID + "select image_id, tile_row, tile_col, (x + overlap_left)::int as x1, (y + overlap_top)::int as y1, (x + w - overlap_right)::int as x2, (y + h - overlap_bottom)::int as y2 from grid")
def tile_effective_region(spark, d):
    return grid(spark, d).selectExpr("image_id", "tile_row", "tile_col", "x + overlap_left as x1", "y + overlap_top as y1", "x + w - overlap_right as x2", "y + h - overlap_bottom as y2")


@query(GRID + """select a.image_id, a.tile_row, a.tile_col, s.side, b.tile_row as n_row, b.tile_col as n_col
from grid a, (values ('top', -1, 0), ('bottom', 1, 0), ('left', 0, -1), ('right', 0, 1)) s(side, dr, dc), grid b
where b.image_id = a.image_id and b.tile_row = a.tile_row + s.dr and b.tile_col = a.tile_col + s.dc""")
def tile_neighbors(spark, d):
    return tiling.neighbors(grid(spark, d))


@query(GRID + """select * from (select a.image_id, a.tile_row as tile_row1, a.tile_col as tile_col1, b.tile_row as tile_row2, b.tile_col as tile_col2,
  case when a.tile_row = b.tile_row then 'horizontal' else 'vertical' end as direction, greatest(a.x, b.x) as x, greatest(a.y, b.y) as y,
  (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))::int as width, (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))::int as height
from grid a join grid b on a.image_id = b.image_id and ((a.tile_row = b.tile_row and b.tile_col = a.tile_col + 1) or (a.tile_col = b.tile_col and b.tile_row = a.tile_row + 1)))
where width > 0 and height > 0""")
def overlap_regions(spark, d):
    return tiling.overlap_regions(grid(spark, d))


def mosaic_tiles(spark, p):
    """Tiles of the mosaic; its size is a row of its own, so nothing runs while the query is built."""
    sizes = p.agg(F.lit("mosaic").alias("image_id"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    tiles = tiling.tile_grid(sizes, 64, 0.2).join(F.broadcast(sizes), "image_id")
    tiles = tiles.withColumn("overlap_bottom", F.when(F.col("y") + F.col("h") < F.col("height"), 12).otherwise(0))
    return tiles.withColumn("overlap_right", F.when(F.col("x") + F.col("w") < F.col("width"), 12).otherwise(0)).drop("width", "height")


def shown():
    """What a tile shows: each tile of the grid is brighter by an amount of its own, so that weights matter where tiles overlap."""
    return F.col("g") + F.col("tile_row") * 7 + F.col("tile_col") * 3


FUSED = PX + """, rs as (select unnest(range(greatest(1, ceil((hh - 12) / 52.0))::int)) * 52 as ty, hh from dims), cs as (select unnest(range(greatest(1, ceil((ww - 12) / 52.0))::int)) * 52 as tx, ww from dims),
t as (select ty, tx, hh, ww, least(64, hh - ty) as h, least(64, ww - tx) as w from rs, cs),
e as (select px.y, px.x, g + ty // 52 * 7 + tx // 52 * 3 as g, px.y - ty as i, px.x - tx as j, t.*, least(1.0::double, least(px.y - ty, px.x - tx, h - 1 - (px.y - ty), w - 1 - (px.x - tx)) / greatest(1, least(h, w) // 8)::double) as dist
  from px join t on px.y >= ty and px.y < ty + h and px.x >= tx and px.x < tx + w), ww2 as (select *, WEIGHT as weight from e)
select y, x, round(sum(weight * g) / greatest(sum(weight), 1e-6::double), 6) as value from ww2 group by y, x"""
FEATHER = "*".join(f"(case when {inner} then least(1.0::double, ({at}) / 11.0::double) else 1 end)" for inner, at in (("ty > 0", "i"), ("ty + h < hh", "h - 1 - i"), ("tx > 0", "j"), ("tx + w < ww", "w - 1 - j")))


@query(FUSED.replace("WEIGHT", FEATHER))
def fuse_feather(spark, d):
    p = px(spark, d)
    return fusion.fuse(p.drop("vec_id"), mosaic_tiles(spark, p), fusion.feather_weight(), shown()).select("y", "x", *r6("value"))


def fused(kind):
    def run(spark, d):
        p = px(spark, d)
        return fusion.fuse(p.drop("vec_id"), mosaic_tiles(spark, p), fusion.distance_weight(kind), shown()).select("y", "x", *r6("value"))

    run.__name__ = f"fuse_weighted_{kind}"
    return run


for _kind, _sql in (("linear", "dist"), ("cosine", "0.5::double * (1 - cos(dist * 3.141592653589793::double))"), ("sigmoid", "1 / (1 + exp(-10 * (dist - 0.5::double)))")):
    query(FUSED.replace("WEIGHT", _sql))(fused(_kind))


@query(PX + "select round(avg(power(g - h, 2)), 6) as mse, round(10 * log10(65025 / avg(power(g - h, 2))), 6) as psnr from both_px")
def psnr(spark, d):
    p = px(spark, d)
    return quality.psnr(p, degraded(p)).select(*r6("mse", "psnr"))


SSIM = "((2 * avg(g) * avg(h) + 6.5025::double) * (2 * covar_pop(g, h) + 58.5225::double) / ((avg(g) * avg(g) + avg(h) * avg(h) + 6.5025::double) * (var_pop(g) + var_pop(h) + 58.5225::double)))"


@query(PX + f"select vec_id, round({SSIM}, 6) as score from both_px group by vec_id")
def ssim_moment(spark, d):
    p = px(spark, d)
    return p.join(degraded(p), ["y", "x"]).groupBy("vec_id").agg(quality.ssim("g", "h").alias("score")).select("vec_id", *r6("score"))


SLIDING = PX + f""", wins as (select unnest(range(0, hh, 8)) as wy, hh, ww from dims), wins2 as (select wy, unnest(range(0, ww, 8)) as wx from wins),
scores as (select wy::int as wy, wx::int as wx, {SSIM} as score from both_px join wins2 on y >= wy and y < wy + 16 and x >= wx and x < wx + 16 group by wy, wx having count(*) = 256)
"""


@query(SLIDING + "select wy, wx, round(score, 6) as score from scores")
def ssim_sliding(spark, d):
    p = px(spark, d)
    return quality.sliding_ssim(p, degraded(p)).select("wy", "wx", *r6("score"))


CHAIN = """, low as (select wy, wx, round(score, 6) as score from scores where score < 0.9996),
o as (select *, lag(wy) over (order by wy, wx) as py, lag(wx) over (order by wy, wx) as px0 from low),
f as (select *, sum(case when sqrt(power(wy - py, 2) + power(wx - px0, 2)) < 16 then 0 else 1 end) over (order by wy, wx) as seam from o),
chained as (select seam::bigint as seam, min(wx)::int as x, min(wy)::int as y, (max(wx) - min(wx) + 16)::int as width, (max(wy) - min(wy) + 16)::int as height, avg(score) as score, count(*)::bigint as n_windows from f group by seam)
"""


def chained(spark, d):
    p = px(spark, d)
    low = quality.sliding_ssim(p, degraded(p)).where("score < 0.9996").select(F.lit("mosaic").alias("image_id"), "wy", "wx", *r6("score"))
    return seams.chain(low)


@query(SLIDING + CHAIN + "select seam, x, y, width, height, round(score, 6) as score, n_windows, case when score < .85 then 'high' when score < .92 then 'medium' else 'low' end as severity from chained")
def seam_chain(spark, d):
    return chained(spark, d).select("seam", "x", "y", "width", "height", *r6("score"), "n_windows", "severity")


def stencil_sql(kernel):
    taps = ", ".join(f"({a}, {b}, {k}::double)" for a, b, k in kernel)
    return PX + f""", taps as (select px.y, px.x, k, case when px.y + dy < 0 then -(px.y + dy) when px.y + dy >= hh then 2 * (hh - 1) - px.y - dy else px.y + dy end as y2,
  case when px.x + dx < 0 then -(px.x + dx) when px.x + dx >= ww then 2 * (ww - 1) - px.x - dx else px.x + dx end as x2 from px, dims, (values {taps}) t(dy, dx, k)),
st as (select taps.y, taps.x, sum(k * s.g) as value from taps join px s on s.y = y2 and s.x = x2 group by taps.y, taps.x)
"""


@query(stencil_sql(quality.LAPLACIAN) + "select round(var_pop(value), 6) as sharpness from st")
def sharpness(spark, d):
    p = px(spark, d)
    return quality.sharpness(p).select(*r6("sharpness"))


@query(stencil_sql(quality.BINOMIAL) + "select round(stddev_pop(px.g - value), 6) as noise from st join px using (y, x)")
def noise_level(spark, d):
    p = px(spark, d)
    return quality.noise(p).select(*r6("noise"))


@query(PX + ", b as (select y // 8 as by, x // 8 as bx, var_pop(g) as v from px, dims where y // 8 * 8 < hh - 8 and x // 8 * 8 < ww - 8 group by 1, 2) select case when count(*) > 1 then round(greatest(0, 100 - var_pop(v) / 100), 6) else 100 end as artifact_score from b")
def artifact_score(spark, d):
    return quality.block_artifacts(px(spark, d)).select(*r6("artifact_score"))


@query(PX + ", c as (select y // (hh // 4) as cy, x // (ww // 4) as cx, avg(g) as m from px, dims where y < hh // 4 * 4 and x < ww // 4 * 4 group by 1, 2) select round(greatest(0, 100 - stddev_pop(m)), 6) as uniformity from c")
def brightness_uniformity(spark, d):
    p = px(spark, d)
    return quality.uniformity(p).select(*r6("uniformity"))


@query(PX + """, per as (select vec_id, 10 * log10(65025 / avg(power(g - h, 2))) as v from both_px group by vec_id)
select case when v >= 40 then 'excellent' when v >= 35 then 'good' when v >= 30 then 'fair' else 'poor' end as level, count(*)::bigint as n from per group by 1""")
def metric_levels(spark, d):
    p = px(spark, d)
    per = p.join(degraded(p), ["y", "x"]).groupBy("vec_id").agg((10 * F.log10(65025 / F.avg(F.pow(F.col("g") - F.col("h"), 2)))).alias("v"))
    return per.groupBy(quality.level(F.col("v"), (40, 35, 30), True).alias("level")).agg(F.count("*").alias("n"))


CDFS = PX + """, lv as (select unnest(range(256))::int as level), ca as (select level, sum(coalesce(n, 0)) over (order by level) / sum(coalesce(n, 0)) over () as s from lv left join (select g as level, count(*) as n from px group by 1) using (level)),
cb as (select level as to_level, sum(coalesce(n, 0)) over (order by level) / sum(coalesce(n, 0)) over () as t from lv left join (select h as level, count(*) as n from other group by 1) using (level))
"""


@query(CDFS + "select level, round(s::double, 9) as share from ca")
def histogram_cdf(spark, d):
    return seams.cdf(px(spark, d), "g").select("level", F.round("share", 9).alias("share"))


@query(CDFS + "select level, to_level as mapped from (select level, to_level, row_number() over (partition by level order by round(abs(s - t)::double, 9), to_level) as rn from ca, cb) where rn = 1")
def histogram_match(spark, d):
    p = px(spark, d)
    return seams.histogram_match(seams.cdf(p, "g"), seams.cdf(degraded(p), "h"))


@query(PX + ", a as (select avg(g) as ma, stddev_pop(g) as sa from px), b as (select avg(h) as mb, stddev_pop(h) as sb from other) select y, x, round(greatest(0, least(255, (g - ma) * sb / (sa + 1e-6::double) + mb)), 6) as value from px, a, b")
def mean_std_match(spark, d):
    p = px(spark, d)
    return seams.mean_std_match(p, degraded(p)).select("y", "x", *r6("value"))


@query(PX + "select y, x, abs(g - h)::int as diff from both_px")
def diff_heatmap(spark, d):
    p = px(spark, d)
    return p.join(degraded(p), ["y", "x"]).select("y", "x", F.abs(F.col("g") - F.col("h")).cast("int").alias("diff"))


TASKS = """with tasks as (select o_orderkey as task_id, case o_orderpriority[1] when '1' then 4 when '2' then 3 when '3' then 2 when '4' then 1 else 0 end as vip,
  o_totalprice > 150000 as roi, o_orderkey % 2 = 1 as edge, epoch(o_orderdate)::bigint as "at", (o_orderkey % 5)::int as retries, 1.0::double + o_orderkey % 4 as scale from orders),
queue as (select *, vip * -10000.0::double - roi::int * 1000.0::double - edge::int * 100.0::double + "at" * 0.001::double as priority from tasks),
agents as (select s_suppkey as agent_id, s_suppkey as reg_order, case when s_suppkey % 5 = 0 then 'OFFLINE' else 'IDLE' end as status, (1 + s_suppkey % 3)::int as capacity, (s_suppkey % 2)::int as pending,
  (s_suppkey % 70)::double as latency, (s_suppkey % 4)::int as degradation, abs(s_acctbal) / 100 as avg_time from supplier),
weighed as (select *, 100 + greatest(0, capacity - pending) * 10.0::double + case when avg_time > 0 then 1000 / (avg_time + 1) else 0 end + case when latency > 0 then greatest(0, 100 - latency * 0.1::double) else 0 end - degradation * 50.0::double as weight,
  status in ('IDLE', 'BUSY') and pending < capacity and degradation < 3 as ready from agents)
"""


def tasks(spark, d):
    vip = F.coalesce(*[F.when(F.substring("o_orderpriority", 1, 1) == k, v) for k, v in (("1", 4), ("2", 3), ("3", 2), ("4", 1))], F.lit(0))
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("task_id"), vip.alias("vip"), (F.col("o_totalprice") > 150000).alias("roi"), (F.col("o_orderkey") % 2 == 1).alias("edge"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"), (F.col("o_orderkey") % 5).cast("int").alias("retries"), (F.col("o_orderkey") % 4 + 1.0).alias("scale"),
    )
    return rows.withColumn("priority", scheduling.priority("vip", "roi", "edge", "at"))


def agents(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("agent_id"), k.alias("reg_order"), F.when(k % 5 == 0, "OFFLINE").otherwise("IDLE").alias("status"), (1 + k % 3).cast("int").alias("capacity"), (k % 2).cast("int").alias("pending"),
        (k % 70).cast("double").alias("latency"), (k % 4).cast("int").alias("degradation"), (F.abs("s_acctbal") / 100).alias("avg_time"),
    )


@query(TASKS + "select task_id, round(priority, 6) as priority from queue")
def task_priority(spark, d):
    return tasks(spark, d).select("task_id", *r6("priority"))


@query(TASKS + "select task_id, round(priority, 6) as priority from queue order by queue.priority, task_id limit 50")
def next_tasks(spark, d):
    return tasks(spark, d).orderBy("priority", "task_id").limit(50).select("task_id", *r6("priority"))


@query(TASKS + "select agent_id, round(weight, 6) as weight, ready from weighed")
def agent_weight(spark, d):
    return agents(spark, d).select("agent_id", F.round(scheduling.agent_weight(), 6).alias("weight"), scheduling.available().alias("ready"))


@query(TASKS + """, slots as (select agent_id, row_number() over (order by -(weight - k * 10), reg_order, k) as place from (select *, unnest(range(capacity - pending)) as k from weighed where ready)),
q as (select task_id, row_number() over (order by priority, task_id) as place from queue) select task_id, agent_id from q join slots using (place)""")
def dispatch(spark, d):
    return scheduling.dispatch(tasks(spark, d), agents(spark, d))


@query(TASKS + """select task_id, case when retries < 3 then 'RETRYING' else 'DEGRADED' end as status, case when retries < 3 then retries + 1 when scale > 1.5 then 0 else retries end::int as retries,
round(queue.priority + case when retries < 3 then (retries + 1) * 100.0::double else 500.0::double end, 6) as priority, round(case when retries < 3 or scale <= 1.5 then scale else greatest(1.5, scale * 0.7::double) end, 6) as scale,
case when retries < 3 or scale <= 1.5 then 4096 else floor(4096 * greatest(1.5::double, scale * 0.7::double) / scale) end::int as target_w, case when retries < 3 then 512 else 256 end as tile_size, case when retries < 3 then 64 else 16 end as overlap, retries >= 3 as fallback from queue""")
def after_failure(spark, d):
    """Every task fails once; its priority holds the penalties of its earlier tries, which the new one replaces."""
    base = F.col("priority")
    t = tasks(spark, d).withColumns({"base": base, "priority": base + 100.0 * F.col("retries"), "max_retries": F.lit(3), "status": F.lit("PROCESSING"), "target_w": F.lit(4096),
                                     "tile_size": F.lit(512), "overlap": F.lit(64), "fallback": F.lit(False)})
    t = t.withColumns(scheduling.failure(t.columns, F.col("base")))
    return t.select("task_id", "status", "retries", *r6("priority", "scale"), "target_w", "tile_size", "overlap", "fallback")


@query()
def task_history(spark, d):
    """The events of users as those of tasks: the first submits one, the others are assignments, heartbeats, ends and failures."""
    e = table(spark, d, "events")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("assign", "heartbeat", "heartbeat", "assign", "fail", "complete", "recover")]), (F.col("event_id") % 7 + 1).cast("int"))
    first = F.min_by("event_id", F.struct("ts", "event_id")).over(Window.partitionBy("user_id"))
    kind = F.when(F.col("event_id") == first, "submit").otherwise(kinds)
    rows = e.select(F.col("ts").cast("timestamp"), F.col("user_id").cast("string").alias("task_id"), kind.alias("kind"), (F.col("event_id") % 13).cast("string").alias("agent_id"),
                    F.col("value").alias("base"), (1.0 + F.col("event_id") % 4).alias("scale"), (F.col("event_id") % 3).cast("int").alias("max_retries"))
    return task_stream.task_history(rows, 7200.0)


@query("""with a as (select user_id, (count(*) * (user_id % 16))::int as depth, (1 + user_id % 490)::int as n_agents, (user_id % 9)::int as idle, (20 + user_id % 100)::int as concurrent from events group by user_id)
select user_id, case when depth / concurrent::double > 0.8 and depth >= 50 then greatest(n_agents, least(500, n_agents + case when depth >= 100 then 20 else 5 end))
  when depth / concurrent::double < 0.2 and depth < 10 and idle > 5 then greatest(n_agents - 3, 5) else n_agents end::int as target from a""")
def autoscale_target(spark, d):
    u = F.col("user_id")
    depth = (F.count("*") * (u % 16)).cast("int").alias("depth")
    a = table(spark, d, "events").groupBy("user_id").agg(depth).select("user_id", "depth", (1 + u % 490).cast("int").alias("n_agents"), (u % 9).cast("int").alias("idle"), (20 + u % 100).cast("int").alias("concurrent"))
    return a.select("user_id", scheduling.autoscale("depth", "n_agents", "idle", "concurrent").cast("int").alias("target"))


def events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("agent"), "event_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("value").alias("duration"))


EVENTS = "with e as (select user_id as agent, event_id, event_type, floor(epoch(ts))::bigint as secs, value as duration from events)\n"


@query(EVENTS + ", f as (select *, count(*) over (partition by agent order by secs range between 86400 preceding and current row) as n_recent from e where event_type = 'error') select agent, event_id, n_recent::bigint as n_recent, n_recent >= 3 as degrades from f")
def recent_failures(spark, d):
    return scheduling.recent_failures(events(spark, d).where("event_type = 'error'"), 86400).select("agent", "event_id", "n_recent", "degrades")


@query(EVENTS + ", s as (select agent, list(duration order by secs, event_id) as v from e where duration > 0 group by agent) select agent, round(list_reduce(v, lambda a, x: a * 0.9::double + x * (1 - 0.9::double)), 6) as duration from s")
def ewma_duration(spark, d):
    return scheduling.ewma(events(spark, d)).select("agent", *r6("duration"))


@query(EVENTS + ", g as (select *, lead(secs) over (partition by agent order by secs, event_id) - secs as gap from e) select agent, count(*)::bigint as n, count(*) filter (where gap > 3600)::bigint as n_offline from g group by agent")
def heartbeat_timeout(spark, d):
    return scheduling.heartbeat_gaps(events(spark, d), 3600).groupBy("agent").agg(F.count("*").alias("n"), F.count_if("offline_after").alias("n_offline"))


@query("select date_trunc('hour', ts) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2")
def throughput(spark, d):
    out = heartbeats.throughput(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with s as (select p_partkey as image_id, (p_size * 97 + 400)::double as w0, (p_size * 61 + 300)::double as h0, case p_size % 4 when 0 then '100MP' when 1 then '150MP' when 2 then '200MP' else 'x' end as label from part),
f as (select *, case label when '150MP' then least(15000 / w0, 10000 / h0) when '200MP' then least(17320 / w0, 11547 / h0) else least(12245 / w0, 8163 / h0) end as fit from s)
select image_id, case label when 'x' then 12245 else floor(w0 * fit) end::int as w, case label when 'x' then 8163 else floor(h0 * fit) end::int as h from f""")
def target_size(spark, d):
    label = F.when(F.col("p_size") % 4 == 0, "100MP").when(F.col("p_size") % 4 == 1, "150MP").when(F.col("p_size") % 4 == 2, "200MP").otherwise("x")
    return table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), planner.target_size((F.col("p_size") * 97 + 400).cast("double"), (F.col("p_size") * 61 + 300).cast("double"), label).alias("s")).select("image_id", "s.w", "s.h")


@query("""with s as (select p_partkey as image_id, (p_size * 97 + 400)::double as w, (p_size * 61 + 300)::double as h from part), k as (select *, sqrt(100.0::double * 1e6::double / (w * h)) as scale from s),
t as (select image_id, (ceil(floor(w * scale) / 819) * ceil(floor(h * scale) / 819))::bigint as tiles from k)
select image_id, tiles, floor(tiles * 1.2::double)::bigint as calls, round(floor(tiles * 1.2::double) / 1e6::double * 5, 9) as cost, tiles * 5 as least_s, tiles * 15 as most_s from t""")
def cost_estimate(spark, d):
    e = planner.estimate((F.col("p_size") * 97 + 400).cast("double"), (F.col("p_size") * 61 + 300).cast("double"), F.lit(100.0))
    return table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), e.alias("e")).select("image_id", "e.tiles", "e.calls", F.round("e.cost", 9).alias("cost"), "e.least_s", "e.most_s")


@query("select page_id, ('0x' || substr(md5(url || ':' || md5(html)), 1, 8))::bigint % 2147483648 as seed from pages")
def tile_seed(spark, d):
    return table(spark, d, "pages").select("page_id", planner.seed(F.col("url"), F.col("html")).alias("seed"))


@query("select l_orderkey, l_linenumber, case when l_quantity / 10 >= 4 then 4096 when l_quantity / 10 >= 3 then 3072 when l_quantity / 10 >= 2 then 2048 else 1536 end::int as bucket, least(8.0::double, power(2.0::double, l_linenumber - 1)) as wait_s from lineitem")
def size_bucket(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", planner.size_bucket(F.col("l_quantity") / 10).alias("bucket"), planner.backoff(F.col("l_linenumber") - 1).alias("wait_s"))


@query("select doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))::bigint as words, contains(lower(text), 'the') as has_the, length(text) < 10 as is_short from documents")
def prompt_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("words"), F.contains(F.lower("text"), F.lit("the")).alias("has_the"), (F.length("text") < 10).alias("is_short"))


@query("select date_trunc('day', ts)::date as day, count(*)::bigint as calls, round(count(*) / 1e6::double * 5, 9) as cost from events group by 1")
def usage_per_day(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls")).select("day", "calls", F.round(F.col("calls") / 1e6 * 5, 9).alias("cost"))


@query("select o_orderstatus as status, count(*)::bigint as n, round(sum(o_totalprice), 2) as cost from orders group by rollup(o_orderstatus)")
def scheduler_stats(spark, d):
    return table(spark, d, "orders").rollup(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("cost"))


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def resume_anti(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


@query("""with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
s as (select *, sum(case when ts - before <= interval 30 minute then 0 else 1 end) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, min(ts) as start, max(ts) + interval 30 minute as stop, count(*)::bigint as n from s group by user_id, k""")
def agent_sessions(spark, d):
    found = heartbeats.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "stop")], "n")


RGB = PX + """, c as (select y, x, g as red, (g * 3 + x) % 256 as green, (g * 5 + y) % 256 as blue from px)
"""
LAB = """, n as (select *, case when red / 255.0::double <= 0.04045 then red / 255.0::double / 12.92 else power((red / 255.0::double + 0.055) / 1.055, 2.4) end as lr,
  case when green / 255.0::double <= 0.04045 then green / 255.0::double / 12.92 else power((green / 255.0::double + 0.055) / 1.055, 2.4) end as lg,
  case when blue / 255.0::double <= 0.04045 then blue / 255.0::double / 12.92 else power((blue / 255.0::double + 0.055) / 1.055, 2.4) end as lb from c),
xyz as (select *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 as xx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb as yy, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 as zz from n),
fs as (select *, case when xx > 0.008856 then power(xx, 1 / 3.0::double) else 7.787 * xx + 16 / 116.0::double end as fx, case when yy > 0.008856 then power(yy, 1 / 3.0::double) else 7.787 * yy + 16 / 116.0::double end as fy,
  case when zz > 0.008856 then power(zz, 1 / 3.0::double) else 7.787 * zz + 16 / 116.0::double end as fz from xyz),
lab as (select floor((case when yy > 0.008856 then 116 * fy - 16 else 903.3 * yy end) * 2.55 + 0.5) as l, floor(500 * (fx - fy) + 128.5) as a, floor(200 * (fy - fz) + 128.5) as b from fs)
"""


@query(RGB + LAB + "select round(sqrt(var_pop(a) + var_pop(b)), 6) as colorfulness, round(var_pop(l), 6) as color_variance, round(greatest(0, 100 - sqrt(power(avg(l) - 70, 2) + power(avg(a) - 15, 2) + power(avg(b) - 20, 2))), 6) as skin_tone from lab")
def lab_stats(spark, d):
    return color.lab_stats(colored(px(spark, d))).select(*r6("colorfulness", "color_variance", "skin_tone"))


@query(RGB.replace("c as (", "means as (") + ", c as (select floor(avg(red)) as red, floor(avg(green)) as green, floor(avg(blue)) as blue from means union all select 128, 180, 220)" + LAB + "select round(sqrt(power(max(l) - min(l), 2) + power(max(a) - min(a), 2) + power(max(b) - min(b), 2)), 6) as delta_e from lab")
def delta_e(spark, d):
    return color.delta_e(colored(px(spark, d)), (128, 180, 220)).select(*r6("delta_e"))


@query(RGB + """, s as (select red, blue, 0.299 * red + 0.587 * green + 0.114 * blue as luma from c)
select round(greatest(0, least(100, 100 - abs(avg(((red - luma) * 0.713 + 128 between 133 and 173 and (blue - luma) * 0.564 + 128 between 77 and 127)::int) - 0.3) * 100)), 6) as naturalness from s""")
def face_naturalness(spark, d):
    return color.face_naturalness(colored(px(spark, d))).select(*r6("naturalness"))


@query(stencil_sql([(dy, dx, 0.04) for dy in range(-2, 3) for dx in range(-2, 3)]).replace("sum(k * s.g) as value", "sum(k * s.g) as value, sum(k * s.g * s.g) as square") + "select round(avg(square - value * value), 6) as texture from st")
def texture_score(spark, d):
    p = px(spark, d)
    return quality.texture(p).select(*r6("texture"))


@query(stencil_sql([(dy - 2, dx - 2, (1, 4, 6, 4, 1)[dy] * (1, 4, 6, 4, 1)[dx] / 256) for dy in range(5) for dx in range(5)]) + "select y // 2 as y, x // 2 as x, round(value, 6) as value from st where y % 2 = 0 and x % 2 = 0")
def pyramid_down(spark, d):
    p = px(spark, d)
    return quality.pyramid_down(p).select("y", "x", *r6("value"))


@query(PX + "select y, x, sum(g) over (partition by y order by x)::bigint as across, sum(g) over (partition by x order by y)::bigint as down from px")
def gradient_cumsum(spark, d):
    return fusion.running_sums(px(spark, d)).select("y", "x", "across", "down")


ROIS = "rois as (select p_partkey as roi_id, (p_partkey * 7 % 180)::int as x0, (p_partkey * 5 % 140)::int as y0, (p_size % 20 + 4)::int as w, (p_size % 15 + 4)::int as h from part)\n"


def rois(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey as roi_id", "cast(p_partkey * 7 % 180 as int) as x0", "cast(p_partkey * 5 % 140 as int) as y0", "cast(p_size % 20 + 4 as int) as w", "cast(p_size % 15 + 4 as int) as h")


@query(PX + ", " + ROIS + "select roi_id, count(*)::bigint as n, round(avg(g), 6) as mean, round(stddev_pop(g), 6) as contrast from px join rois on x >= x0 and x < x0 + w and y >= y0 and y < y0 + h group by roi_id")
def roi_metrics(spark, d):
    return quality.roi_moments(px(spark, d), rois(spark, d)).select("roi_id", "n", *r6("mean", "contrast"))


@query("""with m as (select l_orderkey as image_id, case l_linenumber % 4 when 0 then 'psnr' when 1 then 'ms_ssim' when 2 then 'lpips' else 'niqe' end as metric, case when l_linenumber % 4 = 0 then l_quantity * 3 else l_discount end as value from lineitem)
select image_id, round(avg(case metric when 'psnr' then greatest(0, least(100, value)) when 'ms_ssim' then value * 100 when 'lpips' then greatest(0, (1 - value) * 100) end), 6) as overall from m group by image_id""")
def overall_score(spark, d):
    k = F.col("l_linenumber") % 4
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.when(k == 0, "psnr").when(k == 1, "ms_ssim").when(k == 2, "lpips").otherwise("niqe").alias("metric"), F.when(k == 0, F.col("l_quantity") * 3).otherwise(F.col("l_discount")).alias("value"))
    return quality.overall(m).select("image_id", *r6("overall"))


@query(GRID + ", t as (select image_id, tile_row * 100 + tile_col as tile_id, x, y from grid) select a.image_id, a.tile_id as tile1, b.tile_id as tile2 from t a join t b on a.image_id = b.image_id and a.tile_id <> b.tile_id and abs(a.x - b.x) <= 1024 and abs(a.y - b.y) <= 1024")
def proximity_neighbors(spark, d):
    return tiling.proximity(grid(spark, d).withColumn("tile_id", F.col("tile_row") * 100 + F.col("tile_col")), 1024)


PADDED = PX + """, spots as (select y::int as y, x::int as x, hh, ww from (select unnest(range(hh + 16)) as y, hh, ww from dims), (select unnest(range(ww + 24)) as x from dims)),
s as (select y, x, case when y < hh then y else YFAR end as y2, case when x < ww then x else XFAR end as x2 from spots)
select s.y, s.x, coalesce(px.g, 0) as g from s left join px on px.y = y2 and px.x = x2"""


def padded(mode):
    def run(spark, d):
        p = px(spark, d)
        return tiling.pad(p, 16, 24, mode)

    run.__name__ = f"pad_{mode}"
    return run


for _mode, _far in (("mirror", "2 * (N - 1) - P"), ("reflect", "2 * N - 1 - P"), ("replicate", "N - 1"), ("constant", "-1")):
    query(PADDED.replace("YFAR", _far.replace("N", "hh").replace("P", "y")).replace("XFAR", _far.replace("N", "ww").replace("P", "x")))(padded(_mode))


@query("""with r as (select o_orderkey as task_id, 100 as want, (90 + o_custkey % 20)::double as w, (93 + o_orderkey % 14)::double as h, case when o_orderstatus <> 'P' then o_orderpriority end as path from orders)
select task_id, case when path is null then 'missing' when abs(w - want) / want > 0.05 then 'width' when abs(h - want) / want > 0.05 then 'height' end as reason from r""")
def validate_results(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders")
    got = rows.select(k.alias("task_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("output_path"), (F.col("o_custkey") % 20 + 90).alias("width"), (k % 14 + 93).alias("height"), F.lit("RGB").alias("color_mode"))
    return scheduling.validate(rows.select(k.alias("task_id"), F.lit(100).alias("target_w"), F.lit(100).alias("target_h")), got)


STATE = """with s as (select o_orderkey as task_id, case o_orderkey % 4 when 0 then 'PROCESSING' when 1 then 'PENDING' when 2 then 'SUCCESS' else 'FAILED' end as status, (o_orderkey % 3)::int as retries,
  case when o_orderkey % 5 > 0 then o_custkey % 40 end as agent_id from orders)
"""


def state(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "PROCESSING").when(k % 4 == 1, "PENDING").when(k % 4 == 2, "SUCCESS").otherwise("FAILED")
    return table(spark, d, "orders").select(k.alias("task_id"), status.alias("status"), (k % 3).cast("int").alias("retries"), F.when(k % 5 > 0, F.col("o_custkey") % 40).alias("agent_id"))


@query(STATE + "select task_id, case status when 'PROCESSING' then 'RETRYING' else status end as status, (retries + (status = 'PROCESSING')::int)::int as retries, case when status <> 'PROCESSING' then agent_id end as agent_id, status in ('PROCESSING', 'PENDING') as queued from s")
def restore_transform(spark, d):
    return scheduling.restored(state(spark, d))


@query(STATE + "select task_id, agent_id from s where agent_id is not null and agent_id not in (select s_suppkey from supplier where s_suppkey % 5 <> 0)")
def orphaned_tasks(spark, d):
    return scheduling.orphaned(state(spark, d), agents(spark, d)).select("task_id", "agent_id")


@query(TASKS + "select status, count(*)::bigint as n, count(*) filter (where ready)::bigint as n_ready from weighed group by status")
def agent_status_counts(spark, d):
    return agents(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if(scheduling.available()).alias("n_ready"))


@query(PX + ", " + ROIS + """, covered as (select distinct y, x, 1 as hit from px join rois on x >= x0 and x < x0 + w and y >= y0 and y < y0 + h)
select vec_id, round(avg(coalesce(hit, 0)), 6) as ratio, coalesce(max(hit), 0) > 0 as touched from px left join covered using (y, x) group by vec_id""")
def forbidden_ratio(spark, d):
    return quality.covered_share(px(spark, d), rois(spark, d), "vec_id").select("vec_id", *r6("ratio"), "touched")


@query(PX + """, t as (select vec_id, y % 8 * 8 + x % 8 as p, g from px), r as (select p, avg(g) as h from t group by p)
select vec_id as tile, round(score, 6) as score from (select vec_id, round(""" + SSIM + """, 9) as score from t join r using (p) group by vec_id) order by round(score, 9) desc, vec_id limit 1""")
def best_tile(spark, d):
    t = px(spark, d).select(F.col("vec_id").alias("tile"), (F.col("y") % 8 * 8 + F.col("x") % 8).alias("p"), "g")
    region = t.groupBy("p").agg(F.avg("g").alias("h"))
    return quality.best_tile(t, region).select("tile", *r6("score"))


@query("""select p_partkey, concat_ws(', ', case when p_size % 4 > 0 then p_type end, case p_size % 3 when 0 then 'a face, even skin, soft light' when 1 then 'goods on a table, clean edges, studio light' else 'a scene, natural tones, fine detail' end)
  || case when p_size % 2 > 0 then '' else case p_size % 3 when 0 then '###waxy skin' when 1 then '###stray text' else '###halos' end end as prompt from part""")
def prompt_build(spark, d):
    category = F.when(F.col("p_size") % 3 == 0, "portrait").when(F.col("p_size") % 3 == 1, "product").otherwise("other")
    templates = {"portrait": ("a face", "even skin", "soft light", "waxy skin"), "product": ("goods on a table", "clean edges", "studio light", "stray text"), "general": ("a scene", "natural tones", "fine detail", "halos")}
    custom = F.when(F.col("p_size") % 4 > 0, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", planner.prompt(category, custom, templates, "general", F.col("p_size") % 2 == 0).alias("prompt"))


@query("select o_orderkey, to_json({task_id: o_orderkey, status: o_orderstatus, level: case when o_totalprice >= 200000 then 'excellent' when o_totalprice >= 100000 then 'good' when o_totalprice >= 50000 then 'fair' else 'poor' end})::varchar as report from orders")
def report_json(spark, d):
    level = quality.level(F.col("o_totalprice"), (200000, 100000, 50000), True)
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), level.alias("level"))).alias("report"))


@query("select o_orderkey, o_orderstatus, round(o_totalprice, 2) as cost from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-01-01' and o_orderstatus in ('F', 'O') and contains(lower(o_orderpriority), 'urgent')")
def history_search(spark, d):
    when = (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").where(when & F.col("o_orderstatus").isin("F", "O") & F.contains(F.lower("o_orderpriority"), F.lit("urgent"))).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("cost"))


@query("select y, x, floor(greatest(0, least(255, value)))::int as value from (" + FUSED.replace("WEIGHT", "1.0::double").replace("round(sum(weight * g) / greatest(sum(weight), 1e-6::double), 6)", "sum(weight * g) / greatest(sum(weight), 1e-6::double)") + ")")
def fuse_average(spark, d):
    """Feathering by the distance to a hole in a tile's mask: masks without holes weigh all places alike."""
    p = px(spark, d)
    return fusion.fuse(p.drop("vec_id"), mosaic_tiles(spark, p), F.lit(1.0), shown()).select("y", "x", fusion.to_levels(F.col("value")).alias("value"))


@query(FUSED.replace("WEIGHT", FEATHER).rsplit("\nselect y, x", 1)[0] + """, fz as (select y, x, sum(weight * g) / greatest(sum(weight), 1e-6::double) as fused from ww2 group by y, x),
per as (select """ + SSIM + """ as score from (select ty, tx, ww2.g as g, fused as h from ww2 join fz using (y, x)) group by ty, tx)
select round(avg(score), 6) as mean_ssim, round(min(score), 6) as min_ssim, round(stddev_pop(score), 6) as std_ssim from per""")
def blend_quality(spark, d):
    p = px(spark, d)
    return fusion.blend_quality(p.drop("vec_id"), mosaic_tiles(spark, p), fusion.feather_weight(), shown()).select(*r6("mean_ssim", "min_ssim", "std_ssim"))


@query(SLIDING + CHAIN + "select seam, case when score < .85 then 'poisson_refinement' when score < .92 then 'increase_blend_width' else 'none' end as fix from chained")
def seam_fixes(spark, d):
    return chained(spark, d).select("seam", seams.fix(F.col("score")).alias("fix"))


@query(CDFS + ", lut as (select level, to_level as mapped from (select level, to_level, row_number() over (partition by level order by round(abs(s - t)::double, 9), to_level) as rn from ca, cb) where rn = 1) select y, x, mapped from px join lut on g = level")
def histogram_apply(spark, d):
    p = px(spark, d)
    return seams.apply_levels(p, seams.histogram_match(seams.cdf(p, "g"), seams.cdf(degraded(p), "h"))).select("y", "x", "mapped")


@query("""with m as (select 'psnr' as metric, o_totalprice / 10000 as value from orders union all select 'ms_ssim', o_custkey % 100 / 100.0::double from orders union all select 'niqe', (o_custkey % 11)::double from orders),
th(metric, a, b, c, rising) as (values ('psnr', 40, 35, 30, true), ('ms_ssim', 0.98, 0.95, 0.9, true), ('niqe', 3, 5, 8, false))
select metric, case when case when rising then value >= a else value <= a end then 'excellent' when case when rising then value >= b else value <= b end then 'good' when case when rising then value >= c else value <= c end then 'fair' else 'poor' end as level,
  count(*)::bigint as n from m join th using (metric) group by 1, 2""")
def threshold_levels(spark, d):
    o = table(spark, d, "orders")
    kinds = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in
                      (("psnr", F.col("o_totalprice") / 10000), ("ms_ssim", (F.col("o_custkey") % 100) / 100.0), ("niqe", F.col("o_custkey") % 11))])
    cuts = [("psnr", 40.0, 35.0, 30.0, True), ("ms_ssim", 0.98, 0.95, 0.9, True), ("niqe", 3.0, 5.0, 8.0, False)]
    thresholds = spark.createDataFrame(cuts, "metric string, excellent double, good double, fair double, rising boolean")
    return quality.leveled(o.select(F.inline(kinds)), thresholds).groupBy("metric", "level").agg(F.count("*").alias("n"))


@query("""with m as (select o_orderkey, case when o_orderkey % 2 > 0 then least(100, o_custkey % 1200 / 10.0::double) end as a, case when o_orderkey % 3 > 0 then least(100, o_custkey % 9 / 20.0::double * 500) end as b,
  case when o_orderkey % 5 > 0 then o_custkey % 101 end as c, case when o_orderkey % 7 > 0 then o_custkey % 97 end as e from orders)
select o_orderkey, round(coalesce(list_avg([a::double, b::double, c::double, e::double]), 50), 6) as score from m""")
def commercial_score(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    score = quality.commercial(F.when(k % 2 > 0, c % 1200), F.when(k % 3 > 0, (c % 9) / 20.0), F.when(k % 5 > 0, c % 101), F.when(k % 7 > 0, c % 97))
    return table(spark, d, "orders").select("o_orderkey", F.round(score, 6).alias("score"))


@query("select place::bigint as place, vec_id, doc_id from (select vec_id, row_number() over (order by vec_id) as place from embeddings) join (select doc_id, row_number() over (order by doc_id desc) as place from documents) using (place)")
def tile_results_zip(spark, d):
    tiles, results = table(spark, d, "embeddings").select("vec_id"), table(spark, d, "documents").select("doc_id")
    return scheduling.zipped(tiles, results, [F.col("vec_id")], [-F.col("doc_id")]).select("place", "vec_id", "doc_id")
