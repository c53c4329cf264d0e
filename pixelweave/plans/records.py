"""Registered queries over descriptive tables: regions, files, reports, and the life of tasks and agents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pixelweave.functions import planner
from pixelweave.functions import records as R
from pixelweave.operators import lifecycle, scheduling, seams, tiling
from pixelweave.plans.queries import query, table
from pixelweave.staging import shared_folder

BOXES = """with b as (select p_partkey as id, p_size as w, (p_partkey % 30)::int as h, (p_partkey * 7 % 500 - 20)::int as x, (p_partkey * 11 % 400 - 20)::int as y, (40 + p_partkey % 160)::int as ww, 380 as hh from part)
"""


def boxes(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.col("p_size").alias("w"), (k % 30).cast("int").alias("h"), (k * 7 % 500 - 20).cast("int").alias("x"), (k * 11 % 400 - 20).cast("int").alias("y"), (40 + k % 160).cast("int").alias("ww"), F.lit(380).alias("hh"))


@query(BOXES + "select id from b where w > 20 and h > 10 and w < 0.5::double * ww")
def text_regions(spark, d):
    return boxes(spark, d).where(R.reads_as_text(F.col("w"), F.col("h"), F.col("ww"))).select("id")


@query(BOXES + """, m as (select *, floor(greatest(w, h) * 0.2::double)::int as m from b), c as (select id, greatest(0, x - m) as x, greatest(0, y - m) as y, least(ww, x + w + m) as x1, least(hh, y + h + m) as y1 from m)
select id, x::int as x, y::int as y, (x1 - x)::int as w, (y1 - y)::int as h from c""")
def face_margin(spark, d):
    return boxes(spark, d).select("id", R.with_margin(*[F.col(c) for c in ("x", "y", "w", "h", "ww", "hh")]).alias("r")).select("id", "r.*")


@query(BOXES + ", c as (select id, greatest(0, x) as x, greatest(0, y) as y, w, h, ww, hh from b) select id, x::int as x, y::int as y, least(w, ww - x)::int as w, least(h, hh - y)::int as h from c where least(w, ww - x) > 0 and least(h, hh - y) > 0")
def roi_clamp(spark, d):
    return boxes(spark, d).select("id", R.clamped(*[F.col(c) for c in ("x", "y", "w", "h", "ww", "hh")]).alias("r")).select("id", "r.*").where("w > 0 and h > 0")


@query(BOXES + """select id, preset, box[1]::int as x0, box[2]::int as y0, box[3]::int as x1, box[4]::int as y1 from (
  select id, unnest(['center', 'full', 'square']) as preset, unnest([c, [0, 0, ww, hh], c]) as box from (select *, [ww // 2 - least(ww, hh) // 2, hh // 2 - least(ww, hh) // 2, ww // 2 + least(ww, hh) // 2, hh // 2 + least(ww, hh) // 2] as c from b))""")
def crop_presets(spark, d):
    each = boxes(spark, d).select("id", F.explode(R.crop_presets(F.col("ww"), F.col("hh"))).alias("preset", "box"))
    return each.select("id", "preset", *[F.col("box")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("""select p_partkey, stage, percent::int as percent, floor((100 - p) * 0.5::double)::int as minutes_left from (select p_partkey, p, unnest(['split', 'process', 'fuse', 'finish', 'write']) as stage,
  unnest([100, p, case when p < 80 then 0 else (p - 80) * 5 end, case when p < 95 then 0 else (p - 95) * 20 end, case when p < 99 then 0 else 100 end]) as percent from (select p_partkey, (p_partkey % 101)::int as p from part))""")
def progress_stages(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 101).cast("int").alias("p"))
    return p.select("p_partkey", "p", F.inline(R.progress_stages(F.col("p")))).select("p_partkey", "stage", "percent", R.minutes_left(F.lit(100), F.col("p")).alias("minutes_left"))


@query("select event_id, event_type from events where event_type = 'error'")
def log_filter(spark, d):
    return table(spark, d, "events").where(F.col("event_type") == "error").select("event_id", "event_type")


@query("select doc_id, ('roi_' || pos)::varchar as name, line from (select doc_id, unnest(range(len(l))) as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))")
def ordinal_names(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", F.concat(F.lit("roi_"), F.col("pos")).alias("name"), "line")


@query("""select severity, count(*)::bigint as n from (select case when s < 0.85 then 'high' when s < 0.92 then 'medium' else 'low' end as severity from (select (75 + l_orderkey % 25) / 100.0::double as s from lineitem)) group by severity""")
def severity_histogram(spark, d):
    s = table(spark, d, "lineitem").select(((75 + F.col("l_orderkey") % 25) / 100.0).alias("s"))
    return s.groupBy(seams.severity(F.col("s")).alias("severity")).agg(F.count("*").alias("n"))


@query("""select page_id, ext, case when ext in ('.tif', '.tiff') then 'tiff:lzw' when ext = '.png' then 'png:3' else 'other:95' end as encoding, round(length(html) / 1048576.0::double, 6) as mb,
  case when length(name) > 20 then name[1:20] || '...' else name end as shown from (select *, lower(regexp_extract(name, '(\\.[^./\\\\]+)$', 1)) as ext from (select page_id, html, url || case page_id % 4 when 0 then '.png' when 1 then '.TIFF' when 2 then '.jpg' else '' end as name from pages))""")
def file_rows(spark, d):
    tail = F.when(F.col("page_id") % 4 == 0, ".png").when(F.col("page_id") % 4 == 1, ".TIFF").when(F.col("page_id") % 4 == 2, ".jpg").otherwise("")
    p = table(spark, d, "pages").withColumn("name", F.concat("url", tail))
    return p.select("page_id", R.extension(F.col("name")).alias("ext"), R.encoding(F.col("name")).alias("encoding"), F.round(R.megabytes(F.length("html")), 6).alias("mb"), R.short_name(F.col("name")).alias("shown"))


@query("select doc_id, to_base64(encode(text)) as coded, md5(text) as digest, true as whole from documents where text is not null")
def base64_round_trip(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("wrapped"), "text")
    coded = F.regexp_replace("wrapped", r"\s", "")
    return t.select("doc_id", coded.alias("coded"), F.md5("text").alias("digest"), (F.decode(F.unbase64(coded), "UTF-8") == F.col("text")).alias("whole"))


@query("select event_id, coalesce(json_extract_string(props, '$.k'), 'none') as k, coalesce(json_extract_string(props, '$.missing'), 'none') as missing from events")
def map_defaults(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", R.get_or(m, "k", F.lit("none")).alias("k"), R.get_or(m, "missing", F.lit("none")).alias("missing"))


@query("select o_orderkey, (epoch(case when o_orderstatus = 'O' then timestamp '2000-01-01' else o_orderdate + interval 3 day end) - epoch(o_orderdate))::double as seconds from orders")
def durations(spark, d):
    o, at = table(spark, d, "orders"), F.col("o_orderdate").cast("timestamp")
    end = F.when(F.col("o_orderstatus") != "O", at + F.expr("interval 3 days"))
    return o.select("o_orderkey", R.duration(at, end, F.lit("2000-01-01").cast("timestamp")).alias("seconds"))


@query("select s_suppkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as id from (select s_suppkey, sha256(s_suppkey || '|' || s_name) as h from supplier)")
def stable_ids(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", R.stable_id(F.col("s_suppkey"), F.col("s_name")).alias("id"))


@query("select c_custkey, c_name, c_nationkey::bigint as c_nationkey from customer")
def record_round_trip(spark, d):
    c = table(spark, d, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_nationkey")).alias("j"))
    return c.select(F.from_json("j", "c_custkey long, c_name string, c_nationkey long").alias("r")).select("r.*")


@query("select vec_id, (pos - 1)::int as pos, case when top <= 1 then floor(v * 255)::int else floor(v)::int end as value from (select vec_id, unnest(e) as v, unnest(range(1, len(e) + 1)) as pos, top from (select vec_id, e, list_max(e) as top from (select vec_id, list_transform(embedding, lambda v: abs(v::double) * case when vec_id % 2 = 0 then 1 else 200 end) as e from embeddings)))")
def range_normalise(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double")) * F.when(F.col("vec_id") % 2 == 0, 1).otherwise(200)).alias("e"))
    return e.select("vec_id", F.array_max("e").alias("top"), F.posexplode("e").alias("pos", "v")).select("vec_id", "pos", R.normalized(F.col("v"), F.col("top")).alias("value"))


METRICS = "select o_orderkey as image_id, o_totalprice / 10000 as psnr, o_custkey % 100 / 100.0::double as ms_ssim, case when o_orderkey % 3 > 0 then o_custkey % 9 / 2.0::double end as niqe from orders"


@query("with m as (" + METRICS + ") select image_id, concat_ws(chr(10), r, 'Image quality summary', r, '', printf('PSNR:      %.2f dB', round(psnr::decimal(18, 9), 2)::double), printf('MS-SSIM:   %.4f', round(ms_ssim::decimal(18, 9), 4)::double), case when niqe is not null then printf('NIQE:      %.2f', round(niqe::decimal(18, 9), 2)::double) end, '', r) as report from (select *, repeat('=', 50) as r from m)")
def summary_report(spark, d):
    o = table(spark, d, "orders")
    values = F.create_map(F.lit("psnr"), F.col("o_totalprice") / 10000, F.lit("ms_ssim"), (F.col("o_custkey") % 100) / 100.0, F.lit("niqe"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") % 9 / 2.0))
    return o.select(F.col("o_orderkey").alias("image_id"), R.summary(values).alias("report"))


@query("""with a as (select o_orderkey as image_id, 'psnr' as metric, o_totalprice as value from orders), b as (select l_orderkey as image_id, 'psnr' as metric, max(l_quantity) as value from lineitem where l_linenumber > 3 group by 1)
select coalesce(a.image_id, b.image_id) as image_id, 'psnr' as metric, coalesce(b.value, a.value) as value from a full join b using (image_id)""")
def metric_union(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit("psnr").alias("metric"), F.col("o_totalprice").alias("value"))
    b = table(spark, d, "lineitem").where("l_linenumber > 3").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.lit("psnr").alias("metric"), F.max("l_quantity").alias("value"))
    return lifecycle.later_wins(a, b)


AGENTS = "with a as (select s_suppkey as agent_id, s_suppkey as reg_order, case s_suppkey % 3 when 0 then 'IDLE' else 'BUSY' end as status, (s_suppkey % 5)::int as pending, 0 as processed from supplier), "
TASKS = "t as (select o_orderkey as task_id, case o_orderkey % 4 when 0 then 'PROCESSING' when 1 then 'SUCCESS' else 'PENDING' end as status, case when o_orderkey % 4 < 2 then o_custkey % 40 end as agent_id, (o_orderkey % 4)::int as retries, 3 as max_retries, o_totalprice as base, o_totalprice + 100.0::double * (o_orderkey % 4) as priority, null::timestamp as started from orders)\n"


def agents(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("agent_id"), k.alias("reg_order"), F.when(k % 3 == 0, "IDLE").otherwise("BUSY").alias("status"), (k % 5).cast("int").alias("pending"), F.lit(0).alias("processed"))


def tasks(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "PROCESSING").when(k % 4 == 1, "SUCCESS").otherwise("PENDING")
    return table(spark, d, "orders").select(k.alias("task_id"), status.alias("status"), F.when(k % 4 < 2, F.col("o_custkey") % 40).alias("agent_id"), (k % 4).cast("int").alias("retries"), F.lit(3).alias("max_retries"), F.col("o_totalprice").alias("base"), (F.col("o_totalprice") + 100.0 * (k % 4)).alias("priority"), F.lit(None).cast("timestamp").alias("started"))


@query(AGENTS + "n as (select s_suppkey + 5 as agent_id, s_suppkey as reg_order, 'IDLE' as status, 0 as pending, 0 as processed from supplier) select * from n union all select * from a where agent_id not in (select agent_id from n)")
def agents_registered(spark, d):
    a = agents(spark, d)
    new = a.select((F.col("agent_id") + 5).alias("agent_id"), "reg_order", F.lit("IDLE").alias("status"), F.lit(0).alias("pending"), "processed")
    return lifecycle.registered(a, new)


@query(AGENTS + TASKS + """, g as (select *, coalesce(status = 'PROCESSING' and agent_id % 7 = 0 and agent_id in (select agent_id from a), false) as gone from t)
select task_id, case when gone then 'RETRYING' else status end as status, case when not gone then agent_id end as agent_id, (retries + gone::int)::int as retries, round(case when gone then base + 100.0::double * (retries + 1) else priority end, 4) as priority from g""")
def agents_unregistered(spark, d):
    """What the agents that leave were working on fails once, as any other failure."""
    a, t = agents(spark, d), tasks(spark, d)
    return lifecycle.unregistered(a, t, a.where("agent_id % 7 = 0"), F.col("base"))[1].select("task_id", "status", "agent_id", "retries", F.round("priority", 4).alias("priority"))


@query(AGENTS + TASKS + ", p as (select task_id, task_id % 25 as to_agent from t where status = 'PENDING') select agent_id, case when m > 0 then 'BUSY' else status end as status, (pending + coalesce(m, 0))::int as pending from a left join (select to_agent as agent_id, count(*) as m from p group by 1) using (agent_id)")
def assignment_agents(spark, d):
    t = tasks(spark, d)
    pairs = t.where("status = 'PENDING'").select("task_id", (F.col("task_id") % 25).alias("to_agent"))
    return lifecycle.assigned(t, agents(spark, d), pairs, F.lit("2024-01-01").cast("timestamp"))[1].select("agent_id", "status", "pending")


@query(AGENTS + TASKS + "select task_id, case when status = 'PENDING' then 'PROCESSING' else status end as status, case when status = 'PENDING' then task_id % 25 else agent_id end as agent_id, status = 'PENDING' as begun from t")
def assignment_tasks(spark, d):
    t = tasks(spark, d)
    pairs = t.where("status = 'PENDING'").select("task_id", (F.col("task_id") % 25).alias("to_agent"))
    out = lifecycle.assigned(t, agents(spark, d), pairs, F.lit("2024-01-01").cast("timestamp"))[0]
    return out.select("task_id", "status", "agent_id", F.col("started").isNotNull().alias("begun"))


@query(AGENTS + TASKS + "select agent_id, case when coalesce(done, 0) > 0 and greatest(0, pending - done) = 0 then 'IDLE' else status end as status, greatest(0, pending - coalesce(done, 0))::int as pending, (processed + coalesce(done, 0))::int as processed from a left join (select agent_id, count(*) as done from t where status = 'SUCCESS' and task_id % 8 = 1 group by 1) using (agent_id)")
def completion_events(spark, d):
    return lifecycle.completed(agents(spark, d), tasks(spark, d).where("status = 'SUCCESS' and task_id % 8 = 1")).select("agent_id", "status", "pending", "processed")


@query(AGENTS + TASKS + """select task_id, case when task_id % 2 = 0 and retries < 3 then 'RETRYING' when task_id % 2 = 0 then 'DEGRADED' else status end as status, case when task_id % 2 = 0 and retries < 3 then retries + 1 else retries end::int as retries,
round(case when task_id % 2 = 0 and retries < 3 then base + 100.0::double * (retries + 1) when task_id % 2 = 0 then base + 500.0::double else priority end, 4) as priority, case when not (task_id % 2 = 0 and retries < 3) then agent_id end as agent_id from t""")
def failure_events(spark, d):
    t = tasks(spark, d)
    return lifecycle.failed(t, t.where("task_id % 2 = 0"), F.col("base")).select("task_id", "status", "retries", F.round("priority", 4).alias("priority"), "agent_id")


@query(AGENTS + TASKS + """, e as (select agent_id, count(*) as lost from t where status = 'PROCESSING' and task_id % 3 = 0 group by 1), f as (select agent_id, count(*) as recent from t where status = 'SUCCESS' and task_id % 1000 > 700 group by 1)
select agent_id, greatest(0, pending - coalesce(lost, 0))::int as pending, case when recent >= 3 and lost > 0 then lost else 0 end::int as degradation, case when recent >= 3 and lost > 0 then 'DEGRADED' else status end as status from a left join e using (agent_id) left join f using (agent_id)""")
def agents_after_failures(spark, d):
    t, a = tasks(spark, d), agents(spark, d).withColumn("degradation", F.lit(0))
    earlier = t.where("status = 'SUCCESS'").select("agent_id", (F.col("task_id") % 1000).alias("at"))
    out = lifecycle.agents_after_failures(a, t.where("status = 'PROCESSING' and task_id % 3 = 0"), earlier, F.lit(1000))
    return out.select("agent_id", "pending", "degradation", "status")


@query(AGENTS + "i as (select agent_id from a where status = 'IDLE' order by reg_order limit 5) select agent_id from i")
def idle_removal(spark, d):
    return lifecycle.idle_to_remove(agents(spark, d), 5).select("agent_id")


@query(AGENTS + TASKS + "select task_id, case when task_id % 4 in (0, 2, 3) then 'active' else 'completed' end as store from t")
def task_stores(spark, d):
    t = tasks(spark, d)
    return lifecycle.stores(t.where("status <> 'SUCCESS'"), t.where("status = 'SUCCESS'"), t.where("task_id % 5 = 0")).select("task_id", "store")


@query("select l_orderkey, l_linenumber, (((l_linenumber - 1) // side) * 64)::int as y, (((l_linenumber - 1) % side) * 48)::int as x from (select l_orderkey, l_linenumber, ceil(sqrt(count(*) over (partition by l_orderkey)))::int as side from lineitem)")
def grid_placement(spark, d):
    tiles = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("canvas"), (F.col("l_linenumber") - 1).alias("n"))
    return lifecycle.grid_placed(tiles, 64, 48).select(F.col("canvas").alias("l_orderkey"), (F.col("n") + 1).alias("l_linenumber"), "y", "x")


@query("select count(*)::bigint as n_tiles, count(r.k)::bigint as n_results from lineitem l left join (select distinct l_orderkey as k from lineitem where l_returnflag = 'R') r on l.l_orderkey = r.k")
def success_count(spark, d):
    li = table(spark, d, "lineitem")
    results = li.where("l_returnflag = 'R'").select("l_orderkey", F.lit(1).alias("result")).distinct()
    return li.join(results, "l_orderkey", "left").agg(F.count("*").alias("n_tiles"), F.count_if(F.col("result").isNotNull()).alias("n_results"))


@query("select page_id, url, c.block::int as block, c.ratio as ratio from pages, (values (1024, 0.2::double)) c(block, ratio)")
def batch_configured(spark, d):
    configs = F.array(F.struct(F.lit(1024).alias("block"), F.lit(0.2).alias("ratio")))  # one for the whole batch
    return table(spark, d, "pages").select("page_id", "url", F.inline(configs))


@query("""with r as (select p_partkey, (100 + p_size * 37)::int as w, (100 + p_size * 23)::int as h, case p_partkey % 6 when 0 then '100MP' when 1 then '150MP' when 2 then '200MP' when 3 then p_size || 'x' || p_partkey when 4 then ' ' || p_size || ' x 77 ' else 'large' end as label from part),
t(label, tw, th) as (values ('100MP', 12245::double, 8163::double), ('150MP', 15000, 10000), ('200MP', 17320, 11547)),
f as (select r.*, least(tw / w, th / h) as fit, regexp_matches(r.label, '^\\s*\\d{1,9}\\s*x\\s*\\d{1,9}\\s*$') as own from r left join t using (label))
select p_partkey, case when fit is not null then floor(w * fit) when own then trim(split_part(label, 'x', 1))::int else 12245 end::int as w, case when fit is not null then floor(h * fit) when own then trim(split_part(label, 'x', 2))::int else 8163 end::int as h from f""")
def custom_target_size(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    label = F.when(k % 6 == 0, "100MP").when(k % 6 == 1, "150MP").when(k % 6 == 2, "200MP").when(k % 6 == 3, F.concat(s, F.lit("x"), k)).when(k % 6 == 4, F.concat(F.lit(" "), s, F.lit(" x 77 "))).otherwise("large")
    size = planner.target_size(100 + s * 37, 100 + s * 23, label)
    return table(spark, d, "part").select("p_partkey", size.alias("size")).select("p_partkey", "size.w", "size.h")


@query("""select p_partkey, case when p_partkey % 4 = 0 then 'fine detail' when p_partkey % 4 = 1 then 'soft, fine detail, ' || p_type else p_type || ', fine detail' end as prompt from part""")
def prompt_tags(spark, d):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, " ").when(k == 1, F.concat(F.lit("soft, fine detail, "), F.col("p_type"))).otherwise(F.col("p_type"))
    tagged = planner.with_tag(text, F.lit("fine detail"))
    return table(spark, d, "part").select("p_partkey", tagged.alias("prompt"))


@query(AGENTS + TASKS + """, w as (select task_id, case when task_id % 11 = 0 then 'FAILED' when task_id % 13 = 0 then 'CANCELLED' else status end as status, agent_id, retries from t),
r as (select task_id, case when status = 'PROCESSING' then 'RETRYING' else status end as status, case when status <> 'PROCESSING' then agent_id end as agent_id, (retries + (status = 'PROCESSING')::int)::int as retries from w)
select *, case when status in ('PENDING', 'RETRYING') then 'active' when status = 'SUCCESS' then 'completed' else 'failed' end as store from r where status <> 'CANCELLED'""")
def state_restored(spark, d):
    """The tasks of a saved state as they start again."""
    k = F.col("task_id")
    t = tasks(spark, d).withColumn("status", F.when(k % 11 == 0, "FAILED").when(k % 13 == 0, "CANCELLED").otherwise(F.col("status")))
    a, at = agents(spark, d), f"{shared_folder(spark)}/pixelweave/state-{uuid.uuid4().hex}"
    lifecycle.save_state(at, t, a, a.select(F.lit("agents").alias("name"), F.col("agent_id").cast("long").alias("value")))
    return lifecycle.restore_state(spark, at, t.schema, a.schema)[0].select("task_id", "status", "agent_id", "retries", "store")


@query("""select o_orderkey, row_number() over (order by epoch(o_orderdate) desc, o_orderkey)::bigint as newest, row_number() over (order by o_totalprice desc, o_orderkey)::bigint as largest from orders""")
def history_order(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_totalprice").alias("size"), F.lit(0).alias("duration"))
    newest, largest = (scheduling.history(o, by).select("task_id", F.col("place").alias(name)) for by, name in (("newest", "newest"), ("size", "largest")))
    return newest.join(largest, "task_id").withColumnRenamed("task_id", "o_orderkey")


@query("""select s_suppkey::varchar as image_id, r::int as tile_row, c::int as tile_col, (case when (s_suppkey + r + c) % 3 = 0 then 1000 + c else c * 820 end)::int as x, (case when (s_suppkey + r + c) % 3 = 0 then 2000 + r else r * 820 end)::int as y
from supplier, (select unnest(range(3)) as r), (select unnest(range(2)) as c)""")
def tiles_moved(spark, d):
    """Three rows of two tiles for each supplier, a third of them put elsewhere."""
    tiles = tiling.tile_grid(table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("image_id"), F.lit(1800).alias("width"), F.lit(2600).alias("height")))
    some = tiles.where((F.col("image_id").cast("int") + F.col("tile_row") + F.col("tile_col")) % 3 == 0)
    places = some.select("image_id", "tile_row", "tile_col", (1000 + F.col("tile_col")).alias("x"), (2000 + F.col("tile_row")).alias("y"))
    return tiling.moved(tiles, places).select("image_id", "tile_row", "tile_col", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
