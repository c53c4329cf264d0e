"""Every registered query of the core library against its SQL, and invariants of the operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import blocks, fusion, scheduling, seams, tiling
from pixelweave.plans import queries
from pixelweave.streaming import heartbeats

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if not (got[c].astype(str) == want[c].astype(str)).all():
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)


def test_grid_covers_every_place(spark):
    rng = np.random.default_rng(3)
    sizes = [(str(k), int(rng.integers(1, 700)), int(rng.integers(1, 700))) for k in range(20)]
    tiles = tiling.tile_grid(spark.createDataFrame(sizes, "image_id string, width int, height int"), 128, 0.2).collect()
    for image, width, height in sizes:
        seen = np.zeros((height, width), bool)
        for t in tiles:
            if t.image_id == image:
                seen[t.y : t.y + t.h, t.x : t.x + t.w] = True
        assert seen.all()


def test_grid_checks_ratio(spark):
    with pytest.raises(ValueError):
        tiling.tile_grid(spark.range(1), ratio=0.5)


def test_neighbors_are_symmetric(spark):
    tiles = tiling.tile_grid(spark.createDataFrame([("a", 3000, 2000)], "image_id string, width int, height int"))
    pairs = {(r.tile_row, r.tile_col, r.n_row, r.n_col) for r in tiling.neighbors(tiles).collect()}
    assert pairs and all((c, d, a, b) in pairs for a, b, c, d in pairs)


def test_dispatch_is_the_greedy_choice(spark):
    rng = np.random.default_rng(5)
    agents = [(f"a{k}", k, "IDLE", int(rng.integers(1, 4)), 0, float(rng.integers(0, 80)), int(rng.integers(0, 3)), float(rng.integers(0, 50))) for k in range(12)]
    tasks = [(k, float(rng.integers(0, 5))) for k in range(30)]
    agents_df = spark.createDataFrame(agents, "agent_id string, reg_order int, status string, capacity int, pending int, latency double, degradation int, avg_time double")
    got = {r.task_id: r.agent_id for r in scheduling.dispatch(spark.createDataFrame(tasks, "task_id int, priority double"), agents_df).collect()}
    weight = {r.agent_id: r.w for r in agents_df.select("agent_id", scheduling.agent_weight().alias("w")).collect()}
    load, want = dict.fromkeys(weight, 0), {}
    for task, _ in sorted(tasks, key=lambda t: (t[1], t[0])):
        free = [a for a in agents if load[a[0]] < a[3]]
        if free:
            best = max(free, key=lambda a: (weight[a[0]] - 10 * load[a[0]], -a[1]))
            load[best[0]] += 1
            want[task] = best[0]
    assert got == want


def test_fusing_equal_tiles_changes_nothing(spark):
    rows = spark.range(100 * 90).select((F.col("id") / 90).cast("int").alias("y"), (F.col("id") % 90).cast("int").alias("x"), F.lit(7).alias("g"))
    tiles = tiling.tile_grid(spark.createDataFrame([("a", 90, 100)], "image_id string, width int, height int"), 40, 0.2)
    inner = fusion.fuse(rows, tiles, fusion.distance_weight("linear")).where("value > 0").agg(F.min("value"), F.max("value")).first()
    assert inner[0] == pytest.approx(7) and inner[1] == pytest.approx(7)


def test_severity(spark):
    rows = spark.createDataFrame([(0.5,), (0.9,), (0.95,)], "s double").select(seams.severity(F.col("s")).alias("v")).collect()
    assert [r.v for r in rows] == ["high", "medium", "low"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = heartbeats.throughput(stream).writeStream.outputMode("complete").format("memory").queryName("throughput").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("throughput").collect())) == sorted(map(key, heartbeats.throughput(events).collect()))


def test_entry_without_the_optional_subpackage(tmp_path):
    """The entry imports and lists the core queries where the optional folders, or also the pipeline's file, are gone."""
    root = Path(__file__).resolve().parents[1]
    for keep_pipeline in (True, False):
        at = tmp_path / str(keep_pipeline)
        shutil.copytree(root / "pixelweave", at / "pixelweave", ignore=shutil.ignore_patterns("llm"))
        (at / "pixelweave/llm/__pycache__").mkdir(parents=True)
        for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (keep_pipeline and (root / "corpus_pipeline.py").exists()):
            shutil.copy(root / name, at / name)
        code = "import __spark_entry__ as e; assert 'tile_grid' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
        subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env={**os.environ, "PYTHONPATH": str(at)})


def _down(a):
    p = np.pad(a, 2, mode="reflect")
    k = np.array([1, 4, 6, 4, 1]) / 16
    return sum(k[i] * k[j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(5) for j in range(5))[::2, ::2]


def _up(a, shape):
    def axis(b, n):
        first, last = b[1:2] if len(b) > 1 else b[:1], b[-1:]
        p = np.concatenate([first, b, last])
        out = np.empty((2 * len(b), b.shape[1]))
        out[0::2], out[1::2] = (p[:-2] + 6 * p[1:-1] + p[2:]) / 8, (p[1:-1] + p[2:]) / 2
        return out[:n]

    return axis(axis(a, shape[0]).T, shape[1]).T


def test_laplacian_fusion_against_whole_arrays(spark):
    rng = np.random.default_rng(2)
    tiles = [(0, 0, rng.integers(0, 256, (37, 30))), (0, 22, rng.integers(0, 256, (37, 30)))]
    weights = [np.minimum(1, 0.2 + np.minimum(np.arange(30), np.arange(30)[::-1]) / 6)[None].repeat(37, 0)] * 2
    rows = [(str(k), "c", y, x, int(g[y, x]), float(w[y, x]), ty, tx) for k, ((ty, tx, g), w) in enumerate(zip(tiles, weights, strict=True)) for y in range(37) for x in range(30)]
    px = spark.createDataFrame(rows, "image_id string, canvas string, y int, x int, g int, weight double, tile_y int, tile_x int")
    got = blocks.to_pixels(blocks.laplacian_fusion(blocks.to_blocks(px, ("g", "weight"), 16), px.select("image_id", "canvas", "tile_y", "tile_x").distinct(), 2, 16), 16).toPandas()
    total, base = np.zeros((37, 52)), np.zeros((37, 52))
    for (ty, tx, g), w in zip(tiles, weights, strict=True):
        gs, ws = [g.astype(float)], [w]
        for _ in range(2):
            gs.append(_down(gs[-1]))
            ws.append(_down(ws[-1]))
        out = gs[-1] * ws[-1]
        for k in (1, 0):
            out = (gs[k] - _up(gs[k + 1], gs[k].shape)) * ws[k] + _up(out, gs[k].shape)
        total[ty : ty + 37, tx : tx + 30] += out
        base[ty : ty + 37, tx : tx + 30] += w
    want = np.clip(total / np.maximum(base, 1e-6), 0, 255)
    assert len(got) == want.size and np.abs(want[got.y, got.x] - got.value).max() < 1e-6


def test_blocks_hold_their_pixels(spark):
    px = spark.range(50 * 33).select(F.lit("a").alias("image_id"), F.floor(F.col("id") / 33).cast("int").alias("y"), (F.col("id") % 33).cast("int").alias("x"), F.col("id").alias("g"))
    back = blocks.to_pixels(blocks.to_blocks(px, block=16), 16)
    assert back.join(px, ["image_id", "y", "x"]).where("value = g").count() == back.count() == 50 * 33
