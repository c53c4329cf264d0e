"""The stream of tasks against a table's history and a plain reading of the rules."""

import random
from datetime import datetime, timedelta

from pixelweave.plans import queries
from pixelweave.streaming import tasks

START = datetime(2024, 1, 1)


def made_up(seed, n_tasks=12, steps=400):
    """Events of some tasks in order of time, every one at its own second; silences of all lengths among them."""
    rng, rows, at = random.Random(seed), [], 0
    for k in range(n_tasks):
        at += 1
        rows.append((at, f"t{k}", "submit", None, float(rng.randint(-999, 999)), rng.choice([1.0, 2.0, 4.0]), rng.choice([0, 1, 3])))
    for _ in range(steps):
        at += rng.choice([1, 1, 2, 9])
        kind = rng.choice(["assign"] * 4 + ["heartbeat"] * 6 + ["fail"] * 2 + ["complete", "recover", "submit", "nonsense"])
        rows.append((at, f"t{rng.randrange(n_tasks)}", kind, f"a{rng.randrange(4)}", 5.0, 3.0, 2))
    return [(START + timedelta(seconds=r[0]), *r[1:]) for r in rows]


def plainly(rows, seconds=30):
    """Changes by the rules, one event after the other."""
    out, state = [], {}
    for ts, task, kind, agent, base, scale, most in sorted(rows, key=lambda r: (r[0], r[2])):
        s = state.setdefault(task, {"status": None})

        def fail(s=s):
            if s["retries"] < s["most"]:
                s.update(retries=s["retries"] + 1, status="RETRYING", agent=None)
                s["priority"] = s["base"] + 100 * s["retries"]
            else:
                s.update(status="DEGRADED", priority=s["base"] + 500)
                if s["scale"] > 1.5:
                    s.update(scale=max(1.5, s["scale"] * 0.7), retries=0)

        def tell(at, cause, s=s, task=task):
            out.append((task, at, cause, s["status"], s["retries"], s["priority"], s["scale"], s["agent"]))

        if s["status"] == "PROCESSING" and ts > s["seen"] + timedelta(seconds=seconds):
            fail()
            tell(s["seen"] + timedelta(seconds=seconds), "silence")
        if kind == "submit" and s["status"] is None:
            s.update(status="PENDING", base=base, priority=base, scale=scale, most=most, retries=0, agent=None)
            tell(ts, kind)
        elif kind == "assign" and s["status"] in ("PENDING", "RETRYING", "DEGRADED"):
            s.update(status="PROCESSING", agent=agent, seen=ts)
            tell(ts, kind)
        elif s["status"] == "PROCESSING" and kind == "heartbeat":
            s["seen"] = ts
        elif s["status"] == "PROCESSING" and kind in ("complete", "fail", "recover"):
            if kind == "fail":
                fail()
            else:
                s.update(status="SUCCESS") if kind == "complete" else s.update(status="RETRYING", retries=s["retries"] + 1, agent=None)
            tell(ts, kind)
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_history_follows_the_rules(spark):
    for seed in (1, 2):
        rows = made_up(seed)
        assert rows_of(tasks.task_history(spark.createDataFrame(rows, tasks.EVENTS))) == plainly(rows)
    assert tasks.task_history(spark.createDataFrame([], tasks.EVENTS)).count() == 0


def test_stream_that_is_killed_and_started_again(spark, tmp_path):
    rows = made_up(3)
    end = rows[-1][0]
    # Silences after a task's last event are noticed too: an event that fits no state, long after, lets the table's history see them.
    late = [(end + timedelta(hours=1), f"t{k}", "nonsense", None, None, None, None) for k in range(12)]
    want = plainly(rows + late)
    clock = [(end + timedelta(hours=1 + k), "clock", "nonsense", None, None, None, None) for k in range(3)]
    folder, out, at = tmp_path / "in", tmp_path / "out", 0
    (folder).mkdir()

    def feed(some):
        nonlocal at
        spark.createDataFrame(some, tasks.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        at += 1

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    def run():
        stream = spark.readStream.schema(tasks.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = tasks.task_changes(stream).writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination()

    cuts = [0, 90, 200, 333, len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        feed(rows[a:b])
        run()  # each run is a query of its own that goes on from the checkpoint
    for c in clock:
        feed([c])
        run()
    assert rows_of(spark.read.parquet(f"{out}/*")) == want
    assert any(r[2] == "silence" for r in want) and any(r[3] == "DEGRADED" for r in want)


def test_registered_history(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert queries.QUERIES["task_history"](spark, "/root/testdata/sf0.001").count() > events.count() / 10
