"""Task scheduling as queries: priorities, balancing, retries, scaling and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority(vip: str, roi: str, edge: str, seconds: str) -> Column:
    """Lower goes first."""
    return F.col(vip) * -10000.0 - F.col(roi).cast("int") * 1000.0 - F.col(edge).cast("int") * 100.0 + F.col(seconds) * 0.001


def agent_weight() -> Column:
    speed = F.when(F.col("avg_time") > 0, 1000.0 / (F.col("avg_time") + 1)).otherwise(0.0)
    near = F.when(F.col("latency") > 0, F.greatest(F.lit(0.0), 100 - F.col("latency") * 0.1)).otherwise(0.0)
    return 100.0 + F.greatest(F.lit(0), F.col("capacity") - F.col("pending")) * 10.0 + speed + near - F.col("degradation") * 50.0


def available() -> Column:
    return F.col("status").isin("IDLE", "BUSY") & (F.col("pending") < F.col("capacity")) & (F.col("degradation") < 3)


def ranked(df: DataFrame, order: list[Column], name: str, buckets: int = 64) -> DataFrame:
    """``df`` with a global rank without one task for all: ranges of the first key are counted, then ranked inside."""
    first = order[0]
    bounds = df.agg(F.percentile_approx(first, [k / buckets for k in range(1, buckets)], 10_000).alias("b"))
    cut = df.join(F.broadcast(bounds)).withColumn("range", F.size(F.filter("b", lambda x: x < first))).drop("b")
    before = cut.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return cut.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn(name, (F.col("before") + F.col("inside")).cast("long")).drop("range", "inside", "before")


def dispatch(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """(task_id, agent_id): tasks by priority meet free slots by weight; a slot weighs 10 less for each one before it.

    The same as giving each task in turn to the agent that then weighs most, as a join of two ranks.
    """
    free = agents.where(available()).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("capacity") - F.col("pending") - 1)))
    slots = ranked(free.withColumn("less", -(agent_weight() - F.col("k") * 10.0)), [F.col("less"), F.col("reg_order"), F.col("k")], "place").select("place", "agent_id")
    queue = ranked(tasks, [F.col("priority"), F.col("task_id")], "place").select("place", "task_id")
    return queue.join(slots, "place").select("task_id", "agent_id")


def autoscale(depth: str, agents: str, idle: str, concurrent: str, most: int = 500) -> Column:
    """How many agents there should be for a queue of ``depth`` tasks, of which ``concurrent`` may run at a time."""
    usage = F.col(depth) / F.greatest(F.lit(1), F.col(concurrent))
    grow = F.least(F.lit(most), F.col(agents) + F.when(F.col(depth) >= 100, 20).otherwise(5))
    up = (usage > 0.8) & (F.col(depth) >= 50)
    down = (usage < 0.2) & (F.col(depth) < 10) & (F.col(idle) > 5)
    return F.when(up, F.greatest(grow, F.col(agents))).when(down, F.greatest(F.col(agents) - 3, F.lit(5))).otherwise(F.col(agents))


def failure(columns: list[str], base: Column, hit: Column | None = None) -> dict[str, Column]:
    """The columns of tasks (of those in ``columns``) that a failure changes, where ``hit`` holds.

    While tries are left the task is retried, without its agent. Then it is degraded: a smaller scale (if it is above 1.5; then the
    tries begin anew and the target shrinks along), tiles of 256 with an overlap of 16 where they are larger, another engine.
    The penalty comes on top of ``base``, the priority without penalties, so those of earlier failures don't pile up.
    """
    hit = F.lit(True) if hit is None else hit
    again, scaled = hit & (F.col("retries") < F.col("max_retries")), F.lit(False)
    worn = hit & ~again
    out = {
        "status": F.when(again, "RETRYING").when(worn, "DEGRADED").otherwise(F.col("status")),
        "agent_id": F.when(~again, F.col("agent_id")),
        "started": F.when(~again, F.col("started")),
        "priority": F.when(again, base + 100.0 * (F.col("retries") + 1)).when(worn, base + 500.0).otherwise(F.col("priority")),
        "fallback": worn | F.col("fallback"),
    }
    if "scale" in columns:
        scaled, smaller = worn & (F.col("scale") > 1.5), F.greatest(F.lit(1.5), F.col("scale") * 0.7)
        out["scale"] = F.when(scaled, smaller).otherwise(F.col("scale"))
        for c in ("target_w", "target_h"):
            out[c] = F.when(scaled, F.floor(F.col(c) * smaller / F.col("scale")).cast("int")).otherwise(F.col(c))
    out["retries"] = F.when(again, F.col("retries") + 1).when(scaled, 0).otherwise(F.col("retries"))
    large = worn & (F.col("tile_size") > 256)
    out |= {c: F.when(large, n).otherwise(F.col(c)) for c, n in (("overlap", 16), ("tile_size", 256))}
    return {c: v for c, v in out.items() if c in columns}


def recent_failures(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Failures (agent, event_id, at) with the number of the agent's failures in the ``seconds`` before, itself included."""
    recent = Window.partitionBy("agent").orderBy("at").rangeBetween(-seconds, 0)
    return events.withColumn("n_recent", F.count("*").over(recent)).withColumn("degrades", F.col("n_recent") >= 3)


def ewma(events: DataFrame, keep: float = 0.9, span: int = 3600) -> DataFrame:
    """(agent, duration): the first duration, then moved towards each next one by 1 - ``keep``; zeros are skipped.

    A duration with k later ones weighs (1 - keep) * keep**k, the first one keep**k. So ranges of ``span`` seconds are summed for
    themselves and each sum is moved by the number of durations in later ranges: a busy agent is as many groups as it has ranges.
    """
    last = Window.partitionBy("agent", "range").orderBy(F.desc("at"), F.desc("event_id"))
    after = F.row_number().over(last) - 1
    rows = events.where("duration > 0").withColumn("range", F.floor(F.col("at") / span)).withColumn("after", after)
    sums = rows.groupBy("agent", "range").agg(
        F.count("*").alias("n"), F.sum((1 - keep) * F.pow(F.lit(keep), F.col("after")) * F.col("duration")).alias("part"),
        F.max_by("duration", "after").alias("first"),
    )
    later = Window.partitionBy("agent").orderBy(F.desc("range"))
    moved = sums.withColumn("upto", F.sum("n").over(later))
    total = F.sum(F.pow(F.lit(keep), F.col("upto") - F.col("n")) * F.col("part"))
    first = keep * F.pow(F.lit(keep), F.max("upto") - 1) * F.min_by("first", "range")
    return moved.groupBy("agent").agg((total + first).alias("duration"))


def heartbeat_gaps(events: DataFrame, seconds: int = 30) -> DataFrame:
    """Heartbeats (agent, event_id, at) with whether the next of the agent came too late (the last one: unknown)."""
    following = F.lead("at").over(Window.partitionBy("agent").orderBy("at", "event_id"))
    return events.withColumn("offline_after", (following - F.col("at")) > seconds)


def validate(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(task_id, reason): why a task's result is refused, null where it is taken; ``tasks``: task_id, target_w, target_h."""
    off = lambda got, want: F.abs(F.col(got) - F.col(want)) / F.col(want) > 0.05
    missing = F.col("output_path").isNull() | F.col("width").isNull() | F.col("height").isNull() | F.col("color_mode").isNull()
    reason = F.when(missing, "missing").when(off("width", "target_w"), "width").when(off("height", "target_h"), "height")
    return tasks.join(results, "task_id").select("task_id", reason.alias("reason"))


def restored(tasks: DataFrame) -> DataFrame:
    """Tasks of a saved state as they start again: what was being processed is retried without its agent."""
    lost = F.col("status") == "PROCESSING"
    return tasks.select(
        "task_id", F.when(lost, "RETRYING").otherwise(F.col("status")).alias("status"), (F.col("retries") + lost.cast("int")).alias("retries"),
        F.when(~lost, F.col("agent_id")).alias("agent_id"), F.col("status").isin("PROCESSING", "PENDING", "RETRYING").alias("queued"),
    )


def orphaned(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Tasks assigned to agents that are offline or not registered."""
    alive = agents.where("status <> 'OFFLINE'").select("agent_id")
    return tasks.where("agent_id is not null").join(alive, "agent_id", "left_anti")


def zipped(left: DataFrame, right: DataFrame, by: list[Column], other: list[Column]) -> DataFrame:
    """The rows of ``left`` in order ``by`` next to those of ``right`` in order ``other``, as far as both go; place counts from 1."""
    return ranked(left, by, "place").join(ranked(right, other, "place"), "place")


#: What a history can be ordered by: newest and oldest first, largest first, longest first.
ORDERS = {"newest": [("at", True)], "oldest": [("at", False)], "size": [("size", True)], "duration": [("duration", True)]}


def history(tasks: DataFrame, by: str = "newest") -> DataFrame:
    """``tasks`` (task_id, at, size, duration and others) with their place in an order of ``ORDERS``; ties by task_id."""
    keys = [F.col(c) if not down else -F.col(c) for c, down in ORDERS[by]]
    return ranked(tasks, [*keys, F.col("task_id")], "place")
