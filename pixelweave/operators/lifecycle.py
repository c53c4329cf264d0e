"""Tasks and agents as tables: what an event changes is a join, an update of columns and a union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pixelweave.operators.scheduling import failure


def registered(agents: DataFrame, new: DataFrame) -> DataFrame:
    """Agents and new ones; of an agent that is in both the new row counts. Columns are those of ``agents``."""
    old = agents.join(new.select("agent_id"), "agent_id", "left_anti")
    return old.unionByName(new.select(*agents.columns))


def unregistered(agents: DataFrame, tasks: DataFrame, gone: DataFrame, base: Column) -> tuple[DataFrame, DataFrame]:
    """Agents without those ``gone`` (agent_id), and tasks after the failure of what these were working on; ``base``: see ``failure``."""
    gone = agents.join(gone.select("agent_id").distinct(), "agent_id", "left_semi").select("agent_id")
    hit = tasks.where(F.col("status") == "PROCESSING").join(gone, "agent_id", "left_semi").select("task_id")
    return agents.join(gone, "agent_id", "left_anti"), failed(tasks, hit, base)


def assigned(tasks: DataFrame, agents: DataFrame, pairs: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Tasks and agents after ``pairs`` (task_id, to_agent): tasks are processed from ``now`` on, agents busy with so many more."""
    t = tasks.join(pairs.select("task_id", "to_agent"), "task_id", "left")
    on = F.col("to_agent").isNotNull()
    t = t.withColumn("status", F.when(on, "PROCESSING").otherwise(F.col("status"))).withColumn("agent_id", F.coalesce("to_agent", "agent_id")).withColumn("started", F.when(on, now).otherwise(F.col("started")))
    more = pairs.groupBy(F.col("to_agent").alias("agent_id")).agg(F.count("*").cast("int").alias("more"))
    a = agents.join(more, "agent_id", "left")
    a = a.withColumn("status", F.when(F.col("more") > 0, "BUSY").otherwise(F.col("status"))).withColumn("pending", F.col("pending") + F.coalesce("more", F.lit(0)))
    return t.select(*tasks.columns), a.select(*agents.columns)


def completed(agents: DataFrame, events: DataFrame) -> DataFrame:
    """Agents after the tasks in ``events`` (agent_id) are done: fewer pending, more processed, idle when nothing is pending."""
    done = events.groupBy("agent_id").agg(F.count("*").cast("int").alias("done"))
    a = agents.join(done, "agent_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    left = F.greatest(F.lit(0), F.col("pending") - F.col("done"))
    a = a.withColumn("status", F.when((F.col("done") > 0) & (left == 0), "IDLE").otherwise(F.col("status"))).withColumn("processed", F.col("processed") + F.col("done")).withColumn("pending", left)
    return a.select(*agents.columns)


def failed(tasks: DataFrame, events: DataFrame, base: Column) -> DataFrame:
    """Tasks after failures (task_id), by the one rule for them, ``failure``; several events of a task at once are one failure."""
    hit = tasks.join(events.select("task_id", F.lit(True).alias("is_hit")).distinct(), "task_id", "left").withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))
    return hit.withColumns(failure(tasks.columns, base, F.col("is_hit"))).select(*tasks.columns)


def agents_after_failures(agents: DataFrame, events: DataFrame, earlier: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Agents after tasks of theirs failed (events: agent_id): fewer pending; with three and more failures (earlier: agent_id, at) in the
    ``seconds`` before ``now`` an agent is degraded by a level for each event."""
    counts = events.groupBy("agent_id").agg(F.count("*").cast("int").alias("lost"))
    recent = earlier.where(now - F.col("at") < seconds).groupBy("agent_id").agg(F.count("*").alias("recent"))
    a = agents.join(counts, "agent_id", "left").join(recent, "agent_id", "left")
    lost, worn = F.coalesce("lost", F.lit(0)), F.coalesce((F.col("recent") >= 3) & (F.col("lost") > 0), F.lit(False))
    a = a.withColumns({
        "pending": F.greatest(F.lit(0), F.col("pending") - lost), "degradation": F.col("degradation") + F.when(worn, lost).otherwise(0),
        "status": F.when(worn, "DEGRADED").otherwise(F.col("status")),
    })
    return a.select(*agents.columns)


def save_state(path: str, tasks: DataFrame, agents: DataFrame, stats: DataFrame) -> None:
    """The scheduler's tables as JSON under ``path``, a new folder for each point in time: tasks (of all stores), agents and stats (name, value)."""
    for name, table in (("tasks", tasks), ("agents", agents), ("stats", stats)):
        table.write.option("ignoreNullFields", False).json(f"{path}/{name}")


def restore_state(spark: SparkSession, path: str, tasks: StructType, agents: StructType) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks with their store, agents, stats) of ``save_state`` as a scheduler starts with them; ``tasks`` and ``agents``: the tables' schemas.

    What was being worked on is retried without its agent; pending and retried tasks are queued, finished and failed ones keep their
    stores, others (cancelled, degraded) are forgotten. Agents are idle with nothing pending.
    """
    t = spark.read.schema(tasks).json(f"{path}/tasks")
    lost = F.col("status") == "PROCESSING"
    t = t.withColumns({"retries": F.col("retries") + lost.cast("int"), "agent_id": F.when(~lost, F.col("agent_id")), "status": F.when(lost, "RETRYING").otherwise(F.col("status"))})
    store = F.when(F.col("status").isin("PENDING", "RETRYING"), "active").when(F.col("status") == "SUCCESS", "completed").when(F.col("status") == "FAILED", "failed")
    a = spark.read.schema(agents).json(f"{path}/agents").withColumns({"status": F.lit("IDLE"), "pending": F.lit(0)})
    return t.withColumn("store", store).where("store is not null"), a, spark.read.schema("name string, value long").json(f"{path}/stats")


def idle_to_remove(agents: DataFrame, count: int) -> DataFrame:
    """The first ``count`` idle agents in order of registration."""
    return agents.where("status = 'IDLE'").orderBy("reg_order").limit(count)


def stores(active: DataFrame, done: DataFrame, broken: DataFrame) -> DataFrame:
    """All stores' tasks with the store's name; of a task in several the first store's row, in the order given."""
    named = [df.withColumn("store", F.lit(n)).withColumn("rank", F.lit(k)) for k, (n, df) in enumerate((("active", active), ("completed", done), ("failed", broken)))]
    every = named[0].unionByName(named[1]).unionByName(named[2])
    row = F.struct(*[c for c in every.columns if c not in ("task_id", "rank")])
    return every.groupBy("task_id").agg(F.min_by(row, "rank").alias("row")).select("task_id", "row.*")


def later_wins(*metrics: DataFrame) -> DataFrame:
    """(image_id, metric, value) of several long tables; of equal keys the later table's value counts."""
    every = None
    for k, m in enumerate(metrics):
        part = m.select("image_id", "metric", "value", F.lit(k).alias("rank"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("image_id", "metric").agg(F.max_by("value", "rank").alias("value"))


def grid_placed(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """``tiles`` (canvas, n: place in order from 0) on a square grid of tiles, row by row: y, x."""
    side = F.ceil(F.sqrt(F.count("*").over(Window.partitionBy("canvas"))))
    at = tiles.withColumn("side", side)
    return at.withColumn("y", (F.floor(F.col("n") / F.col("side")) * height).cast("int")).withColumn("x", (F.col("n") % F.col("side") * width).cast("int")).drop("side")
