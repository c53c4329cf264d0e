"""The life of tasks as a stream: each task is a state that its events and the silence of its agent move on.

Events: ts, task_id, kind, agent_id, base (priority without penalties), scale, max_retries; the last three count with kind "submit". Kinds:
submit, assign (to agent_id), heartbeat, complete, fail, recover (a scheduler that starts again). What comes out is a row for each change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "ts timestamp, task_id string, kind string, agent_id string, base double, scale double, max_retries int"
CHANGES = "task_id string, at timestamp, cause string, status string, retries int, priority double, scale double, agent_id string"
_STATE = "status string, retries int, base double, priority double, scale double, agent_id string, max_retries int, seen double"
_OUT = ["task_id", "at", "cause", "status", "retries", "priority", "scale", "agent_id"]


@dataclass
class Task:
    """A task's state; ``seen`` is when its agent was last heard, in seconds."""

    status: str = "UNKNOWN"
    retries: int = 0
    base: float = 0.0
    priority: float = 0.0
    scale: float = 1.0
    agent_id: str | None = None
    max_retries: int = 3
    seen: float = 0.0

    def failed(self) -> None:
        """The rule of ``scheduling.failure`` for one task."""
        if self.retries < self.max_retries:
            self.retries += 1
            self.status, self.priority, self.agent_id = "RETRYING", self.base + 100.0 * self.retries, None
            return
        self.status, self.priority = "DEGRADED", self.base + 500.0
        if self.scale > 1.5:
            self.scale, self.retries = max(1.5, self.scale * 0.7), 0

    def silent(self, at: float, seconds: float) -> bool:
        return self.status == "PROCESSING" and at > self.seen + seconds

    def step(self, kind: str, at: float, agent: str | None, base: float, scale: float, most: int) -> bool:
        """Whether an event changed more than when the agent was heard; events that don't fit the state change nothing."""
        if kind == "submit" and self.status == "UNKNOWN":
            self.status, self.base, self.priority, self.scale, self.max_retries = "PENDING", base, base, scale, most
        elif kind == "assign" and self.status in ("PENDING", "RETRYING", "DEGRADED"):
            self.status, self.agent_id, self.seen = "PROCESSING", agent, at
        elif self.status != "PROCESSING":
            return False
        elif kind == "heartbeat":
            self.seen = max(self.seen, at)
            return False
        elif kind == "complete":
            self.status = "SUCCESS"
        elif kind == "fail":
            self.failed()
        elif kind == "recover":
            self.status, self.retries, self.agent_id = "RETRYING", self.retries + 1, None
        else:
            return False
        return True


def _time(seconds: float) -> pd.Timestamp:
    return pd.Timestamp(round(seconds * 1e6), unit="us")


def _changes(task: Task, task_id: str, events: pd.DataFrame, seconds: float) -> Iterator[tuple]:
    """Moves a task on by its events, by time and then kind; a silence before an event is a failure of its own, when it became too long."""
    row = lambda at, cause: (task_id, _time(at), cause, task.status, task.retries, task.priority, task.scale, task.agent_id)
    ordered = events.assign(at=events["ts"].astype("datetime64[us]").astype("int64") / 1e6).sort_values(["at", "kind"], kind="stable")
    for e in ordered.itertuples(index=False):
        if task.silent(e.at, seconds):
            task.failed()
            yield row(task.seen + seconds, "silence")
        if task.step(e.kind, e.at, e.agent_id, e.base, e.scale, 3 if pd.isna(e.max_retries) else int(e.max_retries)):
            yield row(e.at, e.kind)


def task_changes(events: DataFrame, seconds: float = 30, late: str = "10 seconds") -> DataFrame:
    """``CHANGES`` of a stream of events, in update mode; a task in work whose agent is silent for more than ``seconds`` fails by itself.

    Each task has a timer in event time, so silence is noticed without any event of the task once the watermark (``late`` behind the
    newest event) has passed it. The state lives in the query's checkpoint: a query that is started again goes on where it was. Events of
    one task must come in order as far as batches go; inside a batch they are sorted. What comes out doesn't depend on how events are
    cut into batches.
    """

    def move(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        task = Task(*state.get) if state.exists else Task()
        if state.hasTimedOut:
            rows = []
            if task.silent(state.getCurrentWatermarkMs() / 1000, seconds):
                task.failed()
                rows = [(key[0], _time(task.seen + seconds), "silence", task.status, task.retries, task.priority, task.scale, task.agent_id)]
        else:
            rows = list(_changes(task, key[0], pd.concat(frames), seconds))
        state.update((task.status, task.retries, task.base, task.priority, task.scale, task.agent_id, task.max_retries, task.seen))
        if task.status == "PROCESSING":
            state.setTimeoutTimestamp(max(int((task.seen + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=_OUT)

    keyed = events.withWatermark("ts", late).groupBy("task_id")
    return keyed.applyInPandasWithState(move, CHANGES, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def task_history(events: DataFrame, seconds: float = 30) -> DataFrame:
    """``CHANGES`` of a table of events: what the stream gives, but for silences after a task's last event.

    Null base and scale are 0 and 1. Rows without task_id are one task's. An empty table gives no rows.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_changes(Task(), key[0], pdf, seconds)), columns=_OUT)

    return events.na.fill({"base": 0.0, "scale": 1.0}).groupBy("task_id").applyInPandas(run, CHANGES)
