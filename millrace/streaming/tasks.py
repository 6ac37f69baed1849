"""Tasks, pipes and Structured Streaming queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Task:
    name: str
    body: Callable[[], object]
    after: tuple[str, ...] = ()
    when: Callable[[], bool] | None = None
    state: str = "STARTED"


@dataclass
class TaskGraph:
    """Tasks that run after others; a task whose predecessor failed or whose WHEN is false is skipped."""

    tasks: dict[str, Task] = field(default_factory=dict)
    log: list[tuple[str, str, float, str | None]] = field(default_factory=list)

    def add(self, task: Task) -> None:
        self.tasks[task.name] = task

    def run(self) -> list[str]:
        done: dict[str, str] = {}
        for name in TopologicalSorter({t.name: t.after for t in self.tasks.values()}).static_order():
            t = self.tasks[name]
            if t.state != "STARTED" or any(done.get(a) != "SUCCEEDED" for a in t.after) or t.when and not t.when():
                done[name] = "SKIPPED"
                error = None
            else:
                try:
                    t.body()
                    done[name], error = "SUCCEEDED", None
                except Exception as e:
                    done[name], error = "FAILED", str(e)
            self.log.append((name, done[name], time.time(), error))
        return [f"{n}: {s}" for n, s in done.items()]

    def dependents(self, name: str) -> list[str]:
        """TASK_DEPENDENTS: the task and all that run after it."""
        found, todo = [name], [name]
        while todo:
            now = todo.pop()
            for t in self.tasks.values():
                if now in t.after and t.name not in found:
                    found.append(t.name)
                    todo.append(t.name)
        return found

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "NAME string, STATE string, COMPLETED_TIME double, ERROR_MESSAGE string")


def pipe(spark: SparkSession, stage: str, format: str, schema: str | T.StructType, target: str, checkpoint: str, **options: str) -> StreamingQuery:
    """A PIPE: files that arrive in a stage are appended to a Parquet table, each once."""
    rows = spark.readStream.format(format).schema(schema).options(**options).load(stage)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding window, for batches and streams alike; late rows within ``late`` are counted."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")
