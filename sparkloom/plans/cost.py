"""What a statement cost on the executors, and warnings."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Cost:
    """Executor run seconds, and bytes read from inputs and through shuffles, of all stages of a statement."""

    executor_seconds: float
    input_bytes: int
    shuffle_bytes: int


def collect_cost(spark: SparkSession, run: Callable[[], object]) -> tuple[object, Cost]:
    """Runs a statement in a job group of its own and adds up its stages' metrics from the status store."""
    context, group = spark.sparkContext, f"cost-{uuid.uuid4().hex}"
    context.setJobGroup(group, "measured statement")
    try:
        result = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)  # type: ignore[arg-type]
        context.setLocalProperty("spark.job.description", None)  # type: ignore[arg-type]
    scala = context._jsc.sc()
    scala.listenerBus().waitUntilEmpty(10_000)
    tracker, store = context.statusTracker(), scala.statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    seconds = read = moved = 0
    for s in stages:
        try:
            found = store.lastStageAttempt(s)
        except Exception:  # noqa: BLE001, S112  a stage that was skipped has no record
            continue
        seconds += found.executorRunTime()
        read += found.inputBytes()
        moved += found.shuffleReadBytes()
    return result, Cost(seconds / 1000, read, moved)


def collect_warnings() -> list:
    """Spark has no statement warnings: always empty."""
    return []
