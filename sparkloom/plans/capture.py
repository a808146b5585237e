"""Workload capture as JSON lines, its analysis, and cost baselines. Analysis and comparison are Spark queries."""

from __future__ import annotations

import contextvars
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .observe import Event, observing

_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="")
#: Fixed values of the rules.
FACTOR, LEAST = 1.30, 5
SCHEMA = "capture string, scope string, terminal string, operation string, model string, fingerprint string, seconds double, cost double, rows long, error string"
READS = ("Query", "Aggregate", "Nearest")


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Statements inside belong to one unit of work, such as a request."""
    mark = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(mark)


class RuntimeCapture:
    """Writes completed statements: shapes and fingerprints, never values."""

    def __init__(self, path: str, name: str, cost: Callable[[Event], float] | None = None) -> None:
        self.path, self.name, self.cost = path, name, cost or (lambda e: e.seconds)

    @contextmanager
    def recording(self) -> Iterator[RuntimeCapture]:
        with open(self.path, "a") as out:

            def write(e: Event) -> None:
                out.write(json.dumps({"capture": self.name, "scope": _scope.get(), "terminal": e.terminal, "operation": e.operation, "model": e.model, "fingerprint": e.fingerprint, "shape": e.shape, "seconds": e.seconds, "cost": None if e.error else self.cost(e), "rows": e.rows, "error": e.error}) + "\n")

            with observing(write):
                yield self


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def repeated(capture: DataFrame) -> DataFrame:
    """(capture, scope, operation, fingerprint, terminal, n, code): statements run twice or more in one scope.

    RUN002 repeated reads (N+1), RUN004 repeated inserts, RUN005 repeated updates.
    """
    code = F.when(F.col("operation").isin(*READS), "RUN002").when(F.col("operation").isin("Insert", "Upsert"), "RUN004").otherwise("RUN005")
    groups = capture.where("scope <> ''").groupBy("capture", "scope", "operation", "fingerprint", "terminal").agg(F.count(F.lit(1)).alias("n"))
    return groups.where("n >= 2").withColumn("code", code)


def analyze(capture: DataFrame) -> DataFrame:
    """(code, scope, fingerprint, n): RUN001 incomplete metadata, RUN003 failed cost measurement, and `repeated`."""
    incomplete = capture.where("fingerprint is null or operation is null or terminal is null").groupBy("scope").agg(F.count(F.lit(1)).alias("n")).select(F.lit("RUN001").alias("code"), "scope", F.lit(None).cast("string").alias("fingerprint"), "n")
    failed = capture.where("cost is null and fingerprint is not null").groupBy("scope", "fingerprint").agg(F.count(F.lit(1)).alias("n")).select(F.lit("RUN003").alias("code"), "scope", "fingerprint", "n")
    return incomplete.union(failed).union(repeated(capture).select("code", "scope", "fingerprint", "n"))


def cost_baseline(capture: DataFrame) -> DataFrame:
    """(fingerprint, samples, mean, most, bound): bound is the larger of 1.30 mean and the maximum; 5 samples at least."""
    groups = capture.groupBy("fingerprint").agg(F.count("cost").alias("samples"), F.count(F.lit(1)).alias("n"), F.avg("cost").alias("mean"), F.max("cost").alias("most"))
    return groups.where((F.col("samples") >= LEAST) & (F.col("samples") == F.col("n"))).select("fingerprint", "samples", "mean", "most", F.greatest(F.col("mean") * FACTOR, "most").alias("bound"))


def compare_costs(baseline: DataFrame, capture: DataFrame) -> DataFrame:
    """(code, fingerprint, mean, bound): RU001 mean cost above the bound, RU002 in the baseline and without enough samples now."""
    now = cost_baseline(capture).select("fingerprint", F.col("mean").alias("now"))
    both = baseline.join(now, "fingerprint", "left")
    return both.where("now is null or now > bound").select(F.when(F.col("now").isNull(), "RU002").otherwise("RU001").alias("code"), "fingerprint", F.col("now").alias("mean"), "bound")


def workload(capture: DataFrame) -> DataFrame:
    """(capture, scope, cost, statements) of every scope."""
    return capture.where("scope <> ''").groupBy("capture", "scope").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("statements"))


def workload_baseline(capture: DataFrame) -> DataFrame:
    """(capture, scopes, cost_bound, statements_bound) over 5 scopes at least, by the same rule."""
    groups = workload(capture).groupBy("capture").agg(F.count(F.lit(1)).alias("scopes"), F.avg("cost").alias("c"), F.max("cost").alias("cm"), F.avg("statements").alias("s"), F.max("statements").alias("sm"))
    return groups.where(F.col("scopes") >= LEAST).select("capture", "scopes", F.greatest(F.col("c") * FACTOR, "cm").alias("cost_bound"), F.greatest(F.col("s") * FACTOR, "sm").alias("statements_bound"))


def compare_workloads(baseline: DataFrame, capture: DataFrame) -> DataFrame:
    """(code, capture, value, bound): RU003 mean cost a scope, RU004 mean statements a scope, above the bound."""
    now = workload(capture).groupBy("capture").agg(F.avg("cost").alias("cost"), F.avg("statements").alias("statements"))
    both = baseline.join(now, "capture")
    return both.where("cost > cost_bound").select(F.lit("RU003").alias("code"), "capture", F.col("cost").alias("value"), F.col("cost_bound").alias("bound")).union(both.where("statements > statements_bound").select(F.lit("RU004"), "capture", F.col("statements"), F.col("statements_bound")))


def slowest(capture: DataFrame, k: int = 10) -> DataFrame:
    """Each fingerprint's k slowest statements."""
    return capture.withColumn("rank", F.row_number().over(Window.partitionBy("fingerprint").orderBy(F.desc("seconds")))).where(F.col("rank") <= k)
