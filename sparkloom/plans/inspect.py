"""Plan inspection: estimated and measured operators, and rule diagnostics."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame

#: Fixed thresholds of the rules.
RATIO, RATIO_ROWS, SCAN_ROWS = 100, 1_000, 10_000


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    subject: str = ""
    severity: str = "warning"


@dataclass
class PlanNode:
    """One operator: its estimate (rows, if statistics have them; bytes) or what it did.

    A scan has what it reads, a path or a catalog's table. In a builder's plan it also has the table, the model and the path
    of the relation (empty for the root), where the query reads the table in one place only; else the latter two are unknown."""

    name: str
    detail: str
    estimated_rows: int | None = None
    estimated_bytes: int | None = None
    rows: int | None = None
    spilled: int = 0
    peak_memory: int = 0
    task: str = ""
    read: str = ""
    table: str = ""
    model: str = ""
    relation: str | None = None
    children: list[PlanNode] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    def summary(self) -> list[tuple[int, str, int | None, int | None]]:
        """(depth, operator, estimated rows, actual rows), parents first."""

        def lines(n: PlanNode, depth: int):
            yield depth, n.name, n.estimated_rows, n.rows
            for c in n.children:
                yield from lines(c, depth + 1)

        return list(lines(self, 0))


def _seq(found) -> list:
    return [found.apply(i) for i in range(found.size())]


def _read(plan) -> str:
    """The path or the catalog's table that a scan reads, or nothing."""
    try:
        paths = _seq(plan.relation().location().rootPaths())
        return str(paths[0].toString()) if paths else ""
    except (Py4JError, TypeError):
        return ""


def explain(df: DataFrame) -> PlanNode:
    """The optimised logical plan with its statistics; no job runs."""

    def node(plan) -> PlanNode:
        stats = plan.stats()
        rows = stats.rowCount()
        size = int(str(stats.sizeInBytes()))
        return PlanNode(plan.nodeName(), plan.simpleString(25), int(str(rows.get())) if rows.isDefined() else None, size, read=_read(plan) if plan.children().isEmpty() else "", children=[node(c) for c in _seq(plan.children())])

    return node(df._jdf.queryExecution().optimizedPlan())


def task_class(name: str, detail: str) -> str:
    """What kind of work an operator is: exchange, columnar scan, row scan, codegen or interpreted."""
    if "Exchange" in name or "Shuffle" in name or "Broadcast" in name and "Join" not in name:
        return "exchange"
    if "Scan" in name:
        return "columnar" if "Batched: true" in detail else "row"
    return "python" if re.search("Python|Pandas|Arrow", name) else "jvm"


@dataclass
class Analysis:
    """A measured run. `seconds` is wall time of the one execution."""

    root: PlanNode
    seconds: float
    result_rows: int
    policy: object = None

    def diagnostics(self) -> list[Diagnostic]:
        return diagnose(self.root, self.policy)


def explain_analyze(df: DataFrame, policy=None) -> Analysis:
    """Runs the query once, discarding its rows, and reads the final plan's metrics."""
    began = time.perf_counter()
    query = df._jdf.queryExecution()
    rows = query.toRdd().count()
    seconds = time.perf_counter() - began
    estimates = {n.name.lower(): n for n in explain(df).walk()}

    def node(plan) -> PlanNode:
        name = plan.nodeName()
        if name in ("AdaptiveSparkPlan", "WholeStageCodegen", "InputAdapter") or name.startswith("WholeStageCodegen"):
            inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.children().apply(0)
            return node(inner)
        if "QueryStage" in name:
            return node(plan.plan())
        metrics = plan.metrics()

        def of(key: str) -> int | None:
            found = metrics.get(key)
            return int(found.get().value()) if found.isDefined() else None

        detail = plan.simpleString(50)
        like = estimates.get(re.sub(r"(Exec| parquet.*)$", "", name).strip().lower())
        return PlanNode(name, detail, like.estimated_rows if like else None, None, of("numOutputRows"), of("spillSize") or 0, of("peakMemory") or 0, task_class(name, detail), _read(plan) if plan.children().isEmpty() else "", children=[node(c) for c in _seq(plan.children())])

    return Analysis(node(query.executedPlan()), seconds, int(rows), policy)


def diagnose(root: PlanNode, policy=None) -> list[Diagnostic]:
    """PLN001 no statistics, PLN002 estimate far off, PLN003 large full scan, PLN004 spill, PLN005/6 policy not observed."""
    found = []
    named = lambda n: f"{n.model or n.table} by {n.relation}" if n.relation else n.model or n.table or n.name
    scans = [n for n in root.walk() if "Scan" in n.name or n.name.startswith(("LogicalRelation", "Relation"))]
    for n in scans:
        if n.estimated_rows is None:
            found.append(Diagnostic("PLN001", "no row statistics: the estimate is from file sizes", named(n)))
        if n.rows is not None and n.rows >= SCAN_ROWS and not re.search(r"PushedFilters: \[[^\]]|PartitionFilters: \[[^\]]", n.detail):
            found.append(Diagnostic("PLN003", f"a full scan read {n.rows} rows", named(n)))
    for n in root.walk():
        if n.rows is not None and n.estimated_rows is not None and max(n.rows, n.estimated_rows) >= RATIO_ROWS:
            if max(n.rows, n.estimated_rows) >= RATIO * max(1, min(n.rows, n.estimated_rows)):
                found.append(Diagnostic("PLN002", f"estimated {n.estimated_rows} rows, saw {n.rows}", named(n)))
        if n.spilled > 0:
            found.append(Diagnostic("PLN004", f"spilled {n.spilled} bytes", named(n)))
    engine = getattr(policy, "engine", "")
    if engine and any(n.task in ("row", "columnar") and n.task != engine for n in scans):
        found.append(Diagnostic("PLN005", f"the {engine} engine was asked for and not used"))
    if getattr(policy, "parallel", "") == "enforce" and not any(n.task == "exchange" for n in root.walk()):
        found.append(Diagnostic("PLN006", "parallel execution was enforced and there is no exchange"))
    return found


class Inspect:
    """Plan terminals of a builder that has df(source) and policy."""

    def explain(self, source) -> PlanNode:
        return self._tagged(explain(self.df(source)))  # type: ignore[attr-defined]

    def explain_analyze(self, source) -> Analysis:
        run = explain_analyze(self.df(source), self.policy)  # type: ignore[attr-defined]
        self._tagged(run.root)
        return run

    def _tagged(self, root: PlanNode) -> PlanNode:
        from .places import tag

        return tag(root, self)
