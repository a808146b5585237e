"""Compares one aggregate under several read policies: equal results first, then times."""

from __future__ import annotations

import json
import math
import statistics
import time
from dataclasses import dataclass, field, replace

from ..errors import BuildError
from ..operators.aggregate import Aggregate
from ..sources.tables import TableSource
from .inspect import Analysis, explain_analyze
from .policy import Policy
from .shape import fingerprint, query_shape

#: Fixed defaults.
WARMUPS, SAMPLES, MOST_SAMPLES, MOST_ROWS = 2, 5, 1000, 100_000
POLICIES = {"auto": Policy(), "row": Policy(engine="row"), "columnar": Policy(engine="columnar", parallel="enforce")}


@dataclass
class Variant:
    name: str
    seconds: list[float] = field(default_factory=list)
    equal: bool = True
    plan: Analysis | None = None

    @property
    def mean(self) -> float:
        return statistics.fmean(self.seconds)


@dataclass
class Comparison:
    query: Aggregate
    rows: int
    variants: list[Variant]

    @property
    def status(self) -> str:
        """different, or the fastest policy's name."""
        return "different" if not all(v.equal for v in self.variants) else min(self.variants, key=lambda v: v.mean).name

    def write_capture(self, path: str, variant: str, capture: str = "comparison") -> None:
        """One variant's samples as JSON lines."""
        found = next(v for v in self.variants if v.name == variant)
        shape = query_shape(self.query)
        with open(path, "w") as out:
            for i, s in enumerate(found.seconds):
                out.write(json.dumps({"capture": capture, "scope": str(i), "terminal": "ScanAll", "operation": shape["operation"], "model": shape["model"], "fingerprint": fingerprint(shape), "shape": shape, "cost": s, "seconds": s, "rows": self.rows, "error": ""}) + "\n")


def same_value(a, b, relative: float, absolute: float) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=relative, abs_tol=absolute)
    return a == b


def same_rows(a: list, b: list, relative: float = 0.0, absolute: float = 0.0) -> bool:
    return len(a) == len(b) and all(len(x) == len(y) and all(same_value(p, q, relative, absolute) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def compare(query: Aggregate, source: TableSource, *, warmups: int = WARMUPS, samples: int = SAMPLES, most_rows: int = MOST_ROWS, relative: float = 0.0, absolute: float = 0.0, plans: bool = True, policies: dict[str, Policy] | None = None) -> Comparison:
    """Every run must equal the first warmup in rows and order. Policies take turns in a rotating order."""
    if not SAMPLES <= samples <= MOST_SAMPLES or warmups < 1:
        raise BuildError(f"samples must be {SAMPLES} to {MOST_SAMPLES}, with a warmup")
    if query.grouped and not query.orders:
        raise BuildError("a grouped query needs OrderBy to be compared")
    policies = policies or POLICIES
    names, variants = list(policies), {n: Variant(n) for n in policies}
    expected: list | None = None

    def run(name: str) -> float:
        nonlocal expected
        began = time.perf_counter()
        rows = replace(query, policy=policies[name]).df(source).limit(most_rows + 1).collect()
        seconds = time.perf_counter() - began
        if len(rows) > most_rows:
            raise BuildError(f"the result has more than {most_rows} rows")
        if expected is None:
            expected = rows
        variants[name].equal &= same_rows(expected, rows, relative, absolute)
        return seconds

    for turn in range(warmups + samples):
        for i in range(len(names)):
            name = names[(i + turn) % len(names)]
            seconds = run(name)
            if turn >= warmups:
                variants[name].seconds.append(seconds)
    for n in names if plans else ():
        q = replace(query, policy=policies[n])
        variants[n].plan = explain_analyze(q.df(source), policies[n])
    return Comparison(query, len(expected or []), list(variants.values()))
