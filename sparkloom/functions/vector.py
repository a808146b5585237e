"""Vector values and distances."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BuildError
from ..operators.model import MOST_DIMENSIONS

METRICS = ("l2", "cosine")
#: Dimensions up to which a distance is written out; beyond, an aggregate over the array.
UNROLLED = 128


class Vector(tuple):
    """An owned finite list of float32 values; NULL is None, which isn't the empty vector."""

    def __new__(cls, values: Sequence[float] = ()) -> Vector:
        if len(values) > MOST_DIMENSIONS:
            raise BuildError(f"a vector has at most {MOST_DIMENSIONS} dimensions")
        rounded = [float(np.float32(_number(v))) for v in values]
        if not all(map(math.isfinite, rounded)):
            raise BuildError("a vector's values must be finite")
        return super().__new__(cls, rounded)

    @classmethod
    def parse(cls, text: str) -> Vector:
        found = json.loads(text)
        if not isinstance(found, list):
            raise BuildError("a vector is a JSON list of numbers")
        return cls(found)

    def format(self) -> str:
        return "[" + ",".join(f"{np.float32(v)}" for v in self) + "]"


def _number(v) -> float:
    if v is None or isinstance(v, (bool, str)):
        raise BuildError(f"{v!r} isn't a vector's value")
    return v


def distance(column: Column, to: Vector, metric: str) -> Column:
    """Distance of an array column from a literal vector in double precision; NULL for NULL and for other dimensions."""
    if metric not in METRICS:
        raise BuildError(f"unknown metric {metric!r}")
    if len(to) <= UNROLLED:  # sums of products stay in generated code
        at = [F.get(column, F.lit(i)).cast("double") for i in range(len(to))]
        sum_ = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0.0))
        if metric == "l2":
            out = F.sqrt(sum_([(a - F.lit(float(x))) * (a - F.lit(float(x))) for a, x in zip(at, to, strict=True)]))
        else:
            norm = F.sqrt(sum_([a * a for a in at])) * F.lit(math.sqrt(sum(x * x for x in to)))
            out = F.when(norm > 0, 1 - sum_([a * F.lit(float(x)) for a, x in zip(at, to, strict=True)]) / norm)
        return F.when(F.size(column) == len(to), out)
    v, q = column.cast("array<double>"), F.array(*[F.lit(float(x)) for x in to])
    add = lambda a, b: a + b
    zero = F.lit(0.0)
    if metric == "l2":
        out = F.sqrt(F.aggregate(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)), zero, add))
    else:
        dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), zero, add)
        norm = F.sqrt(F.aggregate(F.transform(v, lambda a: a * a), zero, add)) * F.lit(math.sqrt(sum(x * x for x in to)))
        out = F.when(norm > 0, 1 - dot / norm)
    return F.when(F.size(v) == len(to), out)
