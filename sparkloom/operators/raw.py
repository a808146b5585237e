"""Typed raw SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from ..errors import BuildError
from .model import Model


@dataclass(frozen=True)
class Raw:
    """Caller SQL whose columns must be the model's, computed ones too; they come back by field name."""

    model: Model
    sql: str
    args: tuple = ()

    def df(self, spark: SparkSession) -> DataFrame:
        found = spark.sql(self.sql, args=list(self.args) or None)
        known = {f.column.lower(): f.name for f in self.model.fields}
        names = [c.lower() for c in found.columns]
        if len(set(names)) < len(names):
            raise BuildError("the SQL returns a column twice")
        if unknown := [c for c in found.columns if c.lower() not in known]:
            raise BuildError(f"{self.model.name} has no columns {unknown}")
        return found.toDF(*[known[n] for n in names])

    def all(self, spark: SparkSession) -> list[Row]:
        return self.df(spark).collect()


def raw_exec(spark: SparkSession, sql: str, *args) -> DataFrame:
    """Caller mutation SQL on a catalog that allows it."""
    return spark.sql(sql, args=list(args) or None)
