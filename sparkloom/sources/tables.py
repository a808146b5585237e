"""Where tables come from: a folder of Parquet tables, a catalog, or named DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Stored bytes of tables whose rows make up a task's share, and the most shares.
SHARE_BYTES, MOST_SHARES = 8 << 20, 20_000


def shares(*tables: DataFrame) -> int | None:
    """Into how many partitions the tables' rows are dealt by key, so that a task's share doesn't grow with them; None where Spark doesn't know a size.

    A session's number of shuffle partitions is fixed, and partitions are coalesced by their compressed bytes, of which keys take few."""
    spark, size = tables[0].sparkSession, 0
    unknown = spark._jsparkSession.sessionState().conf().defaultSizeInBytes()
    for t in tables:
        leaves = t._jdf.queryExecution().optimizedPlan().collectLeaves()
        for i in range(leaves.size()):
            found = int(str(leaves.apply(i).stats().sizeInBytes()))
            if found >= unknown:
                return None
            size += found
    return min(max(spark.sparkContext.defaultParallelism, -(-size // SHARE_BYTES)), MOST_SHARES)


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    return df.repartition(n, *keys) if n else df


@dataclass(frozen=True)
class TableSource:
    """`derived` names tables made from others; it is looked up before the folder or the catalog."""

    spark: SparkSession
    folder: str | None = None
    derived: Mapping[str, DataFrame | Callable[[TableSource], DataFrame]] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name in self.derived:
            found = self.derived[name]
            return found if isinstance(found, DataFrame) else found(self)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet") if self.folder else self.spark.table(name)

    def with_tables(self, **tables) -> TableSource:
        return TableSource(self.spark, self.folder, {**self.derived, **tables})
