"""Upserting a stream into a versioned table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import Model
from ..operators.mutation import Upsert
from ..sources.store import VersionedStore


def upsert_stream(stream: DataFrame, model: Model, store: VersionedStore, checkpoint: str, latest_by: str, **trigger) -> StreamingQuery:
    """Writes every micro-batch by foreachBatch. Of rows with one key in a batch the one with the largest `latest_by` counts,
    and of those with equal ones the largest row.

    A batch that is delivered again after a failure gives the same state: an upsert is idempotent."""

    def write(batch: DataFrame, _: int) -> None:
        keys = [f.column for f in model.pk]
        names = [f.column for f in model.fields if not f.computed]
        newest = batch.groupBy(*keys).agg(F.max(F.struct(F.col(model.field(latest_by).column).alias("by"), F.struct(*names).alias("row"))).alias("last")).select("last.row.*")
        store.transaction(lambda t: t.put(model.table, Upsert(model, ()).merge(t.table(model.table), newest.select(*names))))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
