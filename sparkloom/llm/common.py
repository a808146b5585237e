"""What the operators share: tables, shared folders, checkpoints and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch. Texts may be long; a single one may exceed this and is never cut.
BATCH_BYTES = 8 << 20
#: Keys looked up by broadcast hold more than this part of all rows each (and this many rows), so there are fewer than HOT_PART of them.
HOT_PART, HOT_LEAST = 10_000, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a folder of the driver's own is made only if all runs in one process (tests);
    on a cluster executors couldn't see it, so that is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-checkpoint-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, kept in the shared folder, survives lost executors.

    A checkpoint keeps its plan's size estimate, and joins multiply estimates: after some rounds of an iteration they
    have millions of digits, which takes the driver longer than the rounds. So the rows get a plan without one.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more, instead of at its next collection."""
    gc.collect()
    spark._jvm.System.gc()
    give_back(spark)


def give_back(spark: SparkSession) -> None:
    """Returns what the driver's two processes have freed to the system.

    malloc keeps freed pages, in the JVM in an arena for each of up to eight threads a core: after some hundred jobs that is
    more than is in use. Where the C library or the JVM can't return them, nothing happens.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    with contextlib.suppress(Py4JError):
        jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
        # by the interface's method: the server's own class isn't exported
        kinds = new_array(jvm.java.lang.Class, 4)
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        for i, name in enumerate(names):
            kinds[i] = jvm.java.lang.Class.forName(name)
        values = new_array(jvm.java.lang.Object, 4)
        values[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        values[1] = "systemTrimNativeHeap"
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch takes in a Python worker, by bytes and not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def binary_list(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def text_list(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as str, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def id_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (long) and the text (string), so that other columns and their names don't matter."""
    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))


def held_out(key: Column) -> Column:
    """crc32 of the key as text has remainder 2 by 4; a null key isn't held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def look_up(rows: DataFrame, found: DataFrame, key: str | list[str], size: str = "n") -> DataFrame:
    """Inner join of rows with `found`, which has each key once and in `size` how many rows have it.

    One key may hold a third of all rows, and a shuffle would send those to one task. Keys that hold more
    than a ten-thousandth of all rows number fewer than ten thousand, so these are broadcast; only the
    others' rows are shuffled. Both sides are read twice: settle them first.
    """
    names = [key] if isinstance(key, str) else key
    total = found.agg(F.sum(size)).collect()[0][0] or 0
    often = F.col(size) > max(HOT_LEAST, total // HOT_PART)
    hot = found.where(often)
    if is_empty(hot):
        return rows.join(found, names)
    rest = rows.join(F.broadcast(hot.select(*names)), names, "left_anti").join(found.where(~often), names)
    # as many partitions as rows had: a union has those of both, and repeated look-ups would double them each time
    return rows.join(F.broadcast(hot), names).unionByName(rest).coalesce(rows._jdf.queryExecution().toRdd().getNumPartitions())


def first_texts(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, text) that share a doc_id the one with the smallest text, null as empty."""
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
