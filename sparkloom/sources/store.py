"""Versioned Parquet tables with transactions over several of them.

A version of a table is a folder that is never changed. A commit is a numbered manifest that names the version of every
table; it is written aside and renamed to its number, which only one writer can do. So readers see a whole commit
or the one before, a transaction over several tables is one commit, and a writer that lost the race looks
again: if a table that it has read is no longer the one it read, it fails with Conflict and has changed nothing.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..errors import Conflict, SparkloomError
from ..plans.observe import observed

COMMITS = "_commits"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; without that, one of the driver's own if all runs in one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise SparkloomError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="sparkloom-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class VersionedStore:
    """Tables below `root`, on any file system Spark reaches whose renames are atomic."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def commit_number(self) -> int:
        """Number of the latest commit; 0 before the first."""
        fs, p = self._fs(f"{self.root}/{COMMITS}")
        if not fs.exists(p):
            return 0
        return max((int(n) for f in fs.listStatus(p) if (n := f.getPath().getName()).isdigit()), default=0)

    def versions(self, commit: int | None = None) -> dict[str, str]:
        """Version of every table in a commit, the latest by default."""
        commit = self.commit_number() if commit is None else commit
        if not commit:
            return {}
        fs, p = self._fs(f"{self.root}/{COMMITS}/{commit:012d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, number: int, versions: dict[str, str]) -> bool:
        """Whether this writer was the one that made commit `number`."""
        jvm, aside, to = self.spark._jvm, f"{self.root}/{COMMITS}/{uuid.uuid4().hex}.tmp", f"{self.root}/{COMMITS}/{number:012d}"
        fs, p = self._fs(aside)
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
        finally:
            stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(files.makeQualified(p), files.makeQualified(jvm.org.apache.hadoop.fs.Path(to)), none)
        except Py4JJavaError as e:
            fs.delete(p, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def _read(self, name: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def table(self, name: str) -> DataFrame:
        if (version := self.versions().get(name)) is None:
            raise LookupError(name)
        return self._read(name, version)

    def put(self, name: str, df: DataFrame) -> None:
        """Replaces a table whatever it was."""
        self.transaction(lambda t: t.put(name, df))

    def exec(self, mutation) -> int:
        """Applies a mutation of a model's table; the number of matched rows."""
        return self.transaction(lambda t: t.exec(mutation))

    def transaction(self, work: Callable[[Transaction], object]):
        """Commits all that `work` put, at once; an exception discards it. What `work` returns."""
        t = Transaction(self)
        try:
            result = work(t)
            t.commit()
        except BaseException:
            t.discard()
            raise
        return result


class Transaction:
    """Reads one commit and its own writes."""

    def __init__(self, store: VersionedStore) -> None:
        self.store, self.spark = store, store.spark
        self.number = store.commit_number()
        self.base, self.staged, self.seen = store.versions(self.number), {}, set()

    def table(self, name: str) -> DataFrame:
        if name in self.staged:
            return self.store._read(name, self.staged[name])
        self.seen.add(name)
        if name not in self.base:
            raise LookupError(name)
        return self.store._read(name, self.base[name])

    def put(self, name: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.store.root}/{name}/{version}")
        self.staged[name] = version

    def exec(self, mutation) -> int:
        def run() -> int:
            df = self.table(mutation.model.table)
            affected = mutation.affected(df)
            self.put(mutation.model.table, mutation.apply(df))
            return affected

        return observed("Exec", mutation, None, run)

    def commit(self) -> None:
        if not self.staged:
            return
        number, versions = self.number, self.base
        while not self.store.publish(number + 1, versions | self.staged):
            number = self.store.commit_number()
            versions = self.store.versions(number)
            if changed := [n for n in sorted(self.seen) if versions.get(n) != self.base.get(n)]:
                raise Conflict(f"{', '.join(changed)} changed since the transaction read it")

    def discard(self) -> None:
        for name, version in self.staged.items():
            fs, p = self.store._fs(f"{self.store.root}/{name}/{version}")
            fs.delete(p, True)
