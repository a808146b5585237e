"""Read policies: requests for how a query is read, scoped to one query."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import BuildError
from ..sources.tables import TableSource

ENGINES = ("", "row", "columnar")
MODES = ("", "auto", "enforce")


@dataclass(frozen=True)
class Policy:
    """`row` turns the vectorised reader off, `columnar` on; `auto` and `enforce` use adaptive execution. `index` is recorded and turns rewrites off."""

    engine: str = ""
    parallel: str = ""
    index: str = ""

    def validate(self) -> None:
        if self.engine not in ENGINES or self.parallel not in MODES:
            raise BuildError(f"unknown policy {self.engine!r} {self.parallel!r}")
        if self.engine == "row" and self.parallel == "enforce":
            raise BuildError("enforced parallel reading needs the columnar engine")
        if self.index and not re.match(r"[A-Za-z_]\w{0,63}\Z", self.index):
            raise BuildError(f"{self.index!r} isn't an index name")
        if self.index and self.engine == "columnar":
            raise BuildError("an index can't be forced on the columnar engine")

    def settings(self) -> dict[str, str]:
        found = {}
        if self.engine:
            found["spark.sql.parquet.enableVectorizedReader"] = str(self.engine == "columnar").lower()
        if self.parallel:
            found["spark.sql.adaptive.enabled"] = "true"
        return found

    def source(self, source: TableSource) -> TableSource:
        """The source in a session of its own with this policy's settings.

        Only a folder's tables, and tables that are derived by a function, can be read anew there. For a catalog or given
        DataFrames the policy would do nothing, which is an error."""
        if not self.settings():
            return source
        if not source.folder or any(isinstance(x, DataFrame) for x in source.derived.values()):
            raise BuildError("a read policy needs tables of a folder: it can't change how a catalog or a DataFrame is read")
        session = source.spark.newSession()
        # what the caller has set holds in the new session too
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
            session.conf.set(key, source.spark.conf.get(key))
        for key, value in self.settings().items():
            session.conf.set(key, value)
        return TableSource(session, source.folder, source.derived)
