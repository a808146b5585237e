"""Ordered SQL files, applied once each to a catalog that takes them, and the record of what is applied."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import Conflict, SparkloomError
from ..plans.inspect import Diagnostic
from ..sources.store import VersionedStore

FILE = re.compile(r"(\d{4,})_([a-z0-9_]+)\.(up|down)\.sql\Z")
BOUNDARY = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|;|[^-/'\"`;]+|.", re.S)


def statements(text: str) -> list[str]:
    """Splits at semicolons outside strings, names and comments; comments go."""
    out, part = [], ""
    for t in BOUNDARY.findall(text):
        if t == ";":
            out.append(part.strip())
            part = ""
        elif not t.startswith(("--", "/*")):
            part += t
    return [x for x in [*out, part.strip()] if x]


@dataclass(frozen=True)
class Migration:
    version: int
    name: str
    up: str
    down: str

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.up.encode()).hexdigest()


def load(folder: str | Path) -> list[Migration]:
    """Migrations by version; both directions must be there, and versions can't repeat."""
    found: dict[tuple[int, str], dict[str, str]] = {}
    for p in sorted(Path(folder).glob("*.sql")):
        m = FILE.match(p.name)
        if not m:
            raise SparkloomError(f"{p.name} isn't <version>_<name>.up.sql or .down.sql")
        found.setdefault((int(m[1]), m[2]), {})[m[3]] = p.read_text()
    versions = [v for v, _ in found]
    if len(set(versions)) < len(versions):
        raise SparkloomError("a version is used twice")
    for (v, n), both in found.items():
        if set(both) != {"up", "down"}:
            raise SparkloomError(f"{v}_{n} needs an up and a down file")
    return [Migration(v, n, both["up"], both["down"]) for (v, n), both in sorted(found.items())]


def plan(migrations: list[Migration], applied: dict[int, str]) -> list[Migration]:
    """What is still to apply. An applied file that changed, or a gap below an applied one, is an error."""
    for m in migrations:
        if m.version in applied and applied[m.version] != m.digest:
            raise SparkloomError(f"{m.version}_{m.name} changed after it was applied")
    todo = [m for m in migrations if m.version not in applied]
    if applied and any(m.version < max(applied) for m in todo):
        raise SparkloomError("a migration below the latest applied one isn't applied")
    return todo


def apply(spark: SparkSession, migrations: list[Migration], applied: dict[int, str]) -> dict[int, str]:
    """Runs what is left and returns the new record of applied versions, also after a failure's predecessors."""
    done = dict(applied)
    for m in plan(migrations, applied):
        for s in statements(m.up):
            spark.sql(s)
        done[m.version] = m.digest
    return done


#: What a recorded digest stands behind while its migration runs.
MARKS = {"up": "running up ", "down": "running down "}
LOSSY = re.compile(r"\s*(?:DROP\s+(?:TABLE|DATABASE|SCHEMA|COLUMN)|TRUNCATE\b|ALTER\s+TABLE\s.*\bDROP\s+COLUMNS?\b|DELETE\s+FROM\s+\S+\s*\Z)", re.I | re.S)


def lint(migrations: list[Migration]) -> list[Diagnostic]:
    """MIG101 nothing to run, MIG102 rows or columns are lost on the way up, MIG103 no way down, MIG104 a gap in the versions."""
    found = []
    for before, m in zip([None, *migrations], migrations, strict=False):
        subject, up = f"{m.version}_{m.name}", statements(m.up)
        if not up:
            found.append(Diagnostic("MIG101", "the up file has no statement", subject, "error"))
        found += [Diagnostic("MIG102", f"data is lost: {s.split(chr(10))[0][:80]}", subject) for s in up if LOSSY.match(s)]
        if not statements(m.down):
            found.append(Diagnostic("MIG103", "the down file has no statement", subject))
        if before and m.version != before.version + 1:
            found.append(Diagnostic("MIG104", f"version {before.version + 1} is left out", subject))
    return found


class Runner:
    """Migrations of a folder against a record that all runners share.

    The record is the commits of a VersionedStore, one before and one after each migration. Only one runner can make
    a commit, so none runs what another does; a mark that stays is a migration that stopped half-way, and
    nothing runs until `resolve` tells how it ended.
    """

    def __init__(self, spark: SparkSession, folder: str | Path, record: str) -> None:
        self.spark, self.migrations, self.store = spark, load(folder), VersionedStore(spark, record)

    @classmethod
    def of(cls, spark: SparkSession, migrations: list[Migration], record: str) -> Runner:
        """A runner of migrations that are at hand."""
        made = cls.__new__(cls)
        made.spark, made.migrations, made.store = spark, migrations, VersionedStore(spark, record)
        return made

    def _record(self) -> tuple[int, dict[str, str]]:
        number = self.store.commit_number()
        return number, dict(self.store.versions(number))

    def _advance(self, number: int, record: dict[str, str]) -> int:
        if not self.store.publish(number + 1, record):
            raise Conflict("another runner has changed the record")
        return number + 1

    def _settled(self) -> tuple[int, dict[int, str]]:
        """Number of the last commit and digests by version; an error while a migration is marked."""
        number, record = self._record()
        for v, digest in record.items():
            if digest.startswith(tuple(MARKS.values())):
                raise SparkloomError(f"{v} is {digest.rsplit(' ', 1)[0]}: wait for its runner, or resolve it if that has failed")
        return number, {int(v): d for v, d in record.items()}

    def status(self) -> list[tuple[int, str, str]]:
        """(version, name, state): applied, pending, changed since, running up, running down, or file missing."""
        _, record = self._record()
        names = {m.version: m for m in self.migrations}
        out = []
        for v in sorted({*names, *map(int, record)}):
            m, digest = names.get(v), record.get(str(v))
            if digest is None:
                state = "pending"
            elif digest.startswith(tuple(MARKS.values())):
                state = digest.rsplit(" ", 1)[0]
            else:
                state = "file missing" if m is None else "applied" if m.digest == digest else "changed"
            out.append((v, m.name if m else "", state))
        return out

    def _run(self, number: int, applied: dict[int, str], m: Migration, direction: str) -> tuple[int, dict[int, str]]:
        number = self._advance(number, {str(v): d for v, d in applied.items()} | {str(m.version): MARKS[direction] + m.digest})
        for s in statements(m.up if direction == "up" else m.down):
            self.spark.sql(s)
        after = {v: d for v, d in applied.items() if v != m.version} | ({m.version: m.digest} if direction == "up" else {})
        return self._advance(number, {str(v): d for v, d in after.items()}), after

    def up(self, to: int | None = None) -> list[int]:
        """Applies what is pending, up to a version; the versions applied."""
        number, applied = self._settled()
        todo = [m for m in plan(self.migrations, applied) if to is None or m.version <= to]
        for m in todo:
            number, applied = self._run(number, applied, m, "up")
        return [m.version for m in todo]

    def down(self, steps: int = 1) -> list[int]:
        """Takes back the latest applied migrations; their files must be as they were applied."""
        number, applied = self._settled()
        plan(self.migrations, applied)
        names, done = {m.version: m for m in self.migrations}, []
        for v in sorted(applied, reverse=True)[:steps]:
            if v not in names:
                raise SparkloomError(f"the files of {v} are missing")
            number, applied = self._run(number, applied, names[v], "down")
            done.append(v)
        return done

    def baseline(self, version: int) -> list[int]:
        """Records the migrations up to a version as applied without running them; only on an empty record."""
        number, applied = self._settled()
        if applied:
            raise SparkloomError("the record isn't empty")
        taken = [m for m in self.migrations if m.version <= version]
        if not taken or taken[-1].version != version:
            raise SparkloomError(f"there is no version {version}")
        self._advance(number, {str(m.version): m.digest for m in taken})
        return [m.version for m in taken]

    def resolve(self, version: int, applied: bool) -> None:
        """Says of a marked migration whether it is applied."""
        number, record = self._record()
        digest = record.pop(str(version), "")
        if not digest.startswith(tuple(MARKS.values())):
            raise SparkloomError(f"{version} isn't marked")
        self._advance(number, record | ({str(version): digest.rsplit(" ", 1)[1]} if applied else {}))
