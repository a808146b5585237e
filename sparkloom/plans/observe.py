"""Completed-statement events: a synchronous callback around terminals."""

from __future__ import annotations

import contextvars
import logging
import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from ..sources.tables import TableSource


@dataclass(frozen=True)
class Event:
    """What ran. Values of predicates are left out unless the observer asks for them."""

    terminal: str
    operation: str
    model: str
    fingerprint: str
    shape: dict
    seconds: float
    rows: int | None
    error: str
    arguments: tuple = ()


_observers: contextvars.ContextVar[tuple[tuple[Callable[[Event], None], bool], ...]] = contextvars.ContextVar("observers", default=())
#: Names of secrets, alone or after other words, and what stands for a secret.
LAST_WORDS = ("password", "passwd", "pwd", "token", "secret", "dsn")
WHOLE_NAMES = ("credential", "api[_-]?key", "access[_-]?key", "private[_-]?key")
REPLACEMENT = "[REDACTED]"
NAME = rf"(?:(?:[a-z0-9]+[_-])*(?:{'|'.join(LAST_WORDS)})|{'|'.join(WHOLE_NAMES)})"
URL = re.compile(r"(\w[\w+.-]*://[^:/@\s]+:)[^@\s/]+(?=@)")
ASSIGNED = re.compile(rf"""(?i)(["']?{NAME}["']?\s*[:=]\s*)(?:(")(?:\\.|[^"\\])*"|(')(?:\\.|[^'\\])*'|[^"',;}}\s&]+)""")


def redact(text: str, *secrets: str) -> str:
    """Passwords in URLs, values of names that stand for secrets, and the given secrets, replaced."""
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        text = text.replace(s, REPLACEMENT)
    text = URL.sub(lambda m: m[1] + REPLACEMENT, text)
    return ASSIGNED.sub(lambda m: f"{m[1]}{(q := m[2] or m[3] or '')}{REPLACEMENT}{q}", text)


class RedactingFilter(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = redact(record.getMessage()), ()
        return True


@contextmanager
def observing(callback: Callable[[Event], None], include_arguments: bool = False) -> Iterator[None]:
    mark = _observers.set((*_observers.get(), (callback, include_arguments)))
    try:
        yield
    finally:
        _observers.reset(mark)


def observed(terminal: str, query, source: TableSource | None, run: Callable):
    """Runs a terminal and tells the observers, also of failures."""
    if not _observers.get():
        return run()
    from .shape import arguments, fingerprint, query_shape

    began, error, result = time.perf_counter(), "", None
    try:
        result = run()
        return result
    except Exception as e:
        error = redact(f"{type(e).__name__}: {e}"[:500])
        raise
    finally:
        shape = query_shape(query)
        rows = len(result) if isinstance(result, list) else result if terminal == "Exec" else None
        for callback, include in _observers.get():
            callback(Event(terminal, shape["operation"], shape["model"], fingerprint(shape), shape, time.perf_counter() - began, rows, error, arguments(query) if include else ()))


def statement_logger(logger: logging.Logger) -> Callable[[Event], None]:
    """One escaped line an event."""

    def log(e: Event) -> None:
        line = f"{e.terminal} {e.model} {e.fingerprint} {e.seconds * 1000:.3f} ms rows={e.rows}" + (f" error={e.error}" if e.error else "")
        logger.log(logging.ERROR if e.error else logging.INFO, line.encode("unicode_escape").decode())

    return log
