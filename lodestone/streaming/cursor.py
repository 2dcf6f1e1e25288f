"""Rows of a finite result, delivered one at a time."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

from ..errors import SelectError, require

if TYPE_CHECKING:
    from ..engine import Engine
    from ..plans.lower import Compiled
    from ..query import Query


def rows_of(compiled: Compiled, prefetch: bool = True) -> Iterator[list[Any]]:
    for row in compiled.frame.toLocalIterator(prefetchPartitions=prefetch):
        yield list(row)


class Stream:
    """An open stream: iterate it, ``fetch(n)`` rows, ``close`` it."""

    def __init__(self, compiled: Compiled, prefetch: bool = True):
        self.columns = list(compiled.names)
        self._rows: Iterator[list[Any]] | None = rows_of(compiled, prefetch)
        self.delivered = 0

    def __iter__(self) -> Stream:
        return self

    def __next__(self) -> list[Any]:
        require(self._rows is not None, "stream_closed", "nothing can be read after close")
        row = next(self._rows)
        self.delivered += 1
        return row

    def fetch(self, n: int) -> list[list[Any]]:
        require(isinstance(n, int) and n > 0, "invalid_query", "fetch size: a whole number from 1")
        out = []
        for row in self:
            out.append(row)
            if len(out) == n:
                break
        return out

    def close(self) -> None:
        self._rows = None

    def __enter__(self) -> Stream:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Bounded:
    """Runs queries under ceilings: rows, cells, bytes and seconds. A query past its
    deadline is cancelled by its job tag."""

    def __init__(self, engine: Engine, *, max_rows: int, max_cells: int | None = None, max_bytes: int | None = None, seconds: float | None = None):
        self.engine, self.max_rows = engine, max_rows
        self.max_cells = max_cells or engine.limits.get("max_total_cells")
        self.max_bytes = max_bytes or engine.limits.get("max_response_bytes")
        self.seconds = seconds

    def all(self, query: Query) -> dict[str, Any]:
        import threading

        compiled = self.engine.compile(query)
        tag = f"bounded-{id(compiled)}-{time.monotonic_ns()}"
        sc = self.engine.spark.sparkContext
        timer = threading.Timer(self.seconds, lambda: sc.cancelJobsWithTag(tag)) if self.seconds else None
        sc.addJobTag(tag)
        began = time.monotonic()
        try:
            if timer:
                timer.start()
            rows = [list(r) for r in compiled.frame.limit(self.max_rows + 1).collect()]
        except Exception as e:
            if self.seconds and time.monotonic() - began >= self.seconds:
                raise SelectError("deadline_exceeded", "the time allowed is over", {"seconds": self.seconds}) from e
            raise
        finally:
            if timer:
                timer.cancel()
            sc.removeJobTag(tag)
        require(len(rows) <= self.max_rows, "result_limit_exceeded", "more rows than are allowed", maximum=self.max_rows)
        require(len(rows) * len(compiled.names) <= self.max_cells, "result_limit_exceeded", "more cells than are allowed", maximum=self.max_cells)
        size = sum(len(str(v)) for r in rows for v in r)
        require(size <= self.max_bytes, "result_limit_exceeded", "more bytes than are allowed", maximum=self.max_bytes)
        return {"columns": list(compiled.names), "rows": rows}
