"""State of scans and reconciliations, and how far a scan is."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import commit
from weftgraph.plans.adapter import Graph


@dataclass
class ScanState:
    """NotStarted, Scanning, Ready or Error. Each scan has a number; an error stays until the next one begins."""

    state: str = "NotStarted"
    operation: int = 0
    error: str | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def begin(self) -> int | None:
        """The new scan's number, None while one is running."""
        with self._lock:
            if self.state == "Scanning":
                return None
            self.state, self.error, self.operation = "Scanning", None, self.operation + 1
            return self.operation

    def complete(self) -> None:
        with self._lock:
            if self.state == "Scanning":
                self.state = "Ready"

    def fail(self, error: str) -> None:
        with self._lock:
            self.state, self.error = "Error", error


class Reconciliation:
    """Several commits and a prune, staged on a graph and published as one version, or dropped as one."""

    _open: set[int] = set()

    def __init__(self, graph: Graph, publish: Callable[[Graph], int]) -> None:
        self.before, self.graph, self._publish = graph, graph, publish
        self._done: dict[tuple[str, str], int] = {}

    def __enter__(self) -> Reconciliation:
        if id(self._publish) in self._open:
            raise RuntimeError("a reconciliation is open already")
        self._open.add(id(self._publish))
        return self

    def __exit__(self, kind, error, trace) -> None:
        self._open.discard(id(self._publish))
        if kind is not None:
            self.graph = self.before

    def commit(self, delta: Graph, parser: str, workspace: str, generation: int, files: list[str] | None = None) -> bool:
        """False, and nothing done, for a generation that isn't newer than the shard's last."""
        if generation <= self._done.get((parser, workspace), -1):
            return False
        self.graph = commit.commit_scoped(self.graph, delta, parser, workspace, files)
        self._done[parser, workspace] = generation
        return True

    def prune(self, keep: DataFrame) -> None:
        self.graph = commit.prune_files(self.graph, keep)

    def publish(self) -> int:
        return self._publish(self.graph)


def progress(processed: int, total: int, last: int = -1) -> int | None:
    """The count to report, about a hundred in all and the last one always; None for no report. It never goes back."""
    step = max(1, -(-total // 100))
    return processed if processed > last and (processed >= total or processed % step == 0) else None


def api_metrics(calls: DataFrame) -> DataFrame:
    """(endpoint, calls, total, mean) of calls (endpoint, latency)."""
    return calls.groupBy("endpoint").agg(F.count("*").alias("calls"), F.sum("latency").alias("total"), F.avg("latency").alias("mean"))
