"""A ledger session: one cached snapshot, overlays of unsaved texts, reload and subscriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ledgerlake.model import Ledger
from ledgerlake.sources.text import load_file


class Session:
    """Snapshots are made on demand and kept until a file's text is overlaid or ``reload`` is called."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.overlay: dict[str, str] = {}
        self._snapshot: Ledger | None = None
        self._listeners: list[Callable[[Ledger], None]] = []

    def snapshot(self) -> Ledger:
        if self._snapshot is None:
            fresh = load_file(self.spark, self.path, self.overlay)
            self._snapshot = Ledger(self.spark, fresh.entries.cache(), fresh.postings.cache(), fresh.options, fresh.diagnostics)
            for f in self._listeners:
                f(self._snapshot)
        return self._snapshot

    def set_overlay(self, path: str, text: str | None) -> None:
        """A file's unsaved text; None takes it back. Several changes before a snapshot cost one load."""
        if text is None:
            self.overlay.pop(path, None)
        else:
            self.overlay[path] = text
        self._drop()

    def reload(self) -> Ledger:
        self._drop()
        return self.snapshot()

    def subscribe(self, f: Callable[[Ledger], None]) -> Callable[[], None]:
        """``f`` gets every new snapshot; the result ends that."""
        self._listeners.append(f)
        return lambda: self._listeners.remove(f)

    def _drop(self) -> None:
        if self._snapshot is not None:
            self._snapshot.entries.unpersist()
            self._snapshot.postings.unpersist()
        self._snapshot = None


@contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[Callable[[], None]]:
    """Jobs inside belong to ``group``; the function given cancels them, from any thread."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield lambda: sc.cancelJobGroup(group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
