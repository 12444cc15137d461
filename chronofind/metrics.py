"""Metrics sink: an interface for counters and gauges, and hooks that feed it from Spark."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming.listener import StreamingQueryListener


_LOG = logging.getLogger("chronofind.metrics")


class Reporter(Protocol):
    def count(self, metric: str, value: float, tags: dict[str, str]) -> None: ...

    def gauge(self, metric: str, value: float, tags: dict[str, str]) -> None: ...


class NoopReporter:
    def count(self, metric: str, value: float, tags: dict[str, str]) -> None:
        pass

    def gauge(self, metric: str, value: float, tags: dict[str, str]) -> None:
        pass


class MemoryReporter:
    """Keeps what it is told; for tests and notebooks."""

    def __init__(self) -> None:
        self.counts: dict[str, float] = {}
        self.gauges: dict[str, float] = {}

    def count(self, metric: str, value: float, tags: dict[str, str]) -> None:
        self.counts[metric] = self.counts.get(metric, 0) + value

    def gauge(self, metric: str, value: float, tags: dict[str, str]) -> None:
        self.gauges[metric] = value


class LogReporter:
    """Writes to Python's log."""

    def count(self, metric: str, value: float, tags: dict[str, str]) -> None:
        _LOG.info("count %s %s %s", metric, value, tags)

    def gauge(self, metric: str, value: float, tags: dict[str, str]) -> None:
        _LOG.info("gauge %s %s %s", metric, value, tags)


@contextmanager
def timed(reporter: Reporter, metric: str, **tags: str) -> Iterator[None]:
    """Gauge the milliseconds that the block takes, whether it succeeds or not."""
    began = time.monotonic()
    try:
        yield
    finally:
        reporter.gauge(metric, (time.monotonic() - began) * 1000, tags)


def observed(df: DataFrame, name: str, **columns: Column) -> tuple[DataFrame, Observation]:
    """df, and aggregates over it that are filled in by the action that runs it anyway."""
    observation = Observation(name)
    return df.observe(observation, *[c.alias(k) for k, c in columns.items()]), observation


def report(observation: Observation, reporter: Reporter, prefix: str, tags: dict[str, str] | None = None) -> None:
    """Send an observation's values as gauges; waits for its action."""
    for key, value in observation.get.items():
        if value is not None:
            reporter.gauge(f"{prefix}.{key}", value, tags or {})


class StreamReporter(StreamingQueryListener):
    """Reports rows and duration of every micro-batch."""

    def __init__(self, reporter: Reporter):
        self.reporter = reporter

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.reporter.count("stream.rows", p.numInputRows, {"query": str(p.name)})
        self.reporter.gauge("stream.batch.ms", p.batchDuration, {"query": str(p.name)})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
