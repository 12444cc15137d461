"""The served query: a request's text in, a stream of messages out."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from chronofind.config import EngineConfig
from chronofind.metrics import NoopReporter, Reporter
from chronofind.operators import discovery, timeseries
from chronofind.plans.request import TIMESERIES, Request, parse_request
from chronofind.sources.store import SegmentStore


@dataclass
class Message:
    """rows: at most response_size of the answer; dictionary, in the last message only: the distinct strings
    of each shard's groups."""

    rows: list[Row]
    dictionary: dict[int, list[str]] | None = field(default=None)


def result(store: SegmentStore, request: Request, compat: bool = True, need_segments: bool = False) -> DataFrame:
    """The answer as a table: series (see timeseries.search) or terms (see discovery.discover)."""
    catalog = store.catalog(request.start, request.end)
    if request.kind != TIMESERIES:
        return discovery.discover(catalog, request, compat)
    return timeseries.search(catalog, request, compat, need_segments)


def answer(store: SegmentStore, text: str | dict, config: EngineConfig | None = None, reporter: Reporter | None = None) -> Iterator[Message]:
    """Messages of one request. Malformed requests and a range without any segment raise QueryError.

    Rows come one partition at a time, so the driver holds one message and the groups' distinct strings.
    """
    config, reporter = config or EngineConfig(), reporter or NoopReporter()
    began, n = time.monotonic(), 0
    request = parse_request(text)
    strings: dict[int, set[str]] = {}
    for rows in timeseries.chunks(result(store, request, need_segments=request.kind == TIMESERIES), config.response_size):
        n += len(rows)
        if request.kind == TIMESERIES:
            for row in rows:
                strings.setdefault(row.shard, set()).update(row.grp)
        yield Message(rows)
    yield Message([], {shard: sorted(values) for shard, values in strings.items()})
    reporter.gauge("query.latency", (time.monotonic() - began) * 1000, {"type": request.kind})
    reporter.count("query.rows", n, {"type": request.kind})
