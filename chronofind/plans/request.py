"""Query request: JSON text to a typed object."""

from __future__ import annotations

import json
from dataclasses import dataclass

from chronofind.errors import QueryError
from chronofind.functions.timing import align
from chronofind.plans.filters import Filter, parse_filter

TIMESERIES, METRICS, TAG_KEYS, TAG_VALUES = "TIMESERIES", "METRICS", "TAG_KEYS", "TAG_KEYS_AND_VALUES"
KINDS = (TIMESERIES, METRICS, TAG_KEYS, TAG_VALUES)


@dataclass(frozen=True)
class Request:
    """start and end are aligned already; offset, to and limit are zero where not given."""

    kind: str
    start: int
    end: int
    group: tuple[str, ...]
    filter: Filter
    offset: int = 0
    to: int = 0
    limit: int = 0


def _integer(obj: dict, name: str) -> int:
    value = obj.get(name)
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise QueryError(f"{name!r} must be a whole number of at least 0")
    return value


def parse_request(text: str | dict) -> Request:
    """Raises QueryError for anything malformed or missing. order and namespace are ignored."""
    try:
        obj = json.loads(text) if isinstance(text, str) else text
    except json.JSONDecodeError as e:
        raise QueryError(f"not JSON: {e}") from e
    if not isinstance(obj, dict):
        raise QueryError("a request must be an object")
    kind = obj.get("type")
    if not isinstance(kind, str) or kind.upper() not in KINDS:
        raise QueryError(f"'type' must be one of {', '.join(KINDS)}")
    kind = kind.upper()
    group = obj.get("group")
    if not isinstance(group, list) or not all(isinstance(g, str) for g in group):
        raise QueryError("'group' must be a list of strings")
    if kind == TAG_VALUES and not group:
        raise QueryError(f"{TAG_VALUES} needs a tag key in 'group'")
    if "query" not in obj:
        raise QueryError("'query' is missing")
    paging = {}
    for name, field in (("from", "offset"), ("to", "to"), ("limit", "limit")):
        if name in obj or kind != TIMESERIES:
            paging[field] = _integer(obj, name)
    start, end = align(_integer(obj, "start"), _integer(obj, "end"))
    return Request(kind, start, end, tuple(group), parse_filter(obj["query"]), **paging)
