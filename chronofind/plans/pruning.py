"""Lossless pre-filters that Parquet can use: prefixes that a metric must begin with."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofind.plans.filters import Chain, ExplicitTags, Filter, Metric, Not

_PLAIN = re.compile(r"[A-Za-z0-9_:/ -]*")


def metric_key(metric: Column) -> Column:
    """The metric as prefixes are compared: in lower case, with the long s, which folds to s, replaced."""
    return F.translate(F.lower(metric), "ſ", "s")


def _prefixes(pattern: str) -> list[str] | None:
    """Prefixes of which every match has one, None if there is no telling. Only plain ASCII counts."""
    if re.search(r"[()\[\]\\{}]", pattern):
        return None
    out = []
    for alternative in pattern.split("|"):
        plain = _PLAIN.match(alternative)[0]
        if alternative[len(plain) : len(plain) + 1] in ("?", "*", "+"):
            plain = plain[:-1]
        if not plain:
            return None
        out.append(plain.lower())
    return sorted(set(out))


def metric_prefixes(node: Filter) -> list[str] | None:
    """Prefixes for rows that can satisfy the tree: from metric filters that all matches must pass."""
    if isinstance(node, Metric):
        return _prefixes(node.pattern)
    if isinstance(node, ExplicitTags | Not):
        return metric_prefixes(node.child)
    if isinstance(node, Chain):
        own = [metric_prefixes(c) for c in node.children if not isinstance(c, Not)]
        if node.op == "AND":
            return min((p for p in own if p is not None), key=len, default=None)
        if node.op == "OR" and own and all(p is not None for p in own):
            return sorted({x for p in own for x in p})
    return None


def prefix_filter(column: Column, node: Filter, most: int = 50) -> Column | None:
    """A predicate on metric_key that is pushed to the scan, or None."""
    prefixes = metric_prefixes(node)
    if not prefixes or len(prefixes) > most:
        return None
    return reduce(or_, [column.startswith(p) for p in prefixes])
