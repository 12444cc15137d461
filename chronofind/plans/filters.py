"""Filter tree: JSON to nodes, nodes to one boolean Column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofind.errors import QueryError
from chronofind.functions import matching as m
from chronofind.model import TAGKEY_NAMESPACE

ANYTHING = ".*"


@dataclass(frozen=True)
class Metric:
    pattern: str


@dataclass(frozen=True)
class TagKey:
    pattern: str
    is_regex: bool


@dataclass(frozen=True)
class TagValue:
    key: str
    pattern: str
    is_regex: bool

    @property
    def needs_key(self) -> bool:
        return not (self.is_regex and self.pattern == ANYTHING)


@dataclass(frozen=True)
class Chain:
    op: str
    children: tuple[Filter, ...]


@dataclass(frozen=True)
class Not:
    child: Filter


@dataclass(frozen=True)
class ExplicitTags:
    child: Filter

    @property
    def count(self) -> int:
        return _tag_filters(self.child)


Filter = Metric | TagKey | TagValue | Chain | Not | ExplicitTags


def _tag_filters(node: Filter) -> int:
    """Tag filters reached through chains only."""
    if isinstance(node, TagKey | TagValue):
        return 1
    return sum(map(_tag_filters, node.children)) if isinstance(node, Chain) else 0


def _text(obj: dict, name: str) -> str:
    if not isinstance(value := obj.get(name), str):
        raise QueryError(f"filter {obj.get('type')!r} needs the string {name!r}")
    return value


def parse_filter(obj: object) -> Filter:
    """Read one filter object; its type is compared in lower case. Raises QueryError."""
    if not isinstance(obj, dict) or not isinstance(obj.get("type"), str):
        raise QueryError("a filter must be an object with a type")

    def inner() -> Filter:
        if "filter" not in obj:
            raise QueryError(f"filter {obj['type']!r} needs a nested filter")
        return parse_filter(obj["filter"])

    match obj["type"].lower():
        case "metricliteral":
            return Metric(_text(obj, "metric"))
        case "tagkeyliteralor":
            return TagKey(_text(obj, "filter"), False)
        case "tagkeyregex":
            return TagKey(_text(obj, "filter"), True)
        case "tagvalueliteralor" | "tagvalueregex" as kind:
            if not isinstance(obj.get("tagKey"), str):
                raise QueryError(f"filter {obj['type']!r} needs the string 'tagKey'")
            return TagValue(obj["tagKey"], _text(obj, "filter"), kind == "tagvalueregex")
        case "chain":
            if not isinstance(obj.get("filters"), list):
                raise QueryError("a chain needs the list 'filters'")
            op = obj.get("op")
            return Chain(op if isinstance(op, str) else "AND", tuple(map(parse_filter, obj["filters"])))
        case "not":
            return Not(inner())
        case "explicittags":
            return ExplicitTags(inner())
    raise QueryError(f"unknown filter type {obj['type']!r}")


def walk(node: Filter) -> Iterator[Filter]:
    yield node
    for child in node.children if isinstance(node, Chain) else [node.child] if isinstance(node, Not | ExplicitTags) else []:
        yield from walk(child)


def required_keys(node: Filter) -> list[str]:
    """Tag keys a segment must know for the tree to be evaluated there at all."""
    return sorted({n.key for n in walk(node) if isinstance(n, TagValue) and n.needs_key})


def always_fails(node: Filter) -> bool:
    """A chain with an unknown operation or a pattern that can't be compiled, in the sense of
    matching.compiles, fails in every segment, so the answer is empty."""
    for n in walk(node):
        if isinstance(n, Chain) and n.op not in ("AND", "OR"):
            return True
        if isinstance(n, Metric | TagKey | TagValue) and not m.compiles(n.pattern):
            return True
        if isinstance(n, TagValue) and not n.needs_key and not m.compiles(n.key):
            return True
    return False


def to_column(node: Filter, metric: Column, tags: Column) -> Column:
    """Compile to a predicate that is never null.

    NOT counts only as a direct child of AND, where it removes rows; elsewhere it stands for its
    child, and OR drops it. A chain without a positive child selects nothing.
    """
    if isinstance(node, Metric):
        return m.matches_literal(metric, node.pattern)
    if isinstance(node, TagKey):
        if node.is_regex:
            return m.any_key(tags, m.literal_pattern(TAGKEY_NAMESPACE) if node.pattern == ANYTHING else m.regex_pattern(node.pattern))
        return m.any_key(tags, m.literal_pattern(node.pattern))
    if isinstance(node, TagValue):
        if not node.needs_key:
            return m.any_key(tags, m.literal_pattern(node.key))
        value = tags[node.key]
        return (m.matches_regex if node.is_regex else m.matches_literal)(value, node.pattern)
    if isinstance(node, Not | ExplicitTags):
        return to_column(node.child, metric, tags)
    positive = [to_column(c, metric, tags) for c in node.children if not isinstance(c, Not)]
    if not positive or node.op not in ("AND", "OR"):
        return F.lit(False)
    if node.op == "OR":
        return reduce(or_, positive)
    removed = [to_column(c.child, metric, tags) for c in node.children if isinstance(c, Not)]
    kept = reduce(and_, positive)
    return kept & ~reduce(or_, removed) if removed else kept


def root_column(node: Filter, metric: Column, tags: Column) -> Column:
    """to_column, and the exact number of tags where the root asks for it."""
    column = to_column(node, metric, tags)
    if isinstance(node, ExplicitTags):
        column = column & (F.coalesce(F.size(tags), F.lit(0)) == node.count)
    return column
