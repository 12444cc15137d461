"""The series search: filter, time range, grouping by tag keys, epochs of every match."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofind.errors import QueryError
from chronofind.functions.matching import literal_pattern
from chronofind.functions.timing import alive
from chronofind.model import NO_DATA
from chronofind.operators.catalog import SEGMENT, Catalog
from chronofind.plans.filters import always_fails, required_keys, root_column
from chronofind.plans.pruning import prefix_filter
from chronofind.plans.request import Request

def _no_keys() -> Column:
    return F.array().cast(T.ArrayType(T.StringType()))


def _matching(pattern: str) -> Callable[[Column], Column]:
    return lambda k: k.rlike(pattern)


def _segment_facts(catalog: Catalog, request: Request, compat: bool, grouped: bool) -> DataFrame:
    """shard, segment and, if grouped, group_keys of the segments in range that can contribute.

    group_keys: the segment's tag keys that the group names resolve to, in order of the names, then of the
    keys. Only keys that a filter or a group name asks for are gathered, map-side first, so a segment
    with very many keys moves few of them.
    """
    segments = catalog.segments_in(request.start, request.end)
    needed = required_keys(request.filter) if compat else []
    names = [literal_pattern(name) for name in request.group] if grouped else []
    if not needed and not names:
        return segments.withColumn("group_keys", _no_keys()) if grouped else segments
    asked = reduce(or_, [F.col("tag_key").rlike(p) for p in names], F.col("tag_key").isin(needed) if needed else F.lit(False))
    keys = catalog.keys(segments, request.end).where(asked).groupBy(*SEGMENT).agg(F.collect_set("tag_key").alias("ks"))
    facts = segments.join(keys, SEGMENT, "left").withColumn("ks", F.coalesce("ks", _no_keys()))
    if needed:
        facts = facts.where(F.size(F.array_intersect("ks", F.array(*map(F.lit, needed)))) == len(needed))
    if not grouped:
        return facts.select(*SEGMENT)
    resolved = [F.array_sort(F.filter("ks", _matching(p))) for p in names]
    return facts.select(*SEGMENT, (F.concat(*resolved) if resolved else _no_keys()).alias("group_keys"))


def matching_rows(catalog: Catalog, request: Request, compat: bool = True, grouped: bool = False) -> DataFrame:
    """Series rows that satisfy the request, one for each segment in which they are stored; grouped adds
    the segment's group_keys.

    compat: a segment that lacks a tag key that some value filter names contributes nothing, wherever
    in the tree the filter stands. Without compat such a filter is merely false there. Series with
    null metric, tags or epochs match nothing that looks at them; series without epochs are never alive.
    """
    hit = root_column(request.filter, F.col("metric"), F.col("tags")) & alive(F.col("epochs"), request.start, request.end)
    if always_fails(request.filter):
        hit = F.lit(False)
    only = prefix_filter(F.col("metric_key"), request.filter) if catalog.prunable else None
    return catalog.matching(_segment_facts(catalog, request, compat, grouped), request.end, hit, only)


def group_vector(keys: Column, tags: Column) -> Column:
    return F.transform(keys, lambda k: F.coalesce(F.element_at(tags, k), F.lit(NO_DATA)))


def search(catalog: Catalog, request: Request, compat: bool = True, need_segments: bool = False) -> DataFrame:
    """shard INT, grp ARRAY<STRING>, series_id BIGINT, epochs ARRAY<BIGINT>: one row for each group
    vector and series of a shard, with all epochs of the matching segments, not clipped to the range.

    A group name that no key of a segment matches contributes no element there; a matched key that a
    series lacks contributes the no-data mark. An empty store gives no rows; with need_segments, a range
    without any visible segment raises QueryError.
    """
    if need_segments and catalog.segments_in(request.start, request.end).isEmpty():
        raise QueryError("no segment in this time range")
    rows = matching_rows(catalog, request, compat, bool(request.group))
    empty = _no_keys()
    grp = F.coalesce(group_vector(F.col("group_keys"), F.col("tags")), empty) if request.group else empty
    keyed = rows.select("shard", grp.alias("grp"), "series_id", "epochs")
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("epochs"))))
    return keyed.groupBy("shard", "grp", "series_id").agg(merged.alias("epochs"))


def summary(result: DataFrame) -> DataFrame:
    """Scalar form of a search: the group joined by '|', and number, first and last of the epochs."""
    return result.select(
        "shard", F.array_join("grp", "|").alias("grp"), "series_id", F.size("epochs").cast("bigint").alias("n_epochs"),
        F.array_min("epochs").alias("first_epoch"), F.array_max("epochs").alias("last_epoch"))


def group_dictionary(result: DataFrame) -> DataFrame:
    """shard, value: the distinct strings of a result's group vectors."""
    return result.select("shard", F.explode("grp").alias("value")).distinct()


def group_sizes(result: DataFrame) -> DataFrame:
    """grp (joined by '|'), n_series: distinct series of each group."""
    named = result.select(F.array_join("grp", "|").alias("grp"), "series_id")
    return named.groupBy("grp").agg(F.count_distinct("series_id").alias("n_series"))


def chunks(result: DataFrame, size: int) -> Iterator[list[Row]]:
    """The rows in lists of at most size, fetched one partition at a time."""
    if size <= 0:
        raise QueryError("a chunk holds at least one row")
    held: list[Row] = []
    for row in result.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
