"""Terms behind a filter, and term listings by segment. Null terms are never listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofind.errors import QueryError
from chronofind.operators.catalog import SEGMENT, Catalog
from chronofind.operators.timeseries import matching_rows
from chronofind.plans.request import METRICS, TAG_KEYS, TAG_VALUES, Request


def _terms(request: Request) -> Column:
    if request.kind == METRICS:
        return F.array("metric")
    if request.kind == TAG_KEYS:
        return F.map_keys("tags")
    if request.kind == TAG_VALUES:
        return F.array(F.col("tags")[request.group[0]])
    raise QueryError(f"{request.kind} isn't a term search")


def _found(catalog: Catalog, request: Request, compat: bool) -> DataFrame:
    rows = matching_rows(catalog, request, compat)
    return rows.select("series_id", F.explode(_terms(request)).alias("term")).where(F.col("term").isNotNull())


def discover(catalog: Catalog, request: Request, compat: bool = True) -> DataFrame:
    """term: distinct terms with at least one matching series. A limit above 0 keeps the first terms in
    byte order."""
    terms = _found(catalog, request, compat).select("term").distinct()
    return terms.orderBy("term").limit(request.limit) if request.limit else terms


def cardinality(catalog: Catalog, request: Request, compat: bool = True) -> DataFrame:
    """term, n: the number of matching series that hold each term."""
    return _found(catalog, request, compat).groupBy("term").agg(F.count_distinct("series_id").alias("n"))


def _listing(catalog: Catalog, terms: Column) -> DataFrame:
    rows = catalog.scan(catalog.visible.select(*SEGMENT))
    return rows.select(*SEGMENT, F.explode(terms).alias("term")).where(F.col("term").isNotNull()).distinct()


def all_metrics(catalog: Catalog) -> DataFrame:
    """shard, segment, term."""
    return _listing(catalog, F.array("metric"))


def all_tag_keys(catalog: Catalog) -> DataFrame:
    return _listing(catalog, F.map_keys("tags"))


def all_tag_values(catalog: Catalog, key: str) -> DataFrame:
    return _listing(catalog, F.array(F.col("tags")[key]))
