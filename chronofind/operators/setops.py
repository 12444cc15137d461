"""Set algebra on series keys (shard, segment, series_id)."""

from pyspark.sql import DataFrame

KEY = ["shard", "segment", "series_id"]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    """Null keys count as equal to each other."""
    return a.select(*KEY).subtract(b.select(*KEY))
