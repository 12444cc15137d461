"""Shard routing."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def shard_of(series_id: Column, num_shards: int | Column) -> Column:
    """abs(id % n), the remainder taking the dividend's sign; null for a null id."""
    n = F.lit(num_shards) if isinstance(num_shards, int) else num_shards
    return F.abs(series_id % n.cast("bigint")).cast("int")


def assigned(shard: Column, containers: int, container: int) -> Column:
    """Whether a shard belongs to the given one of several containers."""
    return shard % containers == container
