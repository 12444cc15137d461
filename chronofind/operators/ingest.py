"""Write path: route, bucket and de-duplicate records into segment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofind.functions.routing import shard_of
from chronofind.functions.timing import epoch_bucket, floor_to

KEY = ["shard", "segment", "series_id"]


def route(records: DataFrame, num_shards: int) -> DataFrame:
    """Adds shard. Null ids get shard null and are dropped by build_segments."""
    return records.withColumn("shard", shard_of(F.col("series_id"), num_shards))


def build_segments(records: DataFrame, num_shards: int, full_duration: int = 86400, order: Column | None = None) -> DataFrame:
    """records: metric, tags, series_id, batch (epoch seconds of the batch). Gives model.SERIES.

    Of a series repeated within a segment, metric and tags of the smallest order (default: batch; ties by
    metric and tags, null metrics last, so that reruns agree) win, and each repeat only adds its epoch.
    Rows with null series_id or batch are dropped; null metric or tags are kept. The aggregate runs
    map-side first, so a series that holds most of the rows reaches its reducer as one row a task.
    """
    rows = route(records, num_shards).where(F.col("series_id").isNotNull() & F.col("batch").isNotNull())
    segment = floor_to(F.col("batch"), full_duration)
    # The smallest of (order, metric, tags) holds what is kept, so nothing moves twice.
    first = F.struct((order if order is not None else F.col("batch")).alias("o"), F.col("metric").isNull(), "metric", F.map_entries("tags").alias("entries"))
    rows = rows.select("shard", segment.alias("segment"), "series_id", epoch_bucket(F.col("batch"), segment).alias("epoch"), first.alias("first"))
    merged = rows.groupBy(*KEY).agg(F.min("first").alias("f"), F.array_sort(F.collect_set("epoch")).alias("epochs"))
    return merged.select(*KEY, "f.metric", F.map_from_entries("f.entries").alias("tags"), "epochs")


def manifest_of(series: DataFrame, duration: int) -> DataFrame:
    """A committed manifest row for each segment that occurs in series."""
    return series.select("shard", "segment").distinct().select(
        "shard", "segment", F.lit(duration).cast("int").alias("duration"), F.lit(True).alias("committed"),
        F.lit(None).cast("string").alias("merged_segments"))


def terms(series: DataFrame) -> DataFrame:
    """shard, segment, field, tag_key, term: the distinct terms of each segment."""
    pairs = series.select("shard", "segment", F.explode("tags").alias("k", "v"))
    return (series.select("shard", "segment", F.lit("metric").alias("field"), F.lit(None).cast("string").alias("tag_key"), F.col("metric").alias("term"))
            .union(pairs.select("shard", "segment", F.lit("tag_key"), F.lit(None).cast("string"), "k"))
            .union(pairs.select("shard", "segment", F.lit("tag_value"), "k", "v")).where(F.col("term").isNotNull()).distinct())
