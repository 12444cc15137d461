"""Merging of segments: compaction, roll-up selection and roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofind.functions.timing import epoch_bucket
from chronofind.operators.catalog import SEGMENT, Catalog

DAY = 86_400


def compact(series: DataFrame, target: Column) -> DataFrame:
    """Merge the rows of one shard that share target (the segment start that they go to).

    Epochs are bucketed anew from target; those before it are dropped. Of a series stored in several
    segments, metric and tags of the earliest segment win.
    """
    moved = series.withColumn("target", target).where(F.col("target").isNotNull())
    rebucketed = F.transform("epochs", lambda e: epoch_bucket(e, F.col("target")))
    merged = moved.select("shard", "target", "series_id", "segment", F.struct("metric", "tags").alias("body"), F.array_compact(rebucketed).alias("epochs")) \
        .groupBy("shard", "target", "series_id").agg(
            F.min_by("body", "segment").alias("body"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("epochs")))).alias("epochs"))
    return merged.select("shard", F.col("target").alias("segment"), "series_id", "body.metric", "body.tags", "epochs")


def rollup_candidates(manifest: DataFrame, size: int, now: int, start_time: int = 1) -> DataFrame:
    """shard, segment, duration, target: the first `size` segments of each shard that are old enough,
    short enough and not merged yet; shards with fewer give none. target is the earliest of them.
    """
    ready = manifest.where(
        F.coalesce("committed", F.lit(False)) & (F.col("segment") >= start_time) & (F.lit(now) - F.col("segment") > size * DAY)
        & (F.coalesce("duration", F.lit(0)) < size * DAY))
    done = manifest.where(F.col("merged_segments").isNotNull()).select(
        "shard", F.explode(F.split("merged_segments", ",")).alias("m")).select("shard", F.expr("try_cast(trim(m) as bigint)").alias("segment")).distinct()
    ready = ready.select("shard", "segment", F.coalesce("duration", F.lit(0)).alias("duration")).join(done, SEGMENT, "left_anti")
    ordered = Window.partitionBy("shard").orderBy("segment")
    whole = Window.partitionBy("shard")
    first = ready.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= size)
    sized = first.select("*", F.count(F.lit(1)).over(whole).alias("n"), F.min("segment").over(whole).alias("target"))
    return sized.where(F.col("n") == size).select("shard", "segment", "duration", "target")


def rollup(catalog: Catalog, size: int, now: int, start_time: int = 1) -> tuple[DataFrame, DataFrame]:
    """(series, manifest) of the rolled-up segments: durations summed, sources listed in order."""
    chosen = rollup_candidates(catalog.manifest, size, now, start_time)
    rows = catalog.rows.join(chosen.select(*SEGMENT, "target"), SEGMENT)
    series = compact(rows, F.col("target"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("segment")), lambda s: s.cast("string")), ",")
    manifest = chosen.groupBy("shard", "target").agg(F.sum("duration").cast("int").alias("duration"), listed.alias("merged_segments"))
    return series, manifest.select(
        "shard", F.col("target").alias("segment"), "duration", F.lit(True).alias("committed"), "merged_segments")
