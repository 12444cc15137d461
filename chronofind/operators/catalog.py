"""The tables a query runs on, and the per-segment facts derived from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofind.functions.timing import segment_in_range

SEGMENT = ["shard", "segment"]


@dataclass(frozen=True)
class Catalog:
    """series: model.SERIES; manifest: model.MANIFEST. Extra columns are ignored, but for metric_key in
    series, which lets metric filters reach the scan.

    A null duration counts as 0, a null committed as false. Rows of series without a manifest row are
    invisible. key_table: shard, segment, tag_key of every key that occurs, where a store keeps it; without
    it the keys are derived from the series.
    """

    series: DataFrame
    manifest: DataFrame
    key_table: DataFrame | None = None

    @cached_property
    def rows(self) -> DataFrame:
        return self.series.select(*SEGMENT, "series_id", "metric", "tags", "epochs")

    @cached_property
    def prunable(self) -> bool:
        return "metric_key" in self.series.columns

    @cached_property
    def visible(self) -> DataFrame:
        """Committed segments: shard, segment, duration."""
        kept = self.manifest.where(F.coalesce("committed", F.lit(False)))
        return kept.groupBy(*SEGMENT).agg(F.max(F.coalesce("duration", F.lit(0))).alias("duration"))

    def segments_in(self, start: int, end: int) -> DataFrame:
        return self.visible.where(segment_in_range(F.col("segment"), F.col("duration"), start, end)).select(*SEGMENT)

    def scan(self, segments: DataFrame, end: int | None = None) -> DataFrame:
        """Series of the given segments. The literal bound prunes partitions before the semi-join does."""
        rows = self.rows if end is None else self.rows.where(F.col("segment") <= end)
        return rows.join(segments, SEGMENT, "left_semi")

    def matching(self, facts: DataFrame, end: int, hit: Column, only: Column | None = None) -> DataFrame:
        """Rows that satisfy hit, with the columns of facts, which has one row for each segment. Rows are
        filtered before they are joined: by the bound, which prunes partitions, by `only` (on metric_key),
        which prunes row groups, and by hit."""
        rows = self.series if only is None else self.series.where(only)
        rows = rows.select(self.rows.columns).where((F.col("segment") <= end) & hit)
        return rows.join(facts, SEGMENT)

    def keys(self, segments: DataFrame, end: int) -> DataFrame:
        """Tag keys of the given segments, perhaps repeated: shard, segment, tag_key."""
        if self.key_table is not None:
            return self.key_table.select(*SEGMENT, "tag_key").where(F.col("segment") <= end).join(segments, SEGMENT, "left_semi")
        return _exploded(self.scan(segments, end))

    @cached_property
    def shards(self) -> DataFrame:
        """shard: every shard with a visible segment."""
        return self.visible.select("shard").distinct()


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select(*SEGMENT, F.explode(F.map_keys("tags")).alias("tag_key"))


def tag_keys(rows: DataFrame) -> DataFrame:
    """Distinct tag keys by segment."""
    return _exploded(rows).distinct()
