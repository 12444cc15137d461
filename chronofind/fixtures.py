"""Series derived from the events table, in a store: the input of the reference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofind.functions.routing import shard_of
from chronofind.operators.catalog import Catalog, tag_keys
from chronofind.operators.ingest import build_segments, manifest_of
from chronofind.session import materialise, scratch_path
from chronofind.sources.store import SegmentStore

FULL, BATCH, SHARDS = 86_400, 7_200, 10


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, t, batch, metric, tags, series_id of every event. Event types become metrics; tags come
    from the user and the JSON properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    vip = F.when(F.col("user_id") % 5 == 0, F.lit("y"))
    canary = F.when((F.col("user_id") % 50 == 7) & (F.col("event_id") % 7 == 0), F.lit("y"))
    e = e.select(
        "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("metric"),
        F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"),
        F.concat(F.lit("b"), F.expr("cast(get_json_object(props, '$.k') as bigint) div 25").cast("string")).alias("band"),
        vip.alias("vip"), canary.alias("canary"))
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("metric", "host", "band", "vip", "canary")])
    tags = F.map_filter(F.create_map(*[x for c in ("host", "band", "vip", "canary") for x in (F.lit(c), F.col(c))]), lambda _, v: v.isNotNull())
    series_id = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint") - F.lit(576460752303423488)
    return e.select("event_id", "t", (F.col("t") - F.col("t") % BATCH).alias("batch"), "metric", tags.alias("tags"), series_id.alias("series_id"))


def derived_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog computed from the events on every use, without a store."""
    records = event_records(spark, sf_dir)
    series = build_segments(records, SHARDS, FULL)
    # The manifest and the key table don't need the merged rows: a series' id follows from its tags.
    day = F.col("batch") - F.col("batch") % FULL
    placed = records.select(shard_of(F.col("series_id"), SHARDS).alias("shard"), day.alias("segment"), "tags")
    return Catalog(series, manifest_of(placed, FULL), tag_keys(placed))


def event_store(spark: SparkSession, sf_dir: str) -> SegmentStore:
    """The store of all events; written at its first use in a session."""
    stores = spark.sparkContext.__dict__.setdefault("_chronofind_stores", {})
    if sf_dir not in stores:
        store = SegmentStore(spark, scratch_path(spark, "store"))
        series = materialise(build_segments(event_records(spark, sf_dir), SHARDS, FULL), "built")
        store.write(series, manifest_of(series, FULL))
        stores[sf_dir] = store
    return stores[sf_dir]


def event_catalog(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> Catalog:
    """The stored catalog of the events; of the segments in a time range, if one is given."""
    return event_store(spark, sf_dir).catalog(start, end)
