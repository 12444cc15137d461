"""Micro-batch ingest: a file stream of records or objects, merged into the segment store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from chronofind.config import EngineConfig
from chronofind.functions.timing import floor_to
from chronofind.metrics import NoopReporter, Reporter
from chronofind.operators.ingest import build_segments
from chronofind.session import drop_scratch, scratch_path
from chronofind.sources.records import dated, read_objects
from chronofind.sources.store import SegmentStore


def merge_records(store: SegmentStore, records: DataFrame, config: EngineConfig, version: int | None = None, reporter: Reporter | None = None) -> int | None:
    """Merge records (metric, tags, series_id, batch, perhaps seq and error) into the store. A segment's
    duration becomes the span from its start to the end of its latest batch. Gives the version, None where
    there is nothing to merge.

    Counted and dropped: damaged records (error set), records without id or batch, and records of batches
    before start_epoch. Counted and merged: late records, of batches before the newest one stored.
    """
    spark, reporter = store.spark, reporter or NoopReporter()
    path = scratch_path(spark, "batch")
    order = F.struct("batch", *(["seq"] if "seq" in records.columns else []))
    damaged = F.col("error").isNotNull() if "error" in records.columns else F.lit(False)
    placed = F.col("series_id").isNotNull() & F.col("batch").isNotNull()
    early = F.col("batch") < config.start_epoch
    try:
        records.select("metric", "tags", "series_id", "batch", *(c for c in ("seq",) if c in records.columns), damaged.alias("damaged")).write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        newest = store.manifest().where("committed").agg(F.max(F.col("segment") + F.coalesce("duration", F.lit(0)))).first()[0]
        late = F.col("batch") + config.batch_seconds < newest if newest is not None else F.lit(False)
        kept = rows.where(~F.col("damaged") & placed & ~early)
        counts = rows.agg(
            F.count(F.lit(1)).alias("records"), F.count_if("damaged").alias("damaged"), F.count_if(~F.col("damaged") & ~placed).alias("unplaced"),
            F.count_if(~F.col("damaged") & placed & early).alias("rejected"), F.count_if(~F.col("damaged") & placed & ~early & late).alias("late")).first()
        for name, n in counts.asDict().items():
            reporter.count(f"ingest.{name}", n, {"namespace": config.namespace})
        if counts["records"] == counts["damaged"] + counts["unplaced"] + counts["rejected"]:
            return None
        build_segments(kept, config.shards, config.segment_full_duration, order).write.parquet(f"{path}/series")
        batch = spark.read.parquet(f"{path}/series")
        start = floor_to(F.col("batch"), config.segment_full_duration)
        ends = kept.groupBy(start.alias("segment")).agg((F.max("batch") - F.first(start) + config.batch_seconds).cast("int").alias("duration"))
        touched = batch.select("shard", "segment").distinct().join(ends, "segment").select("shard", "segment", "duration")
        old = store.manifest().select("shard", "segment", F.col("duration").alias("before"))
        touched = touched.join(old, ["shard", "segment"], "left").select(
            "shard", "segment", F.greatest("duration", F.coalesce("before", F.lit(0))).alias("duration"))
        touched.write.parquet(f"{path}/touched")
        return store.merge_batch(batch, spark.read.parquet(f"{path}/touched"), version)
    finally:
        drop_scratch(spark, path)


def start(spark: SparkSession, source: DataFrame, store: SegmentStore, config: EngineConfig, checkpoint: str,
          reporter: Reporter | None = None, once: bool = False) -> StreamingQuery:
    """Run the stream: each micro-batch is merged whole. source has metric, tags, series_id, batch.

    A batch that is retried after a failure is merged again, which changes nothing, as repeats only add
    epochs that are there already. once: process what is available, then stop.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        version = merge_records(store, batch, config, reporter=reporter)
        if reporter:
            reporter.count("ingest.batches", 1, {"batch": str(batch_id), "empty": str(version is None).lower()})

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{config.polling_interval} seconds"}
    return writer.trigger(**trigger).start()


def object_stream(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """Records of binary objects below input_path/namespace, batch epoch taken from the folder name, damaged
    ones included for merge_records to count; at most max_files_per_trigger objects in one micro-batch."""
    return dated(read_objects(spark, f"{config.input_path}/{config.namespace}", config.max_files_per_trigger))


def parquet_stream(spark: SparkSession, path: str, schema: str, config: EngineConfig) -> DataFrame:
    """Structured records from Parquet files, at most max_files_per_trigger in one micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", config.max_files_per_trigger).parquet(path)
