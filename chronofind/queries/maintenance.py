"""Registered queries of skew handling and small-file consolidation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofind.functions.tokens import COUNTED, SHARDED, counted, metric_and_tags
from chronofind.operators import skew, smallfiles
from chronofind.session import materialise, scratch_path
from chronofind.sources.objects import ObjectStore

Query = Callable[[SparkSession, str], DataFrame]

#: Items held by at least so many percent of all rows are reported by p4_found.
HEAVY_PERCENT = 5
#: Tasks of the item plan for each shuffle partition: finer tasks are evener, and run one after another.
SHARES = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item_shards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, skew.BalancePlan]:
    """(rows of items in their tasks, plan). Loads are estimated over all rows of records; rows that hold a
    split item are dealt out to its shards, counted there within each task, and moved to the shards' tasks."""
    records = _table(spark, sf_dir, "records").select("metric", "tags")
    plan = skew.plan_for_items(records, metric_and_tags, SHARES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return records.mapInArrow(counted(skew.sharded(metric_and_tags, plan)), SHARDED).drop("occurrences"), plan


def item_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, item, n_rows, n_stored: for every metric and tag of records, the rows that hold it and the
    rows of the stored series that do. The stored counts are copied to the shards of split items only."""
    facts, plan = _item_shards(spark, sf_dir)
    stored = _table(spark, sf_dir, "tags_and_timestamp").select("metric", "tags").mapInArrow(counted(metric_and_tags), COUNTED)
    stored = stored.groupBy("field", "term").agg(F.sum("n_rows").alias("n_stored"))
    joined = skew.balanced_join(facts, stored, ["field", "term"], skew.item_key(), [F.col("term")], plan, "left", F.col("shard"))
    shards = joined.groupBy(skew.TASK, "field", "term").agg(F.sum("n_rows").alias("n_rows"), F.first("n_stored").alias("n_stored"))
    return shards.groupBy("field", F.col("term").alias("item")).agg(F.sum("n_rows").alias("n_rows"), F.coalesce(F.max("n_stored"), F.lit(0).cast("bigint")).alias("n_stored"))


def item_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tasks, n_entries, n_split, largest: how even the plan of p4_found and p4_items is. Entries are items
    of rows; largest is the share of the fullest task, as a multiple of the mean."""
    facts, plan = _item_shards(spark, sf_dir)
    loads = skew.fragment(facts, skew.item_key(), [F.col("term")], plan, F.col("shard")).groupBy(skew.TASK).agg(F.sum("n_rows").alias("n"))
    n_split = sum(len(t) > 1 for t in plan.placed.values())
    return loads.agg(F.lit(plan.tasks).alias("n_tasks"), F.sum("n").alias("n_entries"), F.lit(n_split).alias("n_split"), (F.max("n") * plan.tasks / F.sum("n")).alias("largest"))


def heavy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _table(spark, sf_dir, "records").count()
    return item_results(spark, sf_dir).where(F.col("n_rows") * 100 >= total * HEAVY_PERCENT).select("field", "item")


def metric_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric, n_rows, n_series, n_stored: rows, different xx_hash, and stored rows of the metric.

    Different series can't be counted from partial sums, so rows move. A split metric's rows are divided
    by xx_hash, which makes its shards' counts add up.
    """
    facts = _table(spark, sf_dir, "records").groupBy("metric", "xx_hash").agg(F.count(F.lit(1)).alias("n"))
    facts = materialise(facts, "p4-series")
    stored = _table(spark, sf_dir, "tags_and_timestamp").groupBy("metric").agg(F.count(F.lit(1)).alias("n_stored"))
    plan = skew.plan_for(facts, F.col("metric"))
    joined = skew.balanced_join(facts, stored, ["metric"], F.col("metric"), [F.col("xx_hash")], plan, "left")
    shards = joined.groupBy(skew.TASK, "metric").agg(F.sum("n").alias("n_rows"), F.count("xx_hash").alias("n_series"), F.first("n_stored").alias("n_stored"))
    return shards.groupBy("metric").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_series").alias("n_series"), F.coalesce(F.max("n_stored"), F.lit(0).cast("bigint")).alias("n_stored"))


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    chosen = smallfiles.files_to_merge(_table(spark, sf_dir, "segment_files"), _table(spark, sf_dir, "rolled_segments"))
    chosen = materialise(chosen, "p7-chosen")
    where = scratch_path(spark, "p7-segments")
    return smallfiles.merge_files(chosen, _table(spark, sf_dir, "timeseries"), where), where


def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].select("file_id")


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smallfiles.merged_rows(spark, _merged(spark, sf_dir)[1]).select("ns", "shard_id", "epoch", "timeseries_id")


def compaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the consolidation did: files in, files with rows, objects whose bytes were copied as uploaded, files
    whose repeats were removed first, and rows."""
    done = _merged(spark, sf_dir)[0]
    return done.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("n_rows") > 0).alias("n_files_with_rows"),
        F.count_if(F.col("clean") & (F.col("n_rows") > 0)).alias("n_copied"), F.count_if(~F.col("clean")).alias("n_reduced"), F.sum("n_rows").alias("n_rows"))


def compaction_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the objects and of the large files, number and median of these, and the share of rows that the
    second pass gathered into larger blocks."""
    done, where = _merged(spark, sf_dir)
    sizes = [(f.size,) for f in ObjectStore(spark, where).list_files() if f.path.endswith(".parquet")]
    files = spark.createDataFrame(sizes, "size bigint").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("part_bytes"), F.median("size").alias("median_bytes"))
    copied = done.agg(F.sum("blocks").alias("blocks_copied"), F.sum("bytes").alias("object_bytes"), (F.sum("gathered") / F.sum("n_rows")).alias("share_gathered"))
    return copied.join(files)


def compacted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ns, shard_id, n_files, n_rows: the small files that a job partitioned by day left, joined by copying and
    read back; n_files counts the large files of each folder."""
    tiny, where = scratch_path(spark, "p7-tiny"), scratch_path(spark, "p7-joined")
    day = (F.col("epoch") - F.pmod(F.col("epoch"), F.lit(smallfiles.DAY))).alias("day")
    rows = _table(spark, sf_dir, "timeseries").where("ns is not null and shard_id is not null")
    rows.select("ns", "shard_id", "epoch", "timeseries_id", "metric", "tags", F.col("ns").alias("_ns"), F.col("shard_id").alias("_shard"), day).repartition("ns", "shard_id", "day").write.partitionBy("_ns", "_shard").option(
        "maxRecordsPerFile", 2_000).parquet(tiny)
    smallfiles.compact_paths(spark, tiny, where).write.format("noop").mode("overwrite").save()
    joined = smallfiles.merged_rows(spark, where).withColumn("_file", F.input_file_name())
    return joined.groupBy("ns", "shard_id").agg(F.count_distinct("_file").alias("n_files"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("timeseries_id").alias("n_series"))


_ITEMS = """
i AS (SELECT 'metric' AS field, metric AS item FROM {0} WHERE metric IS NOT NULL
  UNION ALL SELECT 'tag', unnest(list_distinct(list_transform(list_filter(map_entries(tags), lambda e: e.value IS NOT NULL), lambda e: e.key || '=' || e.value))) FROM {0}),
c AS (SELECT field, item, count(*) AS n FROM i GROUP BY 1, 2)"""
_TO_MERGE = r"""
valid AS (SELECT f.* FROM segment_files f WHERE is_committed AND NOT EXISTS (SELECT 1 FROM segment_files g
   WHERE g.is_committed AND g.ns = f.ns AND g.shard_id = f.shard_id AND g.epoch = f.epoch AND g.uploaded_at > f.uploaded_at)),
done AS (SELECT DISTINCT ns, shard_id, TRY_CAST(regexp_extract(m, '^\s*(?:.*/)?0*(\d{1,18})(?:/[^/]*)?\s*$', 1) AS BIGINT) AS epoch
   FROM (SELECT ns, shard_id, unnest(merged_segments) AS m FROM rolled_segments WHERE is_committed)),
todo AS (SELECT v.* FROM valid v WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.ns = v.ns AND d.shard_id = v.shard_id AND d.epoch = v.epoch))"""


def queries() -> dict[str, Query]:
    return {
        "p4_found": heavy_items,
        "p4_items": item_results,
        "p4_metrics": metric_results,
        "p4_tasks": item_tasks,
        "p7_found": merged_files,
        "p7_segments": merged_segments,
        "p7_report": compaction_report,
        "p7_sizes": compaction_sizes,
        "p7_paths": compacted_paths,
    }


def oracle_sql() -> dict[str, str]:
    items, stored = _ITEMS.format("records"), _ITEMS.format("tags_and_timestamp").replace("\ni AS", "\nsi AS").replace("\nc AS", "\nsc AS").replace("FROM i GROUP", "FROM si GROUP")
    return {
        "p4_found": f"WITH {items} SELECT field, item FROM c WHERE n * 100 >= (SELECT count(*) FROM records) * {HEAVY_PERCENT}",
        "p4_items": f"WITH {items}, {stored} SELECT c.field, c.item, c.n AS n_rows, coalesce(sc.n, 0) AS n_stored FROM c LEFT JOIN sc ON c.field = sc.field AND c.item = sc.item",
        "p4_metrics": """WITH s AS (SELECT metric, count(*) AS n FROM tags_and_timestamp GROUP BY 1)
            SELECT r.metric, count(*) AS n_rows, count(DISTINCT xx_hash) AS n_series, coalesce(any_value(s.n), 0) AS n_stored FROM records r LEFT JOIN s ON r.metric = s.metric GROUP BY r.metric""",
        "p7_found": f"WITH {_TO_MERGE} SELECT file_id FROM todo",
        "p7_segments": f"WITH {_TO_MERGE} SELECT DISTINCT d.ns, d.shard_id, d.epoch, t.timeseries_id FROM todo d JOIN timeseries t USING (file_id)",
        "p7_report": f"""WITH {_TO_MERGE}, r AS (SELECT d.file_id, count(DISTINCT t.timeseries_id) AS n, count(t.timeseries_id) AS all_n FROM todo d LEFT JOIN timeseries t USING (file_id) GROUP BY 1)
            SELECT count(*) AS n_files, count(*) FILTER (n > 0) AS n_files_with_rows, count(*) FILTER (n > 0 AND n = all_n) AS n_copied,
            count(*) FILTER (n <> all_n) AS n_reduced, CAST(sum(n) AS BIGINT) AS n_rows FROM r""",
        "p7_paths": """SELECT ns, shard_id, CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows, count(DISTINCT timeseries_id) AS n_series FROM timeseries WHERE ns IS NOT NULL AND shard_id IS NOT NULL GROUP BY 1, 2""",
    }
