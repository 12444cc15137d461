"""Registered queries of the write path: each writes a store, objects or a stream, and reads them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofind import serving
from chronofind.config import EngineConfig
from chronofind.fixtures import BATCH, FULL, SHARDS, derived_catalog, event_records, event_store
from chronofind.metrics import MemoryReporter
from chronofind.operators import discovery, timeseries
from chronofind.operators.ingest import build_segments, manifest_of
from chronofind.plans.request import parse_request
from chronofind.queries.reference import _BASE, ALIGNED_END, END, FLAGSHIP, START, _matched, _sql, m1, m2, metric, request, value
from chronofind.session import materialise, scratch_path
from chronofind.sources.objects import ObjectStore
from chronofind.sources.records import read_objects, valid_records, write_objects
from chronofind.sources.store import SegmentStore
from chronofind.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]

#: Parts in which the events are merged one after another, and one record in so many that is damaged.
MERGES, DAMAGED = 3, 50
_NOW = START + 20 * FULL
_CONFIG = EngineConfig(namespace="events", shards=SHARDS, batch_seconds=BATCH, segment_full_duration=FULL)


def _new_store(spark: SparkSession) -> SegmentStore:
    return SegmentStore(spark, scratch_path(spark, "store"))


def _segments(store: SegmentStore) -> DataFrame:
    """shard, segment, duration, n_series, n_epochs, n_tags of every visible segment, read from the store."""
    catalog = store.catalog()
    rows = catalog.rows.groupBy("shard", "segment").agg(
        F.count(F.lit(1)).alias("n_series"), F.sum(F.size("epochs")).alias("n_epochs"), F.sum(F.size("tags")).alias("n_tags"))
    return catalog.visible.join(rows, ["shard", "segment"])


def searched_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's text, planned on the store: only segments in range are opened, metrics reach the scan."""
    text = {"from": 0, "to": 0, "start": START, "end": END, "type": "timeseries", "group": ["band"], "query": FLAGSHIP}
    return timeseries.summary(serving.result(event_store(spark, sf_dir), parse_request(text)))


def served_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client puts together from the messages of a request."""
    return spark.createDataFrame(_served(spark, sf_dir)[0], "shard int, grp string, series_id bigint, n_epochs bigint")


def served_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_served(spark, sf_dir)[1], "shard int, value string")


def _served(spark: SparkSession, sf_dir: str) -> tuple[list[tuple], list[tuple]]:
    text = {"from": 0, "to": 0, "start": START, "end": END, "type": "TIMESERIES", "group": ["band"], "query": FLAGSHIP}
    rows, words = [], []
    for message in serving.answer(event_store(spark, sf_dir), text, EngineConfig(response_size=10)):
        rows += [(r.shard, "|".join(r.grp), r.series_id, len(r.epochs)) for r in message.rows]
        words += [(shard, v) for shard, values in (message.dictionary or {}).items() for v in values]
    return rows, words


def derived_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship without a store: ingest and search in one plan."""
    return timeseries.summary(timeseries.search(derived_catalog(spark, sf_dir), request(FLAGSHIP, ("band",))))


def limited_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = parse_request({"from": 0, "to": 0, "limit": 5, "start": START, "end": END, "type": "TAG_KEYS_AND_VALUES", "group": ["host"], "query": metric("click")})
    return discovery.discover(event_store(spark, sf_dir).catalog(asked.start, asked.end), asked)


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second day is written again with its even series only; the latest version counts."""
    store, series = _new_store(spark), event_store(spark, sf_dir).catalog().rows
    store.write(series, manifest_of(series, FULL))
    again = series.where((F.col("segment") % (2 * FULL) == 0) & (F.col("series_id") % 2 == 0))
    store.write(again, manifest_of(again, FULL))
    return _segments(store).select("shard", "segment", "n_series", "n_epochs")


def vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_live segments, n_folders of data and n_rows that are left when everything was written twice and the
    store was cleaned."""
    store, series = _new_store(spark), event_store(spark, sf_dir).catalog().rows
    for _ in range(2):
        store.write(series, manifest_of(series, FULL))
    store.vacuum(0)
    files = ObjectStore(spark, f"{store.root}/data").list_files()
    folders = {f.path.rsplit("/", 1)[0] for f in files if f.path.endswith(".parquet")}
    return store.catalog().rows.agg(F.count_distinct("shard", "segment").alias("n_live"), F.lit(len(folders)).cast("bigint").alias("n_folders"), F.count(F.lit(1)).alias("n_rows"))


def merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events merged in MERGES parts, each of which touches most segments again."""
    store = _new_store(spark)
    for part in range(MERGES):
        streaming.merge_records(store, event_records(spark, sf_dir).where(F.col("event_id") % MERGES == part), _CONFIG)
    return _segments(store)


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard 3's first three days under the first of them."""
    store, series = _new_store(spark), event_store(spark, sf_dir).catalog().rows.where("shard = 3")
    store.write(series, manifest_of(series, FULL))
    store.compact_segments(3, [START + i * FULL for i in range(3)])
    return _segments(store).select("shard", "segment", "duration", "n_series", "n_epochs")


def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-up into a second store, read from there with its manifest."""
    target = _new_store(spark)
    event_store(spark, sf_dir).rollup(7, _NOW, target)
    listed = target.manifest().select("shard", "segment", "merged_segments")
    return _segments(target).select("shard", "segment", "duration", "n_series", "n_epochs").join(listed, ["shard", "segment"])


def _written_objects(spark: SparkSession, sf_dir: str) -> str:
    where = scratch_path(spark, "objects")
    write_objects(event_records(spark, sf_dir), f"{where}/events").write.format("noop").mode("overwrite").save()
    return where


def ingested_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gzip objects of binary records by batch, decoded again and built into segments."""
    records = valid_records(read_objects(spark, f"{_written_objects(spark, sf_dir)}/events"))
    return build_segments(records, SHARDS, FULL).groupBy("shard", "segment").agg(
        F.count(F.lit(1)).alias("n_series"), F.sum(F.size("epochs")).alias("n_epochs"), F.sum(F.size("tags")).alias("n_tags"))


def listed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch: the folders of the objects, as the object store client lists them."""
    folders = ObjectStore(spark, _written_objects(spark, sf_dir)).list_folders("events")
    return spark.createDataFrame([(int(f),) for f in folders], "batch bigint")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects as a stream of micro-batches of at most 100 objects, merged into a store."""
    config = EngineConfig(**{**_CONFIG.__dict__, "input_path": _written_objects(spark, sf_dir), "max_files_per_trigger": 100})
    store = _new_store(spark)
    streaming.start(spark, streaming.object_stream(spark, config), store, config, scratch_path(spark, "checkpoint"), once=True).awaitTermination()
    return _segments(store).select("shard", "segment", "n_series", "n_epochs", "n_tags")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, n: what ingest counts where one record in DAMAGED is damaged, one in as many has no id, and the
    first two days lie before start_epoch; the later half of the days comes first, so the earlier is late."""
    records = event_records(spark, sf_dir).withColumns({
        "error": F.when(F.col("event_id") % DAMAGED == 0, F.lit("damaged")), "series_id": F.when(F.col("event_id") % DAMAGED != 1, F.col("series_id"))})
    records = materialise(records, "records")
    config = EngineConfig(**{**_CONFIG.__dict__, "start_epoch": START + 2 * FULL})
    store, reporter, half = _new_store(spark), MemoryReporter(), START + 15 * FULL
    for part in (F.col("batch") >= half, F.col("batch") < half):
        streaming.merge_records(store, records.where(part), config, reporter=reporter)
    return spark.createDataFrame([(k.removeprefix("ingest."), int(v)) for k, v in sorted(reporter.counts.items())], T.StructType([
        T.StructField("name", T.StringType()), T.StructField("n", T.LongType())]))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose metric and tags differ between records: of each day the first record's stay."""
    records = event_records(spark, sf_dir).withColumn("series_id", F.pmod("series_id", F.lit(97)))
    rows = build_segments(records, SHARDS, FULL, F.struct("batch", "event_id"))
    return rows.select("shard", "segment", "series_id", "metric", F.col("tags")["host"].alias("host"), F.col("tags")["band"].alias("band"), F.size("epochs").alias("n_epochs"))


def queries() -> dict[str, Query]:
    return {
        "store_search": searched_text,
        "store_versions": rewritten,
        "store_vacuum": vacuumed,
        "store_merge_batch": merged_batches,
        "store_compact": compacted,
        "store_rollup": rolled_up,
        "served_series": served_series,
        "served_dictionary": served_dictionary,
        "derived_search": derived_search,
        "discover_limit": limited_terms,
        "object_ingest": ingested_objects,
        "object_listing": listed_objects,
        "stream_ingest": streamed,
        "ingest_counts": ingest_counts,
        "ingest_first_seen": first_seen,
    }


_TAGS = "2 + (vip IS NOT NULL)::INT + (canary IS NOT NULL)::INT"


def _counts(where: str = "true") -> str:
    return f"""s AS (SELECT shard, segment, series_id, count(DISTINCT epoch) AS n_epochs, any_value({_TAGS}) AS n_tags FROM se WHERE {where} GROUP BY ALL),
        g AS (SELECT shard, segment, count(*) AS n_series, CAST(sum(n_epochs) AS BIGINT) AS n_epochs, CAST(sum(n_tags) AS BIGINT) AS n_tags FROM s GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    flagship = f"{m1('metric', 'click')} AND {m2('host', 'h1.*')} AND NOT {m1('band', 'b0|b3')}"
    pick = f"""p AS (SELECT shard, segment, row_number() OVER (PARTITION BY shard ORDER BY segment) AS rk FROM (SELECT DISTINCT shard, segment FROM se WHERE {_NOW} - segment > 7 * 86400)),
        f AS (SELECT shard, min(segment) AS target, count(*) AS n, string_agg(CAST(segment AS VARCHAR), ',' ORDER BY segment) AS merged_segments FROM p WHERE rk <= 7 GROUP BY shard HAVING count(*) = 7)"""
    served = _sql(flagship, "band", select="SELECT shard, grp, series_id, count(DISTINCT epoch) AS n_epochs FROM found GROUP BY shard, grp, series_id")
    counts, half, begin = f"{_BASE}, {_counts()}", START + 15 * FULL, START + 2 * FULL
    return {
        "store_search": _sql(flagship, "band"),
        "store_versions": f"{_BASE}, {_counts(f'segment % {2 * FULL} <> 0 OR series_id % 2 = 0')} SELECT shard, segment, n_series, n_epochs FROM g UNION ALL SELECT shard, segment, count(DISTINCT series_id), count(DISTINCT (series_id, epoch)) FROM se WHERE segment % {2 * FULL} = 0 AND (shard, segment) NOT IN (SELECT (shard, segment) FROM g) GROUP BY ALL",
        "store_vacuum": f"{counts} SELECT count(*) AS n_live, count(*) AS n_folders, CAST(sum(n_series) AS BIGINT) AS n_rows FROM g",
        "store_merge_batch": f"""{counts}, e AS (SELECT event_id % {MERGES} AS part, segment, max(batch - segment) + {BATCH} AS span FROM r GROUP BY ALL),
            t AS (SELECT DISTINCT event_id % {MERGES} AS part, CAST(abs(series_id % 10) AS INTEGER) AS shard, segment FROM r),
            d AS (SELECT shard, segment, CAST(max(span) AS INTEGER) AS duration FROM t JOIN e USING (part, segment) GROUP BY ALL) SELECT * FROM g JOIN d USING (shard, segment)""",
        "store_compact": f"""{_BASE}, d AS (SELECT *, CASE WHEN segment < {START + 3 * FULL} THEN {START} ELSE segment END AS target FROM se WHERE shard = 3)
            SELECT shard, target AS segment, CAST({FULL} * count(DISTINCT segment) AS INTEGER) AS duration, count(DISTINCT series_id) AS n_series, count(DISTINCT (series_id, epoch)) AS n_epochs FROM d GROUP BY ALL""",
        "store_rollup": f"""{_BASE}, {pick} SELECT shard, target AS segment, CAST({7 * FULL} AS INTEGER) AS duration, count(DISTINCT series_id) AS n_series,
            count(DISTINCT (series_id, target + ((epoch - target) // 21600) * 21600)) AS n_epochs, any_value(merged_segments) AS merged_segments FROM se JOIN p USING (shard, segment) JOIN f USING (shard) WHERE rk <= 7 GROUP BY shard, target""",
        "served_series": served,
        "served_dictionary": _sql(flagship, "band", select="SELECT DISTINCT shard, grp AS value FROM found"),
        "derived_search": _sql(flagship, "band"),
        "discover_limit": _matched(m1("metric", "click"), START, ALIGNED_END) + " SELECT DISTINCT host AS term FROM m ORDER BY term LIMIT 5",
        "object_ingest": f"{counts} SELECT * FROM g",
        "object_listing": f"{_BASE} SELECT DISTINCT batch FROM r",
        "stream_ingest": f"{counts} SELECT * FROM g",
        "ingest_counts": f"""{_BASE}, c AS (SELECT event_id % {DAMAGED} = 0 AS damaged, event_id % {DAMAGED} = 1 AS unplaced, batch < {begin} AS early, batch < {half} AS second,
              batch + {BATCH} < (SELECT max(x.batch) + {BATCH} FROM r x WHERE x.event_id % {DAMAGED} > 1) AS late FROM r)
            SELECT 'records' AS name, count(*) AS n FROM c UNION ALL SELECT 'damaged', count(*) FROM c WHERE damaged UNION ALL SELECT 'unplaced', count(*) FROM c WHERE unplaced
            UNION ALL SELECT 'rejected', count(*) FROM c WHERE early AND NOT damaged AND NOT unplaced
            UNION ALL SELECT 'late', count(*) FROM c WHERE second AND late AND NOT early AND NOT damaged AND NOT unplaced""",
        "ingest_first_seen": f"""{_BASE}, x AS (SELECT *, ((series_id % 97) + 97) % 97 AS id FROM r)
            SELECT CAST(id % 10 AS INTEGER) AS shard, segment, id AS series_id, arg_min(metric, (batch, event_id)) AS metric, arg_min(host, (batch, event_id)) AS host, arg_min(band, (batch, event_id)) AS band,
            CAST(count(DISTINCT (batch - segment) // 21600) AS INTEGER) AS n_epochs FROM x GROUP BY id, segment""",
    }
