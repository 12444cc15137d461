"""Segment store: versioned Parquet data and a manifest log.

    <root>/data/version=<v>/shard=<s>/segment=<t>/*.parquet   rows of one write
    <root>/keys/version=<v>/*.parquet                          (shard, segment, tag_key) of these rows
    <root>/manifest/<v>/*.parquet                              what write v changed: (shard, segment, version, ...)
    <root>/manifest/<v>.all/*.parquet                          all earlier rows that still count, as of v

Data becomes visible when its manifest folder is complete, so readers never meet a partial write, and a
segment can be rewritten while it is being read. The latest version of a segment counts. A scan opens
the folders of live segments in its time range and no others; vacuum deletes what no reader needs.
"""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronofind.functions.timing import segment_in_range
from chronofind.metrics import NoopReporter, Reporter, timed
from chronofind.model import MANIFEST, SERIES
from chronofind.operators.catalog import SEGMENT, Catalog, tag_keys
from chronofind.operators.compaction import compact, rollup
from chronofind.plans.pruning import metric_key
from chronofind.session import exists, filesystem

#: version: of the last change; data_version: of the rows, null where there are none.
_LOG = T.StructType([T.StructField("version", T.LongType()), T.StructField("data_version", T.LongType()), T.StructField("n_series", T.LongType()), *MANIFEST.fields])
_DATA = T.StructType([T.StructField("version", T.LongType()), *SERIES.fields, T.StructField("metric_key", T.StringType())])
_KEYS = T.StructType([T.StructField("version", T.LongType()), *SERIES.fields[:2], T.StructField("tag_key", T.StringType())])
_ALL = ".all"
#: Commits that a reader goes through before they are summarised.
MOST_COMMITS = 50


class SegmentStore:
    """One namespace's segments. A single writer at a time is assumed; readers need no lock."""

    def __init__(self, spark: SparkSession, root: str, reporter: Reporter | None = None):
        self.spark, self.root, self.reporter = spark, root.rstrip("/"), reporter or NoopReporter()

    def _folders(self, what: str) -> list[str]:
        fs, path = filesystem(self.spark, f"{self.root}/{what}")
        return sorted(f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()) if fs.exists(path) else []

    def _commits(self) -> list[str]:
        """Folders of the manifest that count: the last complete summary and the commits after it."""
        done = [n for n in self._folders("manifest") if n.removesuffix(_ALL).isdigit() and exists(self.spark, f"{self.root}/manifest/{n}/_SUCCESS")]
        last = max((n for n in done if n.endswith(_ALL)), default="")
        return [n for n in done if n == last or not n.endswith(_ALL) and n > last.removesuffix(_ALL)]

    def _log(self) -> DataFrame:
        paths = [f"{self.root}/manifest/{n}" for n in self._commits()]
        return self.spark.read.schema(_LOG).parquet(*paths) if paths else self.spark.createDataFrame([], _LOG)

    def manifest(self) -> DataFrame:
        """The latest manifest row of every segment, with its versions."""
        last = F.max_by(F.struct(*_LOG.names), "version").alias("m")
        return self._log().groupBy(*SEGMENT).agg(last).select("m.*")

    def live(self, start: int | None = None, end: int | None = None) -> list[Row]:
        """Manifest rows of the committed segments, in the time range if one is given: a list of folders, as
        Spark's own partition listing would be, not of data."""
        rows = self.manifest().where("committed")
        if start is not None and end is not None:
            rows = rows.where(segment_in_range(F.col("segment"), F.col("duration"), start, end))
        return rows.collect()

    def _series(self, live: list[Row]) -> DataFrame:
        """Rows of the given segments, with partition columns for what else a query prunes."""
        paths = [f"{self.root}/data/version={r.data_version}/shard={r.shard}/segment={r.segment}" for r in live if r.data_version is not None]
        if not paths:
            return self.spark.createDataFrame([], _DATA).drop("version")
        return self.spark.read.schema(_DATA).option("basePath", f"{self.root}/data").parquet(*paths).drop("version")

    def _keys(self, live: list[Row], kept: DataFrame) -> DataFrame:
        """Tag keys by segment; a version's folder may also hold those of segments that were replaced since."""
        paths = sorted({f"{self.root}/keys/version={r.data_version}" for r in live if r.data_version is not None})
        if not paths:
            return self.spark.createDataFrame([], _KEYS).drop("version")
        keys = self.spark.read.schema(_KEYS).option("basePath", f"{self.root}/keys").parquet(*paths)
        return keys.join(kept.select(F.col("data_version").alias("version"), *SEGMENT), ["version", *SEGMENT], "left_semi").drop("version")

    def catalog(self, start: int | None = None, end: int | None = None) -> Catalog:
        """The tables of a query on the time range, whose manifest is a small local table; or all tables."""
        live = self.live(start, end)
        if start is None or end is None:
            manifest = self.manifest()
        else:
            # Through Arrow, so that Spark knows the size and checks it before it broadcasts.
            manifest = self.spark.createDataFrame(pa.Table.from_pylist([r.asDict() for r in live], to_arrow_schema(_LOG)), _LOG)
        return Catalog(self._series(live), manifest.select(*MANIFEST.names), self._keys(live, manifest.where("committed")))

    def write(self, series: DataFrame, manifest: DataFrame, version: int | None = None) -> int:
        """Write segments in full, replacing earlier versions; gives the version.

        Rows are divided by range of segment, metric and series: a large segment or metric is spread over
        several tasks and files, and each file's row groups and pages can be skipped by metric. The range
        bounds are sampled, so series should be cheap to read twice. Writing a version again replaces it.
        """
        began = time.monotonic()
        version = version or time.time_ns()
        rows = series.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SERIES]).withColumn("metric_key", metric_key(F.col("metric")))
        order = [*SEGMENT, "metric_key", "series_id"]
        where = f"{self.root}/data/version={version}"
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(*SEGMENT).mode("overwrite").parquet(where)
        written = self.spark.read.schema(_DATA).option("basePath", f"{self.root}/data").parquet(where)
        tag_keys(written).select(*SEGMENT, "tag_key").write.mode("overwrite").parquet(f"{self.root}/keys/version={version}")
        counts = written.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n_series"))
        self._commit(manifest, version, counts)
        total = self.spark.read.schema(_LOG).parquet(f"{self.root}/manifest/{version:020d}").agg(F.sum("n_series")).first()[0]
        self.reporter.count("segment.build.timeseries.count", total or 0, {"version": str(version)})
        self.reporter.gauge("segment.build.ms", (time.monotonic() - began) * 1000, {"version": str(version)})
        return version

    def _commit(self, manifest: DataFrame, version: int, counts: DataFrame) -> None:
        rows = manifest.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in MANIFEST]).join(counts, SEGMENT, "left")
        rows = rows.withColumns({"version": F.lit(version), "n_series": F.coalesce("n_series", F.lit(0).cast("bigint"))})
        rows = rows.withColumn("data_version", F.when(F.col("n_series") > 0, F.lit(version)))
        rows.select(*_LOG.names).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version:020d}")
        if len(self._commits()) > MOST_COMMITS:
            self._summarise(self._log())

    def _summarise(self, log: DataFrame) -> None:
        log.select(*_LOG.names).coalesce(1).write.parquet(f"{self.root}/manifest/{time.time_ns():020d}{_ALL}")

    def merge_batch(self, batch: DataFrame, batch_epoch_end: DataFrame, version: int | None = None) -> int:
        """Merge new segment rows into the stored ones; only the touched segments are read and rewritten.

        batch_epoch_end: shard, segment, duration of the touched segments after the merge. The stored
        metric and tags of a series win over the new ones.
        """
        touched = batch_epoch_end.select(*SEGMENT)
        stored = self._series(self.manifest().where("committed").join(touched, SEGMENT, "left_semi").collect()).select(*SERIES.names)
        # compact() lets the earliest segment win, so new rows are ranked behind stored ones.
        both = stored.withColumn("rank", F.lit(0)).unionByName(batch.select(*SERIES.names).withColumn("rank", F.lit(1)))
        merged = both.groupBy("shard", "segment", "series_id").agg(
            F.min_by(F.struct("metric", "tags"), "rank").alias("body"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("epochs")))).alias("epochs"))
        rows = merged.select(*SEGMENT, "series_id", "body.metric", "body.tags", "epochs")
        manifest = batch_epoch_end.select(*SEGMENT, "duration", F.lit(True).alias("committed"), F.lit(None).cast("string").alias("merged_segments"))
        return self.write(rows, manifest, version)

    def compact_segments(self, shard: int, segments: list[int]) -> int:
        """Merge the named segments under the first; the others become invisible."""
        first, chosen = min(segments), (F.col("shard") == shard) & F.col("segment").isin(segments)
        rows = self._series(self.manifest().where(F.col("committed") & chosen).collect()).select(*SERIES.names)
        total = self.manifest().where(chosen).agg(F.coalesce(F.sum(F.coalesce("duration", F.lit(0))), F.lit(0)).cast("int").alias("d")).first()["d"]
        manifest = self.spark.createDataFrame(
            [(shard, s, total if s == first else 0, s == first, ",".join(map(str, sorted(segments))) if s == first else None) for s in segments], MANIFEST)
        return self.write(compact(rows, F.lit(first).cast("bigint")), manifest)

    def rollup(self, size: int, now: int, target: SegmentStore | None = None, start_time: int = 1, retire: bool = False) -> int | None:
        """Roll up every shard that has enough segments, into target or in place; None if none has.
        Sources stay visible unless they are the first of their roll-up, which it replaces in place, or
        retire is set: then those that the roll-up named become invisible here. Segments that target's
        roll-ups name already aren't taken again."""
        with timed(self.reporter, "rollup.generation.ms"):
            catalog = self.catalog()
            if target is not None:
                before = target.manifest().where(F.col("merged_segments").isNotNull()).select(*MANIFEST.names).withColumn("committed", F.lit(False))
                catalog = Catalog(catalog.series, catalog.manifest.unionByName(before), catalog.key_table)
            series, manifest = rollup(catalog, size, now, start_time)
            if manifest.isEmpty():
                return None
            version = (target or self).write(series, manifest)
        merged = self.spark.read.schema(_LOG).parquet(f"{(target or self).root}/manifest/{version:020d}")
        self.reporter.gauge("rollup.segment.series", merged.agg(F.max("n_series")).first()[0], {})
        if retire:
            self.retire(merged, target is None)
        return version

    def retire(self, merged: DataFrame, keep_first: bool = True) -> None:
        """Hide the segments that merged_segments names, but for the roll-up's own where it is in this store."""
        named = merged.select("shard", F.col("segment").alias("first"), F.explode(F.split("merged_segments", ",")).alias("m"))
        named = named.select("shard", F.expr("try_cast(trim(m) as bigint)").alias("segment"), "first")
        named = named.where(F.col("segment") != F.col("first")) if keep_first else named
        rows = self.manifest().join(named.select(*SEGMENT).distinct(), SEGMENT, "left_semi")
        version = time.time_ns()
        rows.withColumns({"committed": F.lit(False), "version": F.lit(version)}).select(*_LOG.names).coalesce(1).write.parquet(f"{self.root}/manifest/{version:020d}")

    def vacuum(self, retain_seconds: float = 86_400.0) -> int:
        """Summarise the manifest and delete rows that were replaced or hidden more than retain_seconds ago, so
        longer than any reader takes; gives the number of folders deleted.

        Data are kept while their segment's row is the latest and committed, or was replaced or hidden less
        than that ago. Versions that never became visible, or of which nothing is kept, go as a whole.
        """
        cutoff = time.time_ns() - int(retain_seconds * 1e9)
        follows = F.lead("version").over(Window.partitionBy(*SEGMENT).orderBy("version"))
        log = self._log().withColumn("next", follows)
        log = log.withColumn("kept", F.coalesce(F.col("next") > cutoff, F.col("committed")) & F.col("data_version").isNotNull()).persist()
        leaf = ["data_version", *SEGMENT]
        used = {r[0] for r in log.where("kept").select("data_version").distinct().collect()}
        dead = log.where("not kept and data_version is not null").select(*leaf).distinct().join(log.where("kept").select(*leaf), leaf, "left_anti").collect()
        doomed = [f"data/version={r.data_version}/shard={r.shard}/segment={r.segment}" for r in dead if r.data_version in used]
        doomed += [f"{what}/{n}" for what in ("data", "keys") for n in self._folders(what) if (v := int(n.removeprefix("version="))) not in used and v <= cutoff]
        doomed += [f"manifest/{n}" for n in self._folders("manifest") if n.removesuffix(_ALL).isdigit() and int(n.removesuffix(_ALL)) <= cutoff]
        self._summarise(log.where(F.col("next").isNull() | (F.col("next") > cutoff)))
        log.unpersist()
        for path in doomed:
            fs, hadoop = filesystem(self.spark, f"{self.root}/{path}")
            fs.delete(hadoop, True)
        return len(doomed)
