"""Consolidation of many tiny segment files into fewer large ones.

Which files are still to be merged follows from the upload and roll-up logs. A table of contents stands for
the tiny files, so their objects are written first, once, as their writers would have uploaded them. The
consolidation then reads objects, from a pack or each from a path of its own, and copies their encoded
column chunks into one large file under a new footer. Blocks too small to be read well are gathered in a
second pass: they are joined by copying, checked, and only then decoded and encoded as one block. Every
large file is read back by its footer before it gets its final name.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofind.errors import SegmentError
from chronofind.session import exists, materialise, qualified, scratch_path
from chronofind.sources.footers import join_files

PLACE = ["ns", "shard_id", "epoch"]

CONTENT = T.StructType([
    T.StructField("ns", T.StringType()),
    T.StructField("shard_id", T.IntegerType()),
    T.StructField("epoch", T.LongType()),
    T.StructField("timeseries_id", T.LongType()),
    T.StructField("metric", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])

#: Where an object lies: object is its number, part the large file that it goes to.
OBJECTS = "object bigint, part string, path string, at bigint, size bigint, n_rows bigint, clean boolean"
#: One row for each source object: where it went, how many blocks of it were copied, and how many rows of
#: these were then gathered with others. clean: it went as uploaded; not where it had repeats to remove.
MANIFEST = "object bigint, part string, blocks int, n_rows bigint, clean boolean, gathered bigint, bytes bigint, part_bytes bigint"

#: Size of large files, of packs of objects, and the rows below which a block is gathered with its neighbours.
TARGET_BYTES, PACK_BYTES, BLOCK_ROWS = 128 << 20, 8 << 20, 65_536
DAY = 86_400

def named_epoch(entry: Column) -> Column:
    """The epoch that an entry of merged_segments names: a bare number, perhaps with zeros or white space
    around, or the folder of an object path. Null for anything else."""
    digits = F.regexp_extract(entry, r"^\s*(?:.*/)?0*(\d{1,18})(?:/[^/]*)?\s*$", 1)
    return F.when(digits != "", digits).cast("bigint")


def valid_files(files: DataFrame) -> DataFrame:
    """Committed files without a committed file of later uploaded_at for the same place.

    Files of equal time, or of unknown time, are all kept. Null places are compared like values.
    """
    done = files.where(F.coalesce("is_committed", F.lit(False))).select("file_id", *PLACE, "uploaded_at")
    last = done.groupBy(*PLACE).agg(F.max("uploaded_at").alias("last")).select(*[F.col(c).alias(f"_{c}") for c in PLACE], "last")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE]
    joined = done.join(last, same)
    return joined.where(F.col("uploaded_at").isNull() | (F.col("uploaded_at") >= F.col("last"))).select("file_id", *PLACE)


def files_to_merge(files: DataFrame, rollups: DataFrame) -> DataFrame:
    """file_id, ns, shard_id, epoch of valid files that no committed roll-up of the same ns and shard names."""
    named = rollups.where(F.coalesce("is_committed", F.lit(False))).select("ns", "shard_id", F.explode("merged_segments").alias("m"))
    done = named.select("ns", "shard_id", named_epoch(F.col("m")).alias("epoch")).where(F.col("epoch").isNotNull()).distinct()
    return valid_files(files).join(done, PLACE, "left_anti").select("file_id", *PLACE)


def distinct_rows(series: DataFrame) -> DataFrame:
    """One row for each file and series; aggregated map-side, so that a series repeated very often moves as a
    few rows. Of differing copies the one with the smallest metric, then the smallest tags, stays, nulls last."""
    order = F.struct(F.col("metric").isNull(), "metric", F.col("tags").isNull(), F.map_entries("tags").alias("entries"))
    merged = series.groupBy("file_id", "timeseries_id").agg(F.min(order).alias("b"))
    return merged.select("file_id", "timeseries_id", "b.metric", F.map_from_entries("b.entries").alias("tags"))


def given_away(keys: DataFrame, chosen: DataFrame) -> DataFrame | None:
    """file_id, timeseries_id of the series that another file of the same place keeps: of several chosen files
    of one place, null or not, the one of largest file_id. None where no place has several files.

    keys: file_id, timeseries_id. Only files of places that are tied are looked at, and only their keys.
    """
    tied = chosen.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PLACE))).where("n > 1").select("file_id", *PLACE)
    if tied.isEmpty():
        return None
    keeper = F.max("file_id").over(Window.partitionBy(*PLACE, "timeseries_id"))
    return keys.join(tied, "file_id").withColumn("keeper", keeper).where(F.col("file_id") < F.col("keeper")).select("file_id", "timeseries_id")


def placements(chosen: DataFrame, sizes: DataFrame, target_bytes: int) -> DataFrame:
    """chosen with its part: files of one namespace and shard, in order of their days until they hold
    target_bytes; a day that holds more is divided by file, and a file that holds more by series (pieces).

    sizes: file_id, n_series, bytes, copies. What is ordered are the sums by day, not the files.
    """
    target = F.lit(target_bytes).cast("bigint")
    day = F.col("epoch") - F.pmod(F.col("epoch"), F.lit(DAY).cast("bigint"))
    sized = chosen.join(sizes, "file_id", "left").withColumns({"bytes": F.coalesce("bytes", F.lit(0).cast("bigint")), "day": day})
    days = sized.groupBy("ns", "shard_id", "day").agg(F.sum("bytes").alias("day_bytes"))
    before = F.sum("day_bytes").over(Window.partitionBy("ns", "shard_id").orderBy("day")) - F.col("day_bytes")
    days = days.select(F.col("ns").alias("_ns"), F.col("shard_id").alias("_shard"), F.col("day").alias("_day"), F.expr("day_bytes").alias("_bytes"), F.floor(before / target).alias("_run"))
    same = F.col("ns").eqNullSafe(F.col("_ns")) & F.col("shard_id").eqNullSafe(F.col("_shard")) & F.col("day").eqNullSafe(F.col("_day"))
    slots = F.ceil(F.greatest("_bytes", target) / target).cast("bigint")
    placed = sized.join(days, same)
    # A divided day stands alone, so that its slots don't mix with its neighbours.
    own = F.struct("ns", "shard_id", F.when(slots > 1, F.col("day")).alias("day"), F.when(slots == 1, F.col("_run")).alias("run"), F.pmod(F.xxhash64("file_id"), slots).alias("slot"))
    return placed.select("file_id", *PLACE, "copies", F.col("n_series").alias("rows"), F.to_json(own).alias("group"), F.ceil(F.greatest("bytes", target) / target).cast("bigint").alias("pieces"))


def encode(table: pa.Table, dictionary: bool = False) -> bytes:
    """A segment file of one row group; tiny ones are written without dictionaries."""
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, row_group_size=max(1, len(table)), use_dictionary=dictionary, compression="snappy", write_statistics=["epoch", "timeseries_id"], store_schema=False)
    return sink.getvalue().to_pybytes()


def _folder(where: str) -> tuple[pafs.FileSystem, str]:
    # Spark's names of the object store are the same file system to Arrow.
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", where))


def _publish(where: str, name: str, content: bytes) -> None:
    """Write a file, then give it its name; a retried task replaces it by an equal one."""
    fs, root = _folder(where)
    fs.create_dir(root, recursive=True)
    draft = f"{root}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(content)
    fs.move(draft, f"{root}/{name}")


def _rows_of(content: bytes) -> tuple[int, int]:
    meta = pq.ParquetFile(io.BytesIO(content)).metadata
    return meta.num_rows, meta.num_row_groups


def join_objects(contents: list[bytes], rows: list[int | None], block_rows: int) -> tuple[bytes, list[tuple[int, int]], list[int]]:
    """(one file, blocks and rows of each object, rows of each that were gathered) of objects of one schema.

    rows: how many each should hold, where that is known. Blocks are copied as they are. Runs of objects of
    fewer than block_rows rows are copied together, checked, then decoded and encoded as blocks of about
    block_rows rows.
    """
    counts = [n if n is not None else _rows_of(c)[0] for n, c in zip(rows, contents, strict=True)]
    ready: list[bytes] = []
    each: list[tuple[int, int]] = [(0, 0)] * len(contents)
    gathered = [0] * len(contents)
    runs: list[list[int]] = [[]]
    held = 0
    for i, n in enumerate(counts):
        if n >= block_rows:
            runs += [[i], []]
            held = 0
            continue
        runs[-1].append(i)
        held += n
        if held >= block_rows:
            runs.append([])
            held = 0
    for run in filter(None, runs):
        joined = join_files([contents[i] for i in run])
        for i, found in zip(run, joined.each, strict=True):
            each[i] = found
            if found[1] != counts[i]:
                raise SegmentError(f"an object holds {found[1]} rows, not {counts[i]}")
        if len(run) == 1 or joined.blocks < 2:
            ready.append(joined.content)
            continue
        table = pq.read_table(io.BytesIO(joined.content))
        if len(table) != joined.rows:
            raise SegmentError(f"{len(table)} rows, not {joined.rows}")
        ready.append(encode(table, dictionary=True))
        for i in run:
            gathered[i] = counts[i]
    whole = ready[0] if len(ready) == 1 else join_files(ready).content
    if _rows_of(whole)[0] != sum(counts):
        raise SegmentError("the large file doesn't hold the rows of its sources")
    return whole, each, gathered


def _contents(rows: list[dict]) -> list[bytes]:
    """The bytes of the objects of one path, which is read once from the first to the last of them."""
    fs, at = _folder(rows[0]["path"])
    low, high = rows[0]["at"], max(r["at"] + r["size"] for r in rows)
    with fs.open_input_file(at) as f:
        run = memoryview(f.read_at(high - low, low))
    if len(run) != high - low:
        raise SegmentError(f"{rows[0]['path']} ends early")
    return [bytes(run[r["at"] - low : r["at"] - low + r["size"]]) for r in rows]


def _merger(where: str, block_rows: int):
    """mapInArrow function over OBJECTS sorted by part, path and place: publishes each part's large file."""

    def finish(part: str, rows: list[dict]) -> pa.RecordBatch:
        contents = [c for _, same in groupby(rows, key=lambda r: r["path"]) for c in _contents(list(same))]
        content, each, gathered = join_objects(contents, [r["n_rows"] for r in rows], block_rows)
        _publish(where, f"{part}.parquet", content)
        n = len(rows)
        return pa.RecordBatch.from_arrays([
            pa.array([r["object"] for r in rows], pa.int64()), pa.array([part] * n, pa.string()), pa.array([b for b, _ in each], pa.int32()), pa.array([k for _, k in each], pa.int64()),
            pa.array([r["clean"] for r in rows], pa.bool_()), pa.array(gathered, pa.int64()), pa.array([r["size"] for r in rows], pa.int64()), pa.array([len(content)] * n, pa.int64())],
            names=["object", "part", "blocks", "n_rows", "clean", "gathered", "bytes", "part_bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["part"] != held[-1]["part"]:
                    yield finish(held[0]["part"], held)
                    held = []
                held.append(row)
        if held:
            yield finish(held[0]["part"], held)

    return run


def _spread(df: DataFrame, by: str) -> DataFrame:
    """Hash partitions in a number that adaptive execution keeps: a few bytes of index stand for much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def merge_objects(objects: DataFrame, where: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Join the objects (OBJECTS) of each part into one large file below `where`; gives MANIFEST. Contents are
    read where they lie and aren't shuffled; one task holds the objects of one large file."""
    ordered = _spread(objects, "part").sortWithinPartitions("part", "path", "at")
    return ordered.mapInArrow(_merger(where, block_rows), MANIFEST)


def _packer(where: str):
    """mapInArrow function over rows in which those of a file, or piece of one, follow each other: encodes each
    as an object and writes them to packs, by part within each; gives OBJECTS."""
    schema = pa.schema([("ns", pa.string()), ("shard_id", pa.int32()), ("epoch", pa.int64()), ("timeseries_id", pa.int64()),
                        ("metric", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))])

    def written(objects: list[tuple]) -> pa.RecordBatch:
        objects.sort(key=lambda o: o[:2])
        # A retried task writes packs of its own.
        name = f"{uuid.uuid4().hex}.pack"
        _publish(where, name, b"".join(o[4] for o in objects))
        sizes = np.array([len(o[4]) for o in objects], np.int64)
        column = lambda i, t: pa.array([o[i] for o in objects], t)
        return pa.RecordBatch.from_arrays([
            column(1, pa.int64()), column(0, pa.string()), pa.array([f"{where}/{name}"] * len(objects), pa.string()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
            column(2, pa.int64()), column(3, pa.bool_())], names=["object", "part", "path", "at", "size", "n_rows", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects: list[tuple] = []
        held: list[pa.Table] = []
        size, current = 0, None

        def finish() -> int:
            table = pa.concat_tables(held)
            content = encode(table.select(schema.names).cast(schema))
            objects.append((table["part"][0].as_py(), table["file_id"][0].as_py(), len(table), table["clean"][0].as_py(), content))
            held.clear()
            return len(content)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids, pieces = table["file_id"].combine_chunks().to_numpy(), table["piece"].combine_chunks().to_numpy()
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (pieces[1:] != pieces[:-1])]) if len(ids) else []
            for start, end in zip(starts, [*starts[1:], len(ids)], strict=True):
                if held and (ids[start], pieces[start]) != current:
                    size += finish()
                    if size > PACK_BYTES:
                        yield written(objects)
                        objects, size = [], 0
                current = ids[start], pieces[start]
                held.append(table.slice(start, end - start))
        if held:
            finish()
        if objects:
            yield written(objects)

    return run


def uploaded_objects(chosen: DataFrame, series: DataFrame, where: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The objects of the chosen files (OBJECTS, object being the file_id), written below `where` in packs of
    about PACK_BYTES. Files without rows have none.

    chosen: file_id, ns, shard_id, epoch; series: file_id, timeseries_id, metric, tags. Sizes and placement
    follow from keys; contents then move once, to meet their file's placement, and become objects where they
    arrive. Files with repeated series, or of which another file of the place keeps a series, are reduced
    before they move and come out not clean; files larger than target_bytes are divided by series.
    """
    spark = chosen.sparkSession
    tiny = series.where(F.col("file_id").isNotNull()).select("file_id", "timeseries_id", "metric", "tags")
    text = F.coalesce(F.octet_length("metric"), F.lit(0)) + F.coalesce(F.aggregate(F.map_entries("tags"), F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0))), F.lit(0))
    keys = tiny.select("file_id", "timeseries_id", text.alias("text")).groupBy("file_id", "timeseries_id").agg(F.count(F.lit(1)).alias("copies"), F.max("text").alias("text"))
    sizes = keys.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_series"), F.sum(F.col("text") + 32).alias("bytes"), F.max("copies").alias("copies"))
    placed = placements(chosen, sizes, target_bytes).where(F.col("rows") > 0).withColumn("clean", F.col("copies") == 1)
    away = given_away(tiny.select("file_id", "timeseries_id"), chosen)
    if away is not None:
        away = materialise(away.distinct(), "p7-away")
        out = away.select(F.col("file_id").alias("_file"), F.col("timeseries_id").alias("_series"))
        named = (F.col("file_id") == F.col("_file")) & F.col("timeseries_id").eqNullSafe(F.col("_series"))
        givers = away.select("file_id").distinct().withColumn("gives", F.lit(True))
        placed = placed.join(givers, "file_id", "left").withColumn("clean", F.col("clean") & F.col("gives").isNull())
    placed = materialise(placed.select("file_id", *PLACE, "group", "pieces", "clean"), "p7-placed")

    def pieced(rows: DataFrame, files: DataFrame) -> DataFrame:
        piece = F.pmod(F.xxhash64("timeseries_id"), F.col("pieces"))
        rows = rows.join(files, "file_id").withColumn("piece", piece).withColumn("part", F.md5(F.concat_ws("/", "group", F.col("piece").cast("string"))))
        return rows.select("part", "piece", "file_id", *PLACE, "timeseries_id", "metric", "tags", "clean")

    pack = lambda rows: rows.mapInArrow(_packer(qualified(spark, where)), OBJECTS)
    moved = lambda rows: pack(rows.repartition("file_id", "piece").sortWithinPartitions("file_id", "piece", "timeseries_id"))
    # The window asks for what a sorted join by file has done already, so no second exchange follows one.
    by_file = F.row_number().over(Window.partitionBy("file_id").orderBy("timeseries_id"))
    objects = pack(pieced(tiny, placed.where("clean and pieces = 1")).withColumn("n", by_file))
    unclean, large = placed.where("not clean"), placed.where("clean and pieces > 1")
    reduced = tiny.join(unclean.select("file_id"), "file_id", "left_semi")
    objects = objects.union(moved(pieced(distinct_rows(reduced if away is None else reduced.join(out, named, "left_anti")), unclean)))
    if not large.isEmpty():
        objects = objects.union(moved(pieced(tiny, large)))
    return materialise(objects, "p7-objects")


def merge_files(chosen: DataFrame, series: DataFrame, where: str, target_bytes: int = TARGET_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Merge the chosen files' rows into large files of about target_bytes below `where`; gives file_id, parts,
    blocks copied, n_rows, clean, gathered rows and bytes of every chosen file.

    A series stands once for each place, however many chosen files the place has. Files without rows, or whose
    rows another file keeps, have 0 blocks and rows, and are clean if they had no repeats.
    """
    objects = uploaded_objects(chosen, series, scratch_path(chosen.sparkSession, "p7-packs"), target_bytes)
    log = materialise(merge_objects(objects, qualified(chosen.sparkSession, where), block_rows), "p7-log")
    done = log.groupBy(F.col("object").alias("file_id")).agg(
        F.count(F.lit(1)).cast("int").alias("parts"), F.sum("blocks").cast("int").alias("blocks"), F.sum("n_rows").alias("n_rows"), F.min("clean").alias("clean"),
        F.sum("gathered").alias("gathered"), F.sum("bytes").alias("bytes"))
    none = {"parts": 0, "blocks": 0, "n_rows": 0, "clean": True, "gathered": 0, "bytes": 0}
    return chosen.select("file_id").join(done, "file_id", "left").fillna(none)


def merged_rows(spark: SparkSession, where: str) -> DataFrame:
    """Rows of the large files; CONTENT without rows where none was written."""
    if not exists(spark, where):
        return spark.createDataFrame([], CONTENT)
    return spark.read.schema(CONTENT).parquet(where)


def compact_paths(spark: SparkSession, sources: str, where: str, target_bytes: int = TARGET_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Join the Parquet files below `sources` into files of about target_bytes; gives path, part, blocks,
    n_rows, gathered, bytes, part_bytes. Files of one folder must share a schema.

    A folder's files are divided by hash of their path over as many large files as its bytes need, and stand
    there in order of their paths. Only paths and sizes are shuffled; the task that joins them reads the
    files. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(sources).select("path", "length")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    listed = materialise(files.select("path", "length", folder.alias("folder"), F.xxhash64("path").alias("object")), "p7-listed")
    sizes = listed.groupBy("folder").agg(F.sum("length").alias("folder_bytes"))
    slots = F.ceil(F.greatest("folder_bytes", F.lit(target_bytes).cast("bigint")) / F.lit(target_bytes)).cast("bigint")
    part = F.md5(F.concat_ws("/", "folder", F.pmod("object", slots).cast("string")))
    objects = listed.join(sizes, "folder").select(
        "object", part.alias("part"), "path", F.lit(0).cast("bigint").alias("at"), F.col("length").alias("size"), F.lit(None).cast("bigint").alias("n_rows"), F.lit(True).alias("clean"))
    log = materialise(merge_objects(objects, qualified(spark, where), block_rows), "p7-log")
    return listed.select("path", "object").join(log, "object").drop("object", "clean")
