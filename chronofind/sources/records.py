"""Binary record objects: gzip streams of length-prefixed records."""

from __future__ import annotations

import gzip
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofind.errors import SegmentError
from chronofind.model import TAGS

# Fixed values of the record format: four header bytes, the hash as a big-endian signed long, two bytes,
# NUL-terminated keys and values up to a 0x01 byte, one more byte, the metric up to NUL or the end.
_HEADER, _AFTER_HASH, _TAGS_END = 4, 2, 0x01

DECODED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("series_id", T.LongType()),
    T.StructField("metric", T.StringType()),
    T.StructField("tags", TAGS),
    T.StructField("error", T.StringType()),
])

# Fixed columns of Spark's binary file source; a stream wants them named.
_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_ARROW = pa.schema([
    ("path", pa.string()), ("seq", pa.int64()), ("series_id", pa.int64()), ("metric", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


def _text(buf: bytes, at: int) -> tuple[str, int]:
    if at >= len(buf):
        raise SegmentError("record ends early")
    end = buf.find(b"\0", at)
    end = len(buf) if end < 0 else end
    try:
        return buf[at:end].decode("utf-8"), end + 1
    except UnicodeDecodeError as e:
        raise SegmentError("text isn't UTF-8") from e


def decode(buf: bytes) -> tuple[int, str, dict[str, str]]:
    """(series_id, metric, tags) of one record; SegmentError where it is damaged. No tags are allowed."""
    at = _HEADER
    if len(buf) < at + 8 + _AFTER_HASH:
        raise SegmentError("record ends early")
    series_id = struct.unpack_from(">q", buf, at)[0]
    at += 8 + _AFTER_HASH
    tags: dict[str, str] = {}
    while at >= len(buf) or buf[at] != _TAGS_END:
        key, at = _text(buf, at)
        tags[key], at = _text(buf, at)
        if at >= len(buf):
            raise SegmentError("no metric")
    metric, _ = _text(buf, at + 2)
    return series_id, metric, tags


def encode(series_id: int, metric: str, tags: dict[str, str]) -> bytes:
    """The inverse of decode, without the length prefix."""
    body = b"".join(s.encode() + b"\0" for pair in tags.items() for s in pair)
    return bytes(_HEADER) + struct.pack(">q", series_id) + bytes(_AFTER_HASH) + body + bytes([_TAGS_END, 0]) + metric.encode() + b"\0"


def frame(records: list[bytes]) -> bytes:
    return gzip.compress(b"".join(struct.pack(">I", len(r)) + r for r in records))


def unframe(content: bytes) -> Iterator[bytes]:
    """Records of one object; a damaged or cut stream ends with SegmentError."""
    with gzip.open(io.BytesIO(content)) as stream:
        try:
            while head := stream.read(4):
                size = struct.unpack(">I", head)[0] if len(head) == 4 else -1
                if size < 0 or len(buf := stream.read(size)) < size:
                    raise SegmentError("stream ends inside a record")
                yield buf
        except (OSError, EOFError) as e:
            raise SegmentError(f"damaged stream: {e}") from e


def _rows(path: str, content: bytes) -> Iterator[tuple]:
    seq = 0
    try:
        for seq, buf in enumerate(unframe(content)):
            try:
                yield path, seq, *decode(buf), None
            except SegmentError as e:
                yield path, seq, None, None, None, str(e)
    except SegmentError as e:
        yield path, seq + 1, None, None, None, str(e)


def _decode_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            held: list[tuple] = []
            for row in _rows(path, content.as_py()):
                held.append(row)
                if len(held) == 50_000:
                    yield _batch(held)
                    held = []
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    tags = [None if t is None else list(t.items()) for t in columns[4]]
    return pa.RecordBatch.from_arrays([pa.array(tags if f.name == "tags" else c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def read_objects(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """DECODED rows of every object below path; an empty folder gives none. With max_files, a stream that
    takes at most so many objects at once, oldest first.

    Damaged records come out with error set and nothing else, so that a caller can count and drop them.
    One task decodes a whole object, as a gzip stream can't be split.
    """
    reader = spark.read if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    files = reader.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_decode_files, DECODED)


def dated(decoded: DataFrame, batch_depth: int = 2) -> DataFrame:
    """metric, tags, series_id, seq, error, and batch: the epoch in the folder or file name `batch_depth`
    levels from the end of the path, null where there is none."""
    part = F.element_at(F.split("path", "/"), -batch_depth)
    batch = F.regexp_extract(part, r"^(\d{1,18})", 1)
    return decoded.select("metric", "tags", "series_id", "seq", "error", F.when(batch != "", batch).cast("bigint").alias("batch"))


def valid_records(decoded: DataFrame, batch_depth: int = 2) -> DataFrame:
    """The dated rows without an error and with a batch; streaming.merge_records counts the others."""
    return dated(decoded, batch_depth).where(F.col("error").isNull() & F.col("batch").isNotNull()).drop("error")


def write_objects(records: DataFrame, where: str, name: str = "part") -> DataFrame:
    """Write records (metric, tags, series_id, batch) as one object for each batch: <where>/<batch>/<name>.gz;
    gives path, n. The inverse of read_objects, for exports and tests. Rows without id or batch are left out,
    null texts written as empty. One task writes a batch in order of series_id; a retry replaces the object,
    which is renamed when complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", where))
        current, out, n, draft = None, None, 0, ""

        def done() -> pa.RecordBatch:
            out.close()
            fs.move(draft, f"{root}/{current}/{name}.gz")
            return pa.RecordBatch.from_pydict({"path": [f"{where}/{current}/{name}.gz"], "n": [n]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["batch"] != current:
                    if out is not None:
                        yield done()
                    current, n = row["batch"], 0
                    fs.create_dir(f"{root}/{current}", recursive=True)
                    draft = f"{root}/{current}/_{name}.{uuid.uuid4().hex}"
                    out = gzip.GzipFile(fileobj=fs.open_output_stream(draft, compression=None), mode="wb")
                record = encode(row["series_id"], row["metric"] or "", {k: v or "" for k, v in row["tags"] or []})
                out.write(struct.pack(">I", len(record)) + record)
                n += 1
        if out is not None:
            yield done()

    rows = records.select("batch", "series_id", "metric", "tags").where(F.col("batch").isNotNull() & F.col("series_id").isNotNull())
    return rows.repartition("batch").sortWithinPartitions("batch", "series_id").mapInArrow(run, "path string, n bigint")
