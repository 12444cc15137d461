"""Schemas and fixed values shared by all modules."""

from pyspark.sql import types as T

# Fixed values of the data model.
EPOCH_SECONDS = 21_600
ALIGN_SECONDS = 1_800
NO_DATA = "__no_data__"
TAGKEY_NAMESPACE = "__tagkey"

TAGS = T.MapType(T.StringType(), T.StringType())

RECORD = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("tags", TAGS),
    T.StructField("series_id", T.LongType()),
])

#: One row for each series of a segment; epochs holds every six-hour bucket in which it was seen.
SERIES = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("segment", T.LongType()),
    T.StructField("series_id", T.LongType()),
    T.StructField("metric", T.StringType()),
    T.StructField("tags", TAGS),
    T.StructField("epochs", T.ArrayType(T.LongType())),
])

MANIFEST = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("segment", T.LongType()),
    T.StructField("duration", T.IntegerType()),
    T.StructField("committed", T.BooleanType()),
    T.StructField("merged_segments", T.StringType()),
])
