"""How often every metric, tag key and tag value occurs, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofind.functions.tokens import COUNTED, counted, map_parts

#: A term is rare if at most so many rows hold it, common if more than so many percent of all rows do.
RARE_ROWS, COMMON_PERCENT = 2, 30


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    yield "metric", batch.column("metric"), np.arange(batch.num_rows)
    keys, values, rows = map_parts(batch.column("tags"))
    yield "tag_key", keys, rows
    yield "tag_value", values, rows


def frequencies(records: DataFrame) -> DataFrame:
    """field, term, occurrences, n_rows.

    Tokens pass in order of their records; each term has a counter of occurrences, one of records and the
    record last seen, so no set of records is kept. Tasks add up their own counters, then terms are hash-
    partitioned and the few partial counters of each are added; a term that stands in every row moves as
    one row for each task. Null metrics, maps and values are no terms, empty strings are.
    """
    partial = records.select("metric", "tags").mapInArrow(counted(_tokens), COUNTED)
    return partial.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_rows").alias("n_rows"))


def marked(terms: DataFrame, total: int, rare: int = RARE_ROWS, common_percent: int = COMMON_PERCENT) -> DataFrame:
    """Adds mark: 'rare', 'common' or null. A term of a tiny table that is both counts as rare."""
    mark = F.when(F.col("n_rows") <= rare, "rare").when(F.col("n_rows") * 100 > total * common_percent, "common")
    return terms.withColumn("mark", mark)
