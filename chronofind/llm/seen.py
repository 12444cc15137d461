"""Has this key been seen before? Sealed partitions of perfect-hash indexes, exact sets for the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofind.llm.perfecthash import FINGERPRINT_BITS, PerfectIndex
from chronofind.session import materialise

#: Distinct keys of one partition; bounds what one task holds in memory.
KEYS_PER_PART = 250_000
#: Sealed generations that a lookup goes through before they are sealed anew as one.
MOST_GENERATIONS = 8
#: Normal quantile of the stated upper bound of a rate, one-sided 97.5 %.
Z = 1.96
__all__ = ["FINGERPRINT_BITS"]
_INDEX = "part int, n bigint, blob binary"


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts).cast("bigint")).cast("int")


def parts_for(expected_keys: int) -> int:
    return max(1, -(-expected_keys // KEYS_PER_PART))


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key) sorted by part; a partition may hold several parts."""
    held: list[np.ndarray] = []
    current = None
    for batch in batches:
        part = batch.column("part").to_numpy()
        keys = batch.column("key").to_numpy()
        for p in np.unique(part):
            if p != current and held:
                yield _row(current, held)
                held = []
            current = p
            held.append(keys[part == p])
    if held:
        yield _row(current, held)


def _row(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
    keys = np.concatenate(held)
    blob = PerfectIndex.build(keys).to_bytes()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([blob], pa.binary())], names=["part", "n", "blob"])


def seal(keys: DataFrame, parts: int) -> DataFrame:
    """part, n, blob: an index for each hash partition of the keys (column key; repeats and nulls are
    dropped), written to the shared folder. Append it to earlier ones. No keys give no rows."""
    distinct = keys.select("key").where(F.col("key").isNotNull()).distinct()
    sorted_ = distinct.select(part_of(F.col("key"), parts).alias("part"), "key").repartition("part").sortWithinPartitions("part")
    return materialise(sorted_.mapInArrow(_sealed, _INDEX), "seen-index")


def _probed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    keys = left["key"].to_numpy()
    hit = np.zeros(len(keys), bool)
    for blob in right["blob"]:
        rest = ~hit
        hit[rest] = PerfectIndex.from_bytes(blob).contains(keys[rest])
    return pd.DataFrame({"key": keys, "first": left["first"].to_numpy(), "stored": hit})


def probe(batch: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """key, first, stored for each distinct key of a batch (columns key and first, see first_of)."""
    left = batch.withColumn("part", part_of(F.col("key"), parts))
    found = left.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(_probed, "key bigint, first bigint, stored boolean")
    return found


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, first: the batch's exact set, each key with the smallest order. Aggregated map-side, so a key
    with a third of all rows arrives as one row for each task. Null keys are left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(order).alias("first"))


def answers(rows: DataFrame, key: str, order: str, earlier: DataFrame, parts: int, batches: list[tuple[int, int]], only_new: bool = False,
            generations: int = MOST_GENERATIONS) -> DataFrame:
    """key, first, stored: what the indexes answer on each distinct key of each batch, or the new ones only;
    written to the shared folder.

    Batches are ranges [from, to) of order, ascending and covering it. For each, keys are looked up in the
    sealed partitions so far, and what is new is sealed in turn; lookups never need the raw keys of earlier
    batches. After so many generations all keys so far are read once more and sealed as one, so that a lookup
    stays short however many batches there are.
    """
    index, sealed = seal(earlier, parts), 1
    out = None
    for i, (low, high) in enumerate(batches):
        batch = first_of(rows.where((F.col(order) >= low) & (F.col(order) < high)), key, order)
        answered = probe(batch, index, parts)
        answered = materialise(answered.where(~F.col("stored")) if only_new else answered, "seen-new")
        out = answered if out is None else out.union(answered)
        if i == len(batches) - 1:
            break
        if sealed < generations:
            index, sealed = index.union(seal(answered.where(~F.col("stored")), parts)), sealed + 1
        else:
            before = rows.where(F.col(order) < high).select(F.col(key).alias("key"))
            index, sealed = seal(earlier.select("key").union(before), parts), 1
    return out


def firsts(rows: DataFrame, key: str, order: str, earlier: DataFrame, parts: int, batches: list[tuple[int, int]], generations: int = MOST_GENERATIONS) -> DataFrame:
    """key, first: the rows (by their unique order) whose key is new, batch by batch as in answers."""
    return answers(rows, key, order, earlier, parts, batches, True, generations).select("key", "first")


def seen_before(rows: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with a non-null key that aren't its first occurrence. order is unique, so this anti-join is
    even however uneven the keys are."""
    return rows.where(F.col(key).isNotNull()).join(new.select(F.col("first").alias(order)), order, "left_anti")


def error_rate(batch: DataFrame, index: DataFrame, earlier: DataFrame, parts: int) -> DataFrame:
    """n_probed, n_absent, n_wrong, rate, upper: keys of the batch, those that really aren't among the earlier
    ones, and those of them that the index claims to know. Misses of known keys can't happen."""
    truth = earlier.select("key").where(F.col("key").isNotNull()).distinct().withColumn("known", F.lit(True))
    judged = probe(batch, index, parts).join(truth, "key", "left").select("stored", F.coalesce("known", F.lit(False)).alias("known"))
    return _rate(judged, F.count(F.lit(1)))


def answers_error_rate(answered: DataFrame, rows: DataFrame, key: str, order: str, earlier: DataFrame) -> DataFrame:
    """n_probed, n_absent, n_wrong, rate, upper over all batches of answers: distinct keys probed, answers on keys that
    were neither among the earlier ones nor in a row before, and wrong answers of either kind. A key wrongly
    taken for known isn't sealed, so a later batch may miss it; that counts too."""
    truth = earlier.select("key").where(F.col("key").isNotNull()).distinct().withColumn("known", F.lit(True))
    ever = first_of(rows, key, order).withColumnRenamed("first", "ever")
    judged = answered.join(ever, "key").join(truth, "key", "left")
    again = F.col("ever") < F.col("first")
    return _rate(judged.select("stored", (again | F.coalesce("known", F.lit(False))).alias("known"), again.alias("again")), F.count_if(~F.col("again")))


def _rate(judged: DataFrame, probed: Column) -> DataFrame:
    """upper: Wilson's bound of the rate, above 0 also where nothing was wrong; 1 where nothing was absent."""
    absent = F.count_if(~F.col("known"))
    wrong = F.count_if(F.col("stored") != F.col("known"))
    counts = judged.agg(probed.alias("n_probed"), absent.alias("n_absent"), wrong.alias("n_wrong"))
    n, p, z2 = F.col("n_absent"), F.coalesce(F.try_divide("n_wrong", "n_absent"), F.lit(0.0)), Z * Z
    bound = (p + z2 / (2 * n) + Z * F.sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n)
    return counts.select("*", p.alias("rate"), F.when(n > 0, bound).otherwise(F.lit(1.0)).alias("upper"))
