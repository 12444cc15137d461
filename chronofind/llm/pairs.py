"""Items that appear together: pair counts, and how much they exceed chance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofind.functions.tokens import COUNTED, counted, metric_and_tags
from chronofind.session import materialise

#: Pairs are formed in blocks of about this many, and partial counts leave a task by as many.
_BLOCK_PAIRS = 2_000_000
_PAIRS = "x bigint, y bigint, together bigint"
#: Items of a row above which its pairs are divided over tasks, and of a block of it.
WIDE = 1_024
#: Items that may be given a hash of their own; they become part of the plan.
MOST_RENAMED = 500


def marginals(records: DataFrame) -> DataFrame:
    """item, n: rows of records that hold each key=value; written to the shared folder."""
    partial = records.select("metric", "tags").mapInArrow(counted(metric_and_tags), COUNTED).where(F.col("field") == "tag")
    return materialise(partial.groupBy(F.col("term").alias("item")).agg(F.sum("n_rows").alias("n")), "p5-items")


def item_hash(items: DataFrame) -> Callable[[Column], Column]:
    """A 64-bit hash of items that no two of these share, so that counting by hash is exact.

    Items whose hash another one has, too, get one of another seed, until all differ. Of n items about
    n ** 2 / 2 ** 65 pairs collide by chance, so there are hardly any at all; where there are more than
    MOST_RENAMED, which no seed gives by chance, the next seed is tried.
    """
    first, renamed = 0, []
    while True:
        found = items.select("item", _hash(F.col("item"), first, renamed).alias("h"))
        twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.collect_list("item").alias("i")).where("n > 1")
        clash = [x for r in twice.select(F.explode("i").alias("i")).limit(MOST_RENAMED + 1).collect() for x in r]
        if not clash:
            return lambda item: _hash(item, first, renamed)
        if len(clash) > MOST_RENAMED or len(renamed) > MOST_RENAMED:
            first, renamed = first + 1_000_000, []
        else:
            renamed = [*renamed, *((x, first + len(renamed) + i + 1) for i, x in enumerate(clash))]


def _hash(item: Column, seed: int, renamed: list[tuple[str, int]]) -> Column:
    plain = F.xxhash64(item, F.lit(seed))
    if not renamed:
        return plain
    # The last seed that an item was given counts.
    own = F.create_map(*[x for k, v in dict(renamed).items() for x in (F.lit(k), F.lit(v))])
    return F.when(own[item].isNotNull(), F.xxhash64(item, own[item], F.lit("again"))).otherwise(plain)


def _row_pairs(hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unordered pairs within each row, smaller hash first, in blocks of bounded size."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    # The i-th item of a row pairs with the one 1, 2, ... places on; who has none at one distance has none further on.
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, shift, at = 0, 1, np.arange(len(h))
    while True:
        at = at[at + shift < len(h)]
        at = at[r[at + shift] == r[at]]
        if not len(at):
            break
        held.append((h[at], h[at + shift]))
        size += len(at)
        if size > _BLOCK_PAIRS:
            yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held, size = [], 0
        shift += 1
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])


def _count(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
    code = codes[: len(x)].astype(np.int64) * len(names) + codes[len(x):]
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(code)]) if n is None else np.add.reduceat(n[order], starts) if len(starts) else n[:0]
    first = code[starts]
    return names[first // len(names)], names[first % len(names)], counts


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            x, y, n = _count(*(np.concatenate(c) for c in zip(*held, strict=True)))
            for i in range(0, len(x), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].astype(np.int64)) for c in (x, y, n)], names=["x", "y", "together"])

    for batch in batches:
        column = batch.column("hashes")
        rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        hashes = column.flatten().to_numpy(zero_copy_only=False)
        for x, y in _row_pairs(hashes, rows):
            held.append(_count(x, y))
            size += len(held[-1][0])
        if size > _BLOCK_PAIRS:
            yield from flush()
            held.clear()
            size = 0
    yield from flush()


def _wide_units(hashes: DataFrame, wide: int) -> DataFrame:
    """hashes of rows with more than `wide` items as units of two blocks of at most `wide`: left with right, or
    a block with itself (right null). Units of a row go to different tasks."""
    blocks = F.transform(F.sequence(F.lit(1), F.size("hashes"), F.lit(wide)), lambda i: F.slice("hashes", i, wide))
    split = hashes.where(F.size("hashes") > wide).select(F.array_distinct("hashes").alias("hashes")).select(blocks.alias("b"), F.xxhash64("hashes").alias("row"))
    left = split.select("b", "row", F.posexplode("b").alias("i", "left"))
    units = left.select("row", "i", "left", F.posexplode(F.slice("b", F.col("i") + 1, F.size("b"))).alias("j", "right"))
    units = units.select("row", "i", "j", "left", F.when(F.col("j") > 0, F.col("right")).alias("right"))
    return units.repartition("row", "i", "j").select("left", "right")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the left block, or between the two."""
    for batch in batches:
        for left, right in zip(batch["left"], batch["right"], strict=True):
            a = left.values.to_numpy()
            if right.is_valid:
                b = right.values.to_numpy()
                x, y = np.repeat(a, len(b)), np.tile(b, len(a))
            else:
                i, j = np.triu_indices(len(a), 1)
                x, y = a[i], a[j]
            n = np.ones(len(x), np.int64)
            for at in range(0, len(x), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[part], y[part])), pa.array(np.maximum(x[part], y[part])), pa.array(n[part])], names=["x", "y", "together"])


def pair_counts(records: DataFrame, items: DataFrame, least: int, wide: int = WIDE) -> DataFrame:
    """item_a, item_b, together, n_a, n_b of every pair that stands together in at least `least` rows.

    Items are distinct within a row and pairs are ordered by bytes, so (x, y) and (y, x) are one. Each
    task adds up its pairs before they move, as two hashes and a count; items are named again at the
    end. A row of more than `wide` items is divided into blocks, whose pairs are formed by different tasks.
    Rows with null or empty tags, tags with null values and single tags give no pairs.
    """
    hashed = item_hash(items)
    named = F.filter(F.map_entries("tags"), lambda e: e["value"].isNotNull())
    hashes = records.select(F.transform(named, lambda e: hashed(F.concat(e["key"], F.lit("="), e["value"]))).alias("hashes"))
    counted_pairs = hashes.where((F.size("hashes") > 1) & (F.size("hashes") <= wide)).mapInArrow(_emit, _PAIRS)
    widest = records.agg(F.max(F.size("tags"))).first()[0]
    if widest is not None and widest > wide:
        counted_pairs = counted_pairs.union(_wide_units(hashes, wide).mapInArrow(_across, _PAIRS))
    found = counted_pairs.groupBy("x", "y").agg(F.sum("together").alias("together")).where(F.col("together") >= least)
    by_hash = items.where(F.col("n") >= least).select(hashed(F.col("item")).alias("h"), "item", "n")
    one, two = by_hash.toDF("x", "item_x", "n_x"), by_hash.toDF("y", "item_y", "n_y")
    rows = found.join(one, "x").join(two, "y")
    first = F.col("item_x") < F.col("item_y")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return rows.select(
        pick("item_x", "item_y").alias("item_a"), pick("item_y", "item_x").alias("item_b"), "together", pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"))


def with_association(pairs: DataFrame, total: int) -> DataFrame:
    """Adds lift, how many times more often than by chance the items stand together, and pmi, its log2."""
    lift = F.col("together").cast("double") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
    return pairs.withColumn("lift", lift).withColumn("pmi", F.log2("lift"))


def associated(pairs: DataFrame, total: int, lift: int) -> DataFrame:
    """Pairs with at least the given lift, compared in whole numbers."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(wide("together") * F.lit(total).cast("decimal(19,0)") >= F.lit(lift) * wide("n_a") * wide("n_b"))
