"""Work on keys of very uneven frequency: fragment and replicate by estimated load.

The load of the frequent keys is estimated by a mergeable sketch over all rows. Keys too large for one
task are split into shards in proportion to their load, all large shards are packed onto tasks, largest
first, and the many small keys are spread by hash. The matching side of a join is copied only to the
shards of the keys that were split. The plan changes where rows are processed, never which.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys above 1 / FINE of a task's fair share are placed one by one; there are at most FINE * tasks.
FINE = 8
#: Upper bound of the keys that are placed one by one, and so of what is sent to every task.
MOST_PLACED = 50_000
TASK = "__task"


@dataclass(frozen=True)
class BalancePlan:
    """tasks: number of tasks; placed: the tasks of each large key, one entry for each of its shards."""

    tasks: int
    placed: dict[str, tuple[int, ...]]


def estimate_loads(df: DataFrame, key: Column, tasks: int) -> tuple[int, list[tuple[str, int]]]:
    """(rows, [(key, estimated rows)]) of the keys that may exceed 1 / FINE of a task's share.

    One aggregate over all rows with a bounded sketch; null keys count as rows only.
    """
    most = min(FINE * tasks, MOST_PLACED)
    tracked = df.select(key.alias("k"))
    row = tracked.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {most}, {max(10_000, 4 * most)})").alias("top")).first()
    return row["n"], [(x["item"], x["count"]) for x in row["top"] or [] if x["item"] is not None]


def summarised(make: Callable[[pa.RecordBatch], Iterator[tuple[str, pa.Array, np.ndarray]]], counters: int):
    """A mapInArrow function: a bounded summary of how often each (field, term) of make occurs in a task's rows.

    Gives field, term, n. Where a task meets more than `counters` terms, all counts are lowered by that of the
    first one beyond and the others forgotten (the mergeable frequent-items summary): a term's count is too
    small by at most rows / counters, and none is too large. A row with a null field bears the number of entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        total = 0
        for batch in batches:
            new = []
            for field, terms, _ in make(batch):
                counts = pc.value_counts(terms.drop_null())
                words, n = counts.field("values"), counts.field("counts")
                total += len(terms) - terms.null_count
                new.append(pa.table({"field": pa.array([field] * len(words), pa.string()), "term": words, "n": n}))
            joined = pa.concat_tables([*([held] if held is not None else []), *new]).group_by(["field", "term"]).aggregate([("n", "sum")])
            held = joined.rename_columns(["field", "term", "n"])
            if len(held) > counters:
                n = held.column("n").to_numpy()
                floor = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
                kept = n > floor
                held = held.filter(pa.array(kept)).set_column(2, "n", pa.array(n[kept] - floor))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([total], pa.int64())], names=["field", "term", "n"])
        if held is not None and len(held):
            yield from held.combine_chunks().to_batches()

    return run


def plan_for_items(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[tuple[str, pa.Array, np.ndarray]]], tasks: int | None = None) -> BalancePlan:
    """The plan of items, of which a row holds several: keys are field and term, see item_key; loads are the
    rows that hold them. Each task passes on a bounded summary, so neither rows nor items move."""
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(FINE * tasks, MOST_PLACED)
    parts = df.mapInArrow(summarised(make, max(10_000, 4 * most)), "field string, term string, n bigint").groupBy("field", "term").agg(F.sum("n").alias("n"))
    top = parts.orderBy(F.col("field").isNotNull(), F.desc("n"), "field", "term").limit(most + 1).collect()
    total = next((r.n for r in top if r.field is None), 0)
    return pack(total, [(f"{r.field}\x01{r.term}", r.n) for r in top if r.field is not None], tasks)


def item_key() -> Column:
    return F.concat_ws("\x01", "field", "term")


def sharded(make: Callable[[pa.RecordBatch], Iterator[tuple[str, pa.Array, np.ndarray]]], plan: BalancePlan) -> Callable[[pa.RecordBatch], Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]]:
    """make with the shard of each entry: rows that hold a split item are dealt out to its shards in turn, by
    their place in the task; other items have the one shard 0."""
    split: dict[str, dict[str, int]] = defaultdict(dict)
    for key, tasks in plan.placed.items():
        if len(tasks) > 1:
            field, term = key.split("\x01", 1)
            split[field][term] = len(tasks)
    known = {field: (pa.array(list(terms), pa.string()), np.array([*terms.values(), 1], np.int64)) for field, terms in split.items()}
    nothing = pa.array([], pa.string()), np.array([1], np.int64)

    def run(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
        for field, terms, rows in make(batch):
            names, shards = known.get(field, nothing)
            # Terms that aren't split are at -1, where the number of shards is 1.
            at = pc.fill_null(pc.index_in(terms, value_set=names), -1).to_numpy(zero_copy_only=False)
            yield field, terms, rows, rows % shards[at]

    return run


def pack(total: int, loads: list[tuple[str, int]], tasks: int) -> BalancePlan:
    """Split keys above a fair share into proportionate shards and place large shards, largest first, on
    the task with the least load so far. Ties go to the lower task, so equal input gives equal plans."""
    share = max(1.0, total / tasks)
    large = sorted(((k, n) for k, n in loads if n > share / FINE), key=lambda x: (-x[1], x[0]))
    rest = max(0, total - sum(n for _, n in large)) / tasks
    shards = sorted(((n / (parts := max(1, min(tasks, -int(-n // share)))), k, parts) for k, n in large), key=lambda x: (-x[0], x[1]))
    heap = [(rest, t) for t in range(tasks)]
    placed = {}
    for load, key, parts in shards:
        taken = [heapq.heappop(heap) for _ in range(parts)]
        placed[key] = tuple(t for _, t in taken)
        for at, t in taken:
            heapq.heappush(heap, (at + load, t))
    return BalancePlan(tasks, placed)


def plan_for(df: DataFrame, key: Column, tasks: int | None = None) -> BalancePlan:
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, loads = estimate_loads(df, key, tasks)
    return pack(total, loads, tasks)


def _placements(df: DataFrame, plan: BalancePlan) -> DataFrame:
    """At most MOST_PLACED rows, so it may be broadcast."""
    rows = [(k, list(t)) for k, t in plan.placed.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "__key string, __tasks array<int>"))


def fragment(df: DataFrame, key: Column, spread: list[Column], plan: BalancePlan, shard: Column | None = None) -> DataFrame:
    """Adds the task of each row. Rows of a split key go to one of its shards by the hash of spread, so
    that rows equal in spread stay together, or to the one numbered shard. Null keys are spread like a split
    key over all tasks."""
    keyed = df.withColumn("__k", key)
    placed = keyed.join(_placements(df, plan), F.col("__k") == F.col("__key"), "left")
    by_row = F.xxhash64(*spread) if shard is None else shard.cast("bigint")
    chosen = F.get("__tasks", F.pmod(by_row, F.size("__tasks").cast("bigint")).cast("int"))
    tail = F.when(F.col("__k").isNull(), F.pmod(by_row, F.lit(plan.tasks).cast("bigint"))).otherwise(F.pmod(F.xxhash64("__k"), F.lit(plan.tasks).cast("bigint")))
    return placed.withColumn(TASK, F.coalesce(chosen, tail.cast("int"))).drop("__k", "__key", "__tasks")


def replicate(df: DataFrame, key: Column, plan: BalancePlan) -> DataFrame:
    """One copy of each row for every shard of its key; keys that aren't split get one."""
    keyed = df.where(key.isNotNull()).withColumn("__k", key)
    placed = keyed.join(_placements(df, plan), F.col("__k") == F.col("__key"), "left")
    tail = F.array(F.pmod(F.xxhash64("__k"), F.lit(plan.tasks).cast("bigint")).cast("int"))
    return placed.withColumn(TASK, F.explode(F.coalesce("__tasks", tail))).drop("__k", "__key", "__tasks")


def settled(df: DataFrame, plan: BalancePlan) -> DataFrame:
    """Move every row to its task; aggregates and joins on the task need no further exchange."""
    return df.repartitionById(plan.tasks, F.col(TASK))


def balanced_aggregate(df: DataFrame, keys: list[str], key: Column, spread: list[Column], partial: list[Column], final: list[Column], plan: BalancePlan) -> DataFrame:
    """Group by keys in two steps: within the shards, then over the few rows that the shards give.

    key: the string that plan was made for, a function of keys. partial: aggregates of the rows,
    final: aggregates of those. Null keys form a group. An empty df gives no rows.
    """
    rows = settled(fragment(df, key, spread, plan), plan)
    return rows.groupBy(TASK, *keys).agg(*partial).drop(TASK).groupBy(*keys).agg(*final)


def balanced_join(facts: DataFrame, other: DataFrame, keys: list[str], key: Column, spread: list[Column], plan: BalancePlan, how: str = "inner", shard: Column | None = None) -> DataFrame:
    """facts joined with other on keys (how: inner, left, left_semi or left_anti); both are moved by the
    plan. The result keeps the task column, so that an aggregate can follow without an exchange."""
    left = settled(fragment(facts, key, spread, plan, shard), plan)
    right = settled(replicate(other, key, plan), plan)
    return left.hint("merge").join(right, [TASK, *keys], how)
