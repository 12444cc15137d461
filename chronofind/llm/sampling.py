"""A reproducible sample that stays as data grow: a persisted ledger of keys and decisions.

Records arrive in ascending order of their numbers. Steps are fixed ranges of these numbers, [0, FIRST),
[FIRST, 2 FIRST), [2 FIRST, 4 FIRST) and so on, so a step never depends on what comes later. A step is
closed once a record of a later one is there. Within a step a key is chosen at once if its priority is below
the rate; when the step closes, the quota is filled up with the unseen keys of lowest priority, if the
sample is short of it. Both kinds of decision stand: a chosen key stays chosen whatever arrives, and the
ledger of closed steps, which is stored, is what a replay of the same records would give again.
"""

from __future__ import annotations

import hashlib
import uuid
from fractions import Fraction
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofind.session import exists, filesystem, materialise, shared_dir

LEDGER = T.StructType([
    T.StructField("key", T.LongType()),
    T.StructField("priority", T.LongType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("chosen", T.BooleanType()),
])
#: Records of the first step; each later one is as long as all before it.
FIRST = 1 << 14
_BITS, _DIGIT = 60, 12
#: So many priorities of a step at most are looked at on the driver to find its exact threshold.
_FEW = 4_096


def priority(key: Column) -> Column:
    """The first 60 bits of the key's md5, the same on every engine and partitioning."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint")


def step_of(order: Column) -> Column:
    """The step in which a record of this number arrives; numbers below 0 count as 0."""
    return F.when(order < FIRST, F.lit(0)).otherwise(F.length(F.bin(F.greatest(order, F.lit(0)).cast("bigint"))) - (FIRST.bit_length() - 1)).cast("int")


def _thresholds(keys: DataFrame, wanted: dict[int, int]) -> dict[int, tuple[int, int]]:
    """step -> the (priority, key) of its wanted-th smallest row of keys (step, priority, key).

    All steps at once: the driver sees 2 ** _DIGIT counts of a step and round, each of which narrows the
    step's range of priorities by as many times, and at most _FEW rows of each at the end; ties in priority
    are ordered by key.
    """
    out: dict[int, tuple[int, int]] = {}
    state = {step: (0, n) for step, n in wanted.items()}
    shift = _BITS
    while state:
        shift -= _DIGIT
        inside = reduce(or_, [(F.col("step") == s) & F.col("priority").between(low, low + (1 << shift + _DIGIT) - 1) for s, (low, _) in state.items()])
        digits = keys.where(inside).groupBy("step", F.expr(f"cast(shiftright(priority, {shift}) as bigint)").alias("d")).count().collect()
        small: dict[int, tuple[int, int]] = {}
        for step, (_, left) in list(state.items()):
            for digit, n in sorted((r.d, r["count"]) for r in digits if r.step == step):
                if n >= left:
                    break
                left -= n
            state[step] = digit << shift, left
            if n <= _FEW:
                small[step] = state.pop(step)
            elif shift == 0:
                low, left = state.pop(step)
                last = keys.where((F.col("step") == step) & (F.col("priority") == low)).orderBy("key").limit(left)
                out[step] = low, last.orderBy(F.desc("key")).first()["key"]
        if small:
            inside = reduce(or_, [(F.col("step") == s) & F.col("priority").between(low, low + (1 << shift) - 1) for s, (low, _) in small.items()])
            rows = sorted(map(tuple, keys.where(inside).select("step", "priority", "key").collect()))
            for step, (_, left) in small.items():
                out[step] = [r[1:] for r in rows if r[0] == step][left - 1]
    return out


def limit_of(rate: Fraction) -> int:
    """Keys of priorities below this are chosen at once."""
    return (rate.numerator << _BITS) // rate.denominator


def grow(ledger: DataFrame, arrivals: DataFrame, rate: Fraction, closed: int = 0) -> tuple[DataFrame, int]:
    """(ledger rows of the keys that the ledger doesn't hold yet, first step that is still open).

    ledger: LEDGER, all rows of the steps below `closed`; arrivals: columns key and order, the record's number, with
    repeats and nulls as they come; rows without key or number are left out. Earlier keys keep their
    decisions by the anti-join. A key arrives with its first record, but never in a step that the ledger
    closed: what comes late belongs to the next one. Rows of open steps hold what is decided so far and
    aren't to be stored. The result is written to the shared folder. No arrivals give no rows.
    """
    spark = arrivals.sparkSession
    known = {r.step: r for r in ledger.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_if("chosen").alias("chosen")).collect()}
    seen = arrivals.select("key", "order").where(F.col("key").isNotNull() & F.col("order").isNotNull())
    fresh = seen.groupBy("key").agg(F.min("order").alias("order"))
    if known:
        fresh = fresh.join(ledger.select("key"), "key", "left_anti")
    step = F.greatest(step_of(F.col("order")), F.lit(closed)).cast("int")
    fresh = materialise(fresh.select("key", priority(F.col("key")).alias("priority"), step.alias("step")), "ledger-new")
    last = seen.agg(step_of(F.max("order"))).first()[0]
    if last is None:
        return spark.createDataFrame([], LEDGER), closed
    limit = limit_of(rate)
    counts = {r.step: r for r in fresh.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("priority") < limit).alias("below")).collect()}
    total, taken, wanted = sum(r.n for r in known.values()), sum(r.chosen for r in known.values()), {}
    for s in sorted(s for s in counts if s < last):
        total += counts[s].n
        short = -(-total * rate.numerator // rate.denominator) - taken - counts[s].below
        if short > 0:
            wanted[s] = counts[s].below + short
        taken += counts[s].below + max(0, short)
    chosen = F.col("priority") < limit
    for s, (p, k) in _thresholds(fresh, wanted).items():
        chosen = chosen | ((F.col("step") == s) & ((F.col("priority") < p) | ((F.col("priority") == p) & (F.col("key") <= k))))
    return fresh.select("key", "priority", "step", chosen.alias("chosen")), max(last, closed)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def kept(spark: SparkSession, path: str, arrivals: DataFrame, rate: Fraction) -> DataFrame:
    """The whole ledger after the arrivals: what is stored at path, what was closed since, which is appended
    there, and what is open. A run that fails or is repeated decides the same."""
    ledger, closed = stored(spark, path)
    new, still_open = grow(ledger, arrivals, rate, closed)
    if still_open == closed:
        return ledger.union(new)
    mine = append(new.where(F.col("step") < still_open), path, still_open - 1)
    ledger, _ = stored(spark, path)
    return ledger.union(new.where(F.col("step") >= still_open) if mine else new.join(ledger.select("key"), "key", "left_anti").select(*LEDGER.names))


def ledger_path(spark: SparkSession, source: str) -> str:
    """The lasting folder of the ledger of a source: in spark.chronofind.ledger.dir, or where that is unset
    in the shared folder, outside of what drop_scratch deletes."""
    root = spark.conf.get("spark.chronofind.ledger.dir", None) or f"{shared_dir(spark)}/chronofind-ledgers"
    return f"{root}/{hashlib.md5(source.rstrip('/').encode()).hexdigest()}"


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(the ledger at path, its number of closed steps)."""
    if not exists(spark, path):
        return empty_ledger(spark), 0
    fs, hadoop = filesystem(spark, path)
    names = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(hadoop)) if n.isdigit())
    return (spark.read.schema(LEDGER).parquet(*(f"{path}/{n}" for n in names)), int(names[-1]) + 1) if names else (empty_ledger(spark), 0)


def append(new: DataFrame, path: str, step: int) -> bool:
    """Store the decisions of steps up to this one for good; whether they weren't there already. They become
    visible at once, by a rename, which fails where another run closed the step meanwhile: its decisions stand."""
    spark = new.sparkSession
    target = f"{path}/{step:010d}"
    if exists(spark, target):
        return False
    writing = f"{path}/_writing-{uuid.uuid4().hex}"
    new.select(*LEDGER.names).write.parquet(writing)
    fs, source = filesystem(spark, writing)
    hadoop = spark._jvm.org.apache.hadoop.fs
    plain = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(source, hadoop.Path(target), plain)
    except Exception:
        fs.delete(source, True)
        if not exists(spark, target):
            raise
        return False
    return True


def sample(rows: DataFrame, key: str, ledger: DataFrame) -> DataFrame:
    """Rows whose key the ledger chose, with the step in which it did; all rows of a key or none."""
    kept = ledger.where("chosen").select(F.col("key").alias("__key"), F.col("step").alias("sample_step"))
    return rows.join(kept, F.col(key) == F.col("__key")).drop("__key")
