"""Samples, sketches, terms, pairs and the filter of earlier keys, against brute force."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofind.llm import distinct, pairs, queries, sampling, seen, terms
from chronofind.llm.perfecthash import PerfectIndex

RECORD = "record_id bigint, xx_hash bigint, metric string, tags map<string,string>, key string, n bigint"


# Sample


def arrive(spark, rows):
    return spark.createDataFrame(rows, "key bigint, order bigint, chosen string")


def decided(df):
    return {r.key: (r.priority, r.step, r.chosen) for r in df.collect()}


@pytest.fixture
def short_steps(monkeypatch):
    monkeypatch.setattr(sampling, "FIRST", 256)


def _replayed(rows, rate, few=256):
    """key -> chosen of rows (key, order), by steps in plain Python."""
    import hashlib

    first, step_of = {}, lambda o: 0 if o < few else o.bit_length() - few.bit_length() + 1
    for k, o in rows:
        if k is not None and o is not None:
            first[k] = min(o, first.get(k, o))
    priority = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) for k in first}
    last = step_of(max(first.values(), default=0))
    last = max([last, *(step_of(o) for k, o in rows if k is not None and o is not None)])
    out, total = {}, 0
    for step in range(last + 1):
        mine = sorted((priority[k], k) for k in first if step_of(first[k]) == step)
        total += len(mine)
        n = sum(p < int(rate * 2**60) for p, _ in mine)
        if step < last:
            n = max(n, math.ceil(total * rate) - sum(out.values()))
        out |= {k: i < n for i, (_, k) in enumerate(mine)}
    return out


def test_sample_grows_without_losing_keys(spark, tmp_path, short_steps):
    rng, rate = random.Random(2), Fraction(1, 10)
    values = [rng.randrange(-10**15, 10**15) for _ in range(1500)]
    rows = [(rng.choice(values[: 300 + i]) if i % 50 else None, i, "x") for i in range(3000)] + [(77, None, "x")]
    before = {}
    for n in (0, 100, 255, 257, 1000, 1024, 1025, 2900, 3001):
        now = decided(sampling.kept(spark, f"file://{tmp_path}/ledger", arrive(spark, rows[:n]).repartition(3), rate))
        assert {k: c for k, (_, _, c) in now.items()} == _replayed([r[:2] for r in rows[:n]], rate), n
        assert all(now[k][2] for k, (_, _, c) in before.items() if c)
        before = now
    assert decided(sampling.kept(spark, f"file://{tmp_path}/other", arrive(spark, rows[::-1]), rate)) == before
    stored, closed = sampling.stored(spark, f"file://{tmp_path}/ledger")
    assert closed == 4 and {s for _, s, _ in decided(stored).values()} == {0, 1, 2, 3}
    # What comes late, under a number of a closed step, joins the open one and moves no decision.
    late = decided(sampling.kept(spark, f"file://{tmp_path}/ledger", arrive(spark, [*rows, *[(10**16 + i, i, "x") for i in range(300)]]), rate))
    assert {k: late[k] for k in before} == before and {late[10**16 + i][1] for i in range(300)} == {4}


@pytest.mark.parametrize(("rate", "n", "want"), [(Fraction(0), 5, 0), (Fraction(1), 5, 5), (Fraction(1, 3), 0, 0)])
def test_sample_edges(spark, rate, n, want):
    got, still_open = sampling.grow(sampling.empty_ledger(spark), arrive(spark, [(i, i, "") for i in range(n)]), rate)
    assert len(decided(got)) == n and sum(c for _, _, c in decided(got).values()) == want and still_open == 0


def test_thresholds_go_through_every_digit(spark):
    rows = lambda step, n, priority: spark.range(n).select(F.lit(step).alias("step"), priority.cast("bigint").alias("priority"), F.col("id").alias("key"))
    keys = rows(1, 20_000, F.col("id")).union(rows(2, 9_000, F.lit(5))).union(rows(3, 50, F.col("id") * (1 << 50)))
    assert sampling._thresholds(keys, {1: 7_777, 2: 8_000, 3: 50}) == {1: (7_776, 7_776), 2: (5, 7_999), 3: (49 << 50, 49)}
    assert sampling._thresholds(keys, {2: 3}) == {2: (5, 2)} and sampling._thresholds(keys, {}) == {}


def test_steps_are_fixed_ranges(spark):
    first = sampling.FIRST
    orders = [0, 1, first - 1, first, 2 * first - 1, 2 * first, 4 * first, 2**50, -3]
    got = [r[0] for r in spark.createDataFrame([(o,) for o in orders], "o bigint").select(sampling.step_of(F.col("o"))).collect()]
    assert got == [0, 0, 0, 1, 1, 2, 3, 37, 0]


def test_sample_takes_all_rows_of_a_key(spark):
    rows = spark.createDataFrame([(i, i % 40, "m", {}, "", 0) for i in range(400)] + [(999, None, "m", {}, "", 0)], RECORD)
    ledger, _ = sampling.grow(sampling.empty_ledger(spark), rows.select(F.col("xx_hash").alias("key"), F.col("record_id").alias("order")), Fraction(1, 4))
    got = Counter(r.xx_hash for r in sampling.sample(rows, "xx_hash", ledger).collect())
    assert set(got) == {k for k, (_, _, c) in decided(ledger).items() if c} and set(got.values()) == {10}


def test_registered_growth_loses_nothing(spark, tmp_path, short_steps):
    rng = random.Random(5)
    rows = [(i, rng.randrange(1200) if i % 50 else None) for i in range(1, 2000)]
    spark.createDataFrame(rows, "record_id bigint, xx_hash bigint").write.parquet(f"{tmp_path}/records.parquet")
    got = queries.queries()["p1_kept"](spark, str(tmp_path)).orderBy("percent").collect()
    assert [r.percent for r in got] == list(queries.GROWTH) and all(r.n_lost == 0 for r in got)
    assert {r.xx_hash for r in queries.sampled_records(spark, f"{tmp_path}/").collect()} == {k for k, c in _replayed([(k, o) for o, k in rows], queries.RATE).items() if c}


def test_a_closed_step_is_appended_once(spark, tmp_path):
    new = spark.createDataFrame([(1, 2, 0, True)], sampling.LEDGER)
    assert sampling.append(new, f"file://{tmp_path}/ledger", 0) and not sampling.append(new.union(new), f"file://{tmp_path}/ledger", 0)
    assert sampling.stored(spark, f"file://{tmp_path}/ledger")[0].count() == 1


# Sketches


def test_small_groups_are_exact_and_merge(spark):
    rows = [("g" if i % 3 else None, i % 50, None if i % 11 == 0 else i % 70) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, day int, v int")
    fine = distinct.sketch(df, ["g", "day"], F.col("v"))
    got = {(r.g, r.day): r.estimate for r in distinct.with_estimates(fine).collect()}
    want = defaultdict(set)
    for g, d, v in rows:
        if v is not None:
            want[g, d].add(v)
    assert got == {k: len(v) for k, v in want.items()}
    coarse = {r.g: list(r.hashes) for r in distinct.merge(fine, ["g"]).collect()}
    assert coarse == {r.g: list(r.hashes) for r in distinct.sketch(df, ["g"], F.col("v")).collect()}
    assert distinct.sketch(df.limit(0), ["g"], F.col("v")).count() == 0
    clash = df.select(F.col("g").alias("h"), F.col("day").alias("r"), "v")
    assert {(r.h, r.r): r.estimate for r in distinct.with_estimates(distinct.sketch(clash, ["h", "r"], F.col("v"))).collect()} == got


def test_large_counts_keep_their_bounds(spark):
    n = 60_000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), (F.col("id") * 0).alias("h")).union(spark.range(5000).select(F.lit(0).alias("g"), F.lit(7).alias("v"), F.lit(0)))
    got = {r.g: r for r in distinct.with_estimates(distinct.sketch(df, ["g"], F.col("v"))).collect()}
    for g, true in ((0, n // 2 + 1), (1, n // 2)):
        assert len(got[g].hashes) == distinct.K and got[g].lower <= true <= got[g].upper
    parts = [distinct.sketch(df.where(F.col("v") % 3 == i), ["g"], F.col("v")) for i in range(3)]
    merged = distinct.merge(parts[0].union(parts[1]).union(parts[2]), ["g"])
    assert {r.g: list(r.hashes) for r in merged.collect()} == {g: list(r.hashes) for g, r in got.items()}


def test_bounds_hold_about_as_often_as_stated(spark):
    rng, k, hits, runs = np.random.default_rng(1), distinct.K, 0, 200
    for _ in range(runs):
        last = np.sort(rng.random(8_000))[k - 1]
        estimate, error = (k - 1) / last, distinct.Z / math.sqrt(k - 2)
        hits += estimate / (1 + error) <= 8_000 <= estimate / (1 - error)
    assert hits >= 0.9 * runs


def test_set_algebra(spark):
    def sets(a, b):
        rows = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "s string, v bigint")
        got = distinct.sketch(rows, ["s"], F.col("v"))
        pair = got.where("s = 'a'").select(F.lit(1).alias("i"), F.col("hashes").alias("x")).join(got.where("s = 'b'").select(F.lit(1).alias("i"), F.col("hashes").alias("y")), "i")
        return distinct.combined(pair, F.col("x"), F.col("y")).first()

    r = sets(range(300), range(200, 600))
    assert (r.n_union, r.n_intersection, r.n_only_a, r.n_only_b) == (600, 100, 200, 300) and r.union_lower == r.union_upper == 600
    r = sets(range(20_000), range(12_000, 30_000))
    for name, true in (("union", 30_000), ("intersection", 8_000), ("only_a", 12_000), ("only_b", 10_000)):
        assert r[f"{name}_lower"] < r[f"{name}_upper"] and r[f"{name}_lower"] <= true <= r[f"{name}_upper"] and abs(r[f"n_{name}"] - true) < 0.25 * true


def test_rare_overlaps_keep_their_bounds(spark):
    rng, k, trials = np.random.default_rng(7), 200, 200
    rows = []
    for t in range(trials):
        a, b = rng.integers(0, 1 << 60, (2, 4_000))
        both = rng.integers(0, 1 << 60, 20)
        rows.append((t, *(np.sort(np.r_[x, both])[:k].tolist() for x in (a, b))))
    pairs_ = spark.createDataFrame(rows, "t int, a array<bigint>, b array<bigint>")
    got = distinct.combined(pairs_, F.col("a"), F.col("b"), k).collect()
    for name, true in (("union", 8_020), ("intersection", 20), ("only_a", 4_000), ("only_b", 4_000)):
        assert sum(r[f"{name}_lower"] <= true <= r[f"{name}_upper"] for r in got) >= 0.93 * trials, name
    assert all(r.intersection_upper > 0 for r in got) and any(r.n_intersection == 0 for r in got)


@pytest.mark.parametrize("k", [3, 50, 5_000])
def test_sketches_of_any_size_and_bounded_tasks(spark, monkeypatch, k):
    monkeypatch.setattr(distinct, "_HELD", 700)
    df = spark.range(6_000).select((F.col("id") % 3).alias("a b"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string")).alias("hashes"), (F.col("id") % 4_001).alias("v"))
    got = {(r["a b"], r["hashes"]): r["n"] for r in distinct.sketch(df.repartition(3), ["a b", "hashes"], F.col("v"), k).toDF("a b", "hashes", "n").collect()}
    want = defaultdict(set)
    for r in df.select("a b", "hashes", "v", distinct.hashed(F.col("v")).alias("h")).collect():
        want[r["a b"], r["hashes"]].add(r.h)
    assert got == {g: sorted(s)[:k] for g, s in want.items()}
    everything = distinct.merge(distinct.sketch(df, ["a b"], F.col("v"), k), [], k).first()
    assert list(everything.hashes) == sorted(set.union(*want.values()))[:k]


# Terms and pairs


def records(spark, n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tags = None if i % 37 == 0 else {k: rng.choice(["x", "y", "é", "", None]) for k in rng.sample(["a", "b", "c", "a=x", "ü"], rng.randint(0, 5))}
        rows.append((i, i, rng.choice(["m", "n", None, ""]), tags, "k", 1))
    return rows, spark.createDataFrame(rows, RECORD)


def test_terms_against_sets(spark):
    rows, df = records(spark)
    occurrences, holders = Counter(), defaultdict(set)
    for i, _, m, tags, *_ in rows:
        for field, term in [("metric", m), *[("tag_key", k) for k in tags or {}], *[("tag_value", v) for v in (tags or {}).values()]]:
            if term is not None:
                occurrences[field, term] += 1
                holders[field, term].add(i)
    got = {(r.field, r.term): (r.occurrences, r.n_rows, r.mark) for r in terms.marked(terms.frequencies(df.repartition(5)), len(rows)).collect()}
    mark = lambda n: "rare" if n <= 2 else "common" if n * 100 > 30 * len(rows) else None
    assert got == {k: (occurrences[k], len(s), mark(len(s))) for k, s in holders.items()}
    assert terms.frequencies(df.limit(0)).count() == 0


def test_pairs_against_all_pairs(spark):
    rows, df = records(spark)
    item, both = Counter(), Counter()
    for _, _, _, tags, *_ in rows:
        items = sorted({f"{k}={v}" for k, v in (tags or {}).items() if v is not None}, key=str.encode)
        item.update(items)
        both.update(combinations(items, 2))
    counted = pairs.pair_counts(df.repartition(3), pairs.marginals(df), 2)
    got = {(r.item_a, r.item_b): (r.together, r.n_a, r.n_b) for r in counted.collect()}
    assert got == {p: (t, item[p[0]], item[p[1]]) for p, t in both.items() if t >= 2}
    strong = {(r.item_a, r.item_b) for r in pairs.associated(counted, len(rows), 2).collect()}
    assert strong == {p for p, t in both.items() if t >= 2 and t * len(rows) >= 2 * item[p[0]] * item[p[1]]}
    r = pairs.with_association(counted, len(rows)).first()
    assert math.isclose(2**r.pmi, r.lift) and math.isclose(r.lift, r.together * len(rows) / r.n_a / r.n_b)
    assert pairs.pair_counts(df.limit(0), pairs.marginals(df.limit(0)), 1).count() == 0


def test_registered_report_holds_every_pair(spark, tmp_path):
    rows, df = records(spark)
    df.write.parquet(f"{tmp_path}/records.parquet")
    both = Counter(p for _, _, _, tags, *_ in rows for p in combinations(sorted({f"{k}={v}" for k, v in (tags or {}).items() if v is not None}, key=str.encode), 2))
    got = {(r.item_a, r.item_b): r.together for r in queries.queries()["p5_pairs"](spark, str(tmp_path)).collect()}
    assert got == both and min(both.values()) < queries.TOGETHER


def test_wide_rows_are_divided(spark):
    df = spark.createDataFrame([(0, 0, "m", {f"k{i}": "v" for i in range(700)}, "", 0)] * 2 + [(1, 1, "m", {"k1": "v", "k2": "v", "k3": None}, "", 0)], RECORD)
    for wide in (1_024, 64, 700, 699):
        got = pairs.pair_counts(df, pairs.marginals(df), 2, wide)
        assert got.count() == 700 * 699 // 2
        assert [tuple(r) for r in got.where("item_a = 'k1=v' and item_b = 'k2=v'").collect()] == [("k1=v", "k2=v", 3, 3, 3)]


def test_colliding_items_get_hashes_of_their_own(spark, monkeypatch):
    items = spark.createDataFrame([(f"k{i}=v", 1) for i in range(300)], "item string, n bigint")
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(5_000 if len(c) < 3 else 2**40)))
    assert items.select(F.xxhash64("item", F.lit(0)).alias("h")).distinct().count() < 300
    hashed = pairs.item_hash(items)
    assert items.select(hashed(F.col("item")).alias("h")).distinct().count() == 300


# Earlier keys


def test_perfect_index_is_minimal_and_exact_on_its_keys():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys_ = np.unique(rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64))
        index = PerfectIndex.from_bytes(PerfectIndex.build(keys_).to_bytes())
        assert sorted(index.slots(keys_)) == list(range(len(keys_))) and index.contains(keys_).all()
        other = np.setdiff1d(rng.integers(-2**63, 2**63 - 1, 100_000, dtype=np.int64), keys_)
        assert index.contains(other).sum() <= 1
        assert len(index.to_bytes()) < 9 * n + 2000
    dense = PerfectIndex.build(np.arange(-5000, 5000))
    assert dense.contains(np.arange(-5000, 5000)).all() and not dense.contains(np.arange(5000, 20_000)).any()
    with pytest.raises(ValueError, match="distinct"):
        PerfectIndex.build(np.array([1, 1]))


@pytest.mark.parametrize("parts", [1, 3])
def test_seen_before(spark, parts):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 7, 7, 7, *range(120)]), "m", {}, "part", 1) for i in range(600)]
    earlier = [rng.randrange(200) for _ in range(60)] + [None]
    df, stored = spark.createDataFrame(rows, RECORD).repartition(4), spark.createDataFrame([(k,) for k in earlier], "key bigint")
    known, want = set(earlier), set()
    for i, k, *_ in rows:
        if k is not None:
            if k in known:
                want.add(i)
            known.add(k)
    new = seen.firsts(df, "xx_hash", "record_id", stored, parts, [(0, 250), (250, 251), (251, 600)])
    assert {r.record_id for r in seen.seen_before(df, new, "xx_hash", "record_id").collect()} == want
    none = seen.firsts(df, "xx_hash", "record_id", stored.limit(0), parts, [(0, 600)])
    assert none.count() == len({k for _, k, *_ in rows if k is not None})
    assert seen.firsts(df.limit(0), "xx_hash", "record_id", stored, parts, [(0, 1)]).count() == 0
    rate = seen.error_rate(seen.first_of(df, "xx_hash", "record_id"), seen.seal(stored, parts), stored, parts).first()
    probed = {k for _, k, *_ in rows if k is not None}
    assert (rate.n_probed, rate.n_absent, rate.n_wrong, rate.rate) == (len(probed), len(probed - set(earlier)), 0, 0.0) and 0 < rate.upper < 0.1
    for generations in (1, 2):
        merged = seen.firsts(df, "xx_hash", "record_id", stored, parts, [(i, i + 100) for i in range(0, 600, 100)], generations)
        assert sorted(r.first for r in merged.collect()) == sorted(r.first for r in new.collect())


def test_error_rate_covers_the_indexes_of_earlier_batches(spark, tmp_path, monkeypatch):
    rows = [(i, i % 150 if i < 600 else 9_000 + i % 2) for i in range(800)] + [(800, None)]
    spark.createDataFrame(rows, "record_id bigint, xx_hash bigint").write.parquet(f"{tmp_path}/records.parquet")
    spark.createDataFrame([(k,) for k in range(40)], "xx_hash bigint").write.parquet(f"{tmp_path}/tags_and_timestamp.parquet")
    error = lambda: tuple(queries.queries()["p6_error"](spark, str(tmp_path)).first())[:4]
    assert error() == (152, 112, 0, 0.0)
    real, calls = seen.probe, []

    def claims_9000(batch, index, parts):
        calls.append(1)
        return real(batch, index, parts).withColumn("stored", F.col("stored") | ((F.col("key") == 9_000) & F.lit(len(calls) > 1)))

    monkeypatch.setattr(seen, "probe", claims_9000)
    assert error() == (152, 112, 1, 1 / 112)
