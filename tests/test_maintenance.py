"""Balancing of uneven keys, and joining of small files by blocks."""

import io
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronofind.errors import SegmentError
from chronofind.functions.tokens import COUNTED, counted, metric_and_tags
from chronofind.operators import skew, smallfiles
from chronofind.sources.footers import join_files, read_footer

RECORD = "metric string, tags map<string,string>, other string"


def test_pack_splits_large_keys_and_levels_tasks():
    loads = [("a", 400), ("b", 120), ("c", 30), ("d", 30)]
    plan = skew.pack(1000, loads, 10)
    assert len(plan.placed["a"]) == 4 and len(plan.placed["b"]) == 2 and len(plan.placed["c"]) == 1
    load = Counter({t: 42 for t in range(10)})
    for k, n in loads:
        for t in plan.placed[k]:
            load[t] += n / len(plan.placed[k])
    assert max(load.values()) <= 150 and plan == skew.pack(1000, loads[::-1], 10)
    assert skew.pack(0, [], 3).placed == {}


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["warm"] * 2 + [f"k{i}" for i in range(40)] + [None]), rng.randrange(50), i) for i in range(6000)]
    return spark.createDataFrame(rows, "k string, v int, other int")


def test_balanced_aggregate_equals_plain(spark, facts):
    plan = skew.plan_for(facts, F.col("k"), 8)
    assert len(plan.placed["hot"]) > 1 or 8 * 5 // 48 < 1
    got = skew.balanced_aggregate(facts, ["k"], F.col("k"), [F.col("v")], [F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d")],
                                  [F.sum("n").alias("n"), F.sum("d").alias("d")], plan)
    want = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_balanced_join_equals_plain(spark, facts, how):
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("zz", 4), (None, 5)], "k string, w int")
    plan = skew.pack(6000, [("hot", 3000), ("warm", 900)], 8)
    got = skew.balanced_join(facts, other, ["k"], F.col("k"), [F.col("other")], plan, how).drop(skew.TASK)
    want = facts.join(other, "k", how).select(got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_split_key_spreads_over_its_tasks(spark, facts):
    plan = skew.pack(6000, [("hot", 3000)], 8)
    rows = skew.settled(skew.fragment(facts, F.col("k"), [F.col("other")], plan), plan).withColumn("p", F.spark_partition_id())
    assert rows.where(F.col("p") != F.col(skew.TASK)).count() == 0
    hot = [r["count"] for r in rows.where("k = 'hot'").groupBy("p").count().collect()]
    assert len(hot) == 4 and max(hot) < 2 * min(hot)


def test_empty_facts(spark, facts):
    plan = skew.plan_for(facts.limit(0), F.col("k"), 4)
    assert skew.balanced_aggregate(facts.limit(0), ["k"], F.col("k"), [F.col("v")], [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], plan).count() == 0


def test_items_are_counted_once_a_row(spark):
    rows = [("m", {"a": "b=c", "a=b": "c"}, "x"), (None, None, None), ("", {"": "", "n": None}, "y"), ("m", {}, "z")]
    got = spark.createDataFrame(rows, RECORD).select("metric", "tags").coalesce(1).mapInArrow(counted(metric_and_tags), COUNTED)
    assert sorted((r.field, r.term, r.occurrences, r.n_rows) for r in got.collect()) == [("metric", "", 1, 1), ("metric", "m", 2, 2), ("tag", "=", 1, 1), ("tag", "a=b=c", 2, 1)]


def _table(rows):
    schema = pa.schema([("ns", pa.string()), ("shard_id", pa.int32()), ("epoch", pa.int64()), ("timeseries_id", pa.int64()), ("metric", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))])
    return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


@pytest.mark.parametrize("options", [{}, {"use_dictionary": False, "compression": "none"}, {"compression": "zstd", "write_page_index": True}, {"row_group_size": 2}, {"data_page_version": "2.0"}])
def test_joined_files_read_back(options):
    rng, tables, contents = random.Random(3), [], []
    for n in [3, 1, 0, 700, 20, *[2] * 20]:
        tables.append(_table([(rng.choice(["a", None]), rng.randrange(9), i, rng.randrange(-9, 9), "m" * rng.randrange(40), {"k": "v" * i} if i % 3 else None) for i in range(n)]))
        sink = io.BytesIO()
        pq.write_table(tables[-1], sink, **options)
        contents.append(sink.getvalue())
    joined = join_files(contents)
    assert pq.read_table(io.BytesIO(joined.content)).equals(pa.concat_tables(tables))
    assert joined.rows == sum(map(len, tables)) and joined.blocks == sum(pq.ParquetFile(io.BytesIO(c)).num_row_groups for c in contents)
    meta = pq.ParquetFile(io.BytesIO(joined.content)).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [pq.ParquetFile(io.BytesIO(c)).metadata.row_group(i).num_rows for c in contents for i in range(pq.ParquetFile(io.BytesIO(c)).num_row_groups)]


def test_joined_file_is_read_by_spark(spark, tmp_path):
    tables = [_table([("a", 1, i, i, "m", {"k": str(i)})]) for i in range(40)]
    (tmp_path / "j.parquet").write_bytes(join_files([smallfiles.encode(t) for t in tables]).content)
    assert spark.read.parquet(str(tmp_path / "j.parquet")).where("epoch >= 38").select("tags").orderBy("epoch").collect()[0][0] == {"k": "38"}


def test_incompatible_and_damaged_files():
    a, b = io.BytesIO(), io.BytesIO()
    pq.write_table(pa.table({"x": [1]}), a)
    pq.write_table(pa.table({"x": ["1"]}), b)
    for contents in ([a.getvalue(), b.getvalue()], [b"PAR1"], [a.getvalue()[:-9] + b"PAR1"], [], [b"x" * 40]):
        with pytest.raises(SegmentError):
            join_files(contents)
    assert read_footer(a.getvalue())


FILES = "file_id bigint, ns string, shard_id int, epoch bigint, is_committed boolean, uploaded_at timestamp, extra string"
ROLLUPS = "ns string, shard_id int, merged_segments array<string>, is_committed boolean, epoch bigint"
SERIES = "file_id bigint, timeseries_id bigint, metric string, tags map<string,string>, ns string"


def _chosen(spark, files, rollups):
    from datetime import datetime

    f = spark.createDataFrame([(i, ns, sh, e, c, None if u is None else datetime(2024, 1, u), "x") for i, ns, sh, e, c, u in files], FILES)
    return smallfiles.files_to_merge(f, spark.createDataFrame(rollups, ROLLUPS))


def test_choice_of_files(spark):
    files = [(1, "a", 1, 100, True, 1), (2, "a", 1, 100, True, 2), (3, "a", 1, 100, False, 3), (4, "a", 1, 700, True, 1), (5, "a", 1, 700, True, 1), (6, "a", 2, 700, True, None),
             (7, "a", 1, 1300, True, 1), (8, "a", 1, 1900, True, 1), (9, "b", 1, 1300, True, 1), (10, None, None, None, True, 1), (11, None, None, None, True, 2), (12, "a", 1, 2500, None, 1)]
    rollups = [("a", 1, ["1300", None, "", "x"], True, 0), ("a", 1, [" 01900\n"], True, 0), ("a", 2, ["seg/a/2/700/segment.bin"], False, 0), ("b", 1, None, True, 0)]
    assert sorted(r.file_id for r in _chosen(spark, files, rollups).collect()) == [2, 4, 5, 6, 9, 11]
    assert sorted(r.file_id for r in _chosen(spark, files, [("a", 2, ["seg/a/2/700/segment.bin"], True, 0)]).collect()) == [2, 4, 5, 7, 8, 9, 11]
    assert _chosen(spark, [], []).count() == 0


def test_merge_keeps_every_series_once(spark, tmp_path):
    files = [(i, "a", 1, i * 600, True, 1) for i in range(1, 31)] + [(99, None, 2, None, True, 1)]
    rng = random.Random(5)
    rows = [(f[0], rng.randrange(6), rng.choice(["m", None]), rng.choice([{"k": "v"}, {"k": "w"}, None]), "clash") for f in files if f[0] % 7 for _ in range(8)] + [(99, None, None, None, None)] + [(1, 5, "m", None, None)] * 300 + [(12345, 1, "m", {}, "")]
    chosen, where = _chosen(spark, files, []), f"file://{tmp_path}/out"
    log = smallfiles.merge_files(chosen, spark.createDataFrame(rows, SERIES), where, target_bytes=2000, block_rows=20).collect()
    want = {(f[0], r[1]) for f in files for r in rows if r[0] == f[0]}
    assert {r.file_id for r in log} == {f[0] for f in files} and sum(r.n_rows for r in log) == len(want)
    assert {r.file_id for r in log if r.n_rows == 0} == {7, 14, 21, 28} and not next(r for r in log if r.file_id == 1).clean
    assert all(r.blocks >= 1 and r.gathered <= r.n_rows for r in log if r.n_rows) and sum(r.gathered for r in log) > 0
    got = smallfiles.merged_rows(spark, where)
    keys = [(r.epoch // 600 if r.epoch else 99, r.timeseries_id) for r in got.collect()]
    assert sorted(keys, key=str) == sorted(want, key=str)
    assert 2 < len(list((tmp_path / "out").glob("*.parquet"))) < 20
    assert smallfiles.merged_rows(spark, f"file://{tmp_path}/none").count() == 0


def test_files_of_one_place_give_each_series_once(spark, tmp_path):
    files = [(1, "a", 1, 600, True, 1), (2, "a", 1, 600, True, 1), (3, "a", 1, 600, True, None), (4, "a", 1, 1200, True, 1), (5, None, None, None, True, 1), (6, None, None, None, True, 1)]
    rows = [(f, i, "m", {"f": str(f)}, "") for f, ids in ((1, (10, 11)), (2, (11, 12, None)), (3, (12, None)), (4, (10, 12)), (5, (7,)), (6, (7,))) for i in ids]
    chosen, where = _chosen(spark, files, []), f"file://{tmp_path}/out"
    log = {r.file_id: (r.n_rows, r.clean) for r in smallfiles.merge_files(chosen, spark.createDataFrame(rows, SERIES), where).collect()}
    got = [(r.ns, r.epoch, r.timeseries_id, r.tags["f"]) for r in smallfiles.merged_rows(spark, where).collect()]
    want = [("a", 600, 10, "1"), ("a", 600, 11, "2"), ("a", 600, 12, "3"), ("a", 600, None, "3"), ("a", 1200, 10, "4"), ("a", 1200, 12, "4"), (None, None, 7, "6")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert log == {1: (1, False), 2: (1, False), 3: (2, True), 4: (2, True), 5: (0, True), 6: (1, True)}
    one = smallfiles.merge_files(chosen, spark.createDataFrame(rows, SERIES), f"file://{tmp_path}/again", block_rows=1).collect()
    assert sum(r.gathered for r in one) == 0 and sum(r.blocks for r in one) == 5
    again = [(r.ns, r.epoch, r.timeseries_id, r.tags["f"]) for r in smallfiles.merged_rows(spark, f"file://{tmp_path}/again").collect()]
    assert sorted(again, key=str) == sorted(want, key=str)


def test_compact_paths(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        for i in range(12):
            (tmp_path / "in" / folder / f"{i}.parquet").write_bytes(smallfiles.encode(_table([(folder, 1, i, i, "m", {"k": "v"})])))
    log = smallfiles.compact_paths(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    assert len(log) == 24 and len({r.part for r in log}) == 2
    assert spark.read.parquet(f"{tmp_path}/out").count() == 24 and all(r.gathered == r.n_rows == 1 for r in log)
    kept = smallfiles.compact_paths(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/kept", block_rows=1).collect()
    assert all(r.gathered == 0 for r in kept) and pq.ParquetFile(next((tmp_path / "kept").glob("*.parquet"))).metadata.num_row_groups == 12
    many = smallfiles.compact_paths(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/many", target_bytes=6_000).collect()
    assert len({r.part for r in many}) > 2 and spark.read.parquet(f"{tmp_path}/many").count() == 24
    (tmp_path / "none").mkdir()
    assert smallfiles.compact_paths(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/nothing").count() == 0


def test_placement_fills_files_day_by_day(spark):
    day = smallfiles.DAY
    chosen = spark.createDataFrame([(i, "a", 1, i // 4 * day) for i in range(40)] + [(100 + i, "b", None, None) for i in range(3)] + [(200 + i, "c", 1, 5 * day) for i in range(30)], "file_id bigint, ns string, shard_id int, epoch bigint")
    sizes = chosen.select("file_id", F.lit(1).cast("bigint").alias("n_series"), F.when(F.col("file_id") == 229, 1000).otherwise(10).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("copies"))
    placed = {r.file_id: r for r in smallfiles.placements(chosen, sizes, 100).collect()}
    assert len(placed) == 73
    runs = [{r.file_id for r in placed.values() if r.group == g} for g in {r.group for r in placed.values() if r.ns == "a"}]
    assert sorted(map(min, runs)) == [0, 12, 20, 32] and all(max(r) - min(r) + 1 == len(r) for r in runs)
    assert len({r.group for r in placed.values() if r.ns == "b"}) == 1 and len({r.group for r in placed.values() if r.ns == "c"}) > 5
    assert placed[229].pieces == 10 and placed[0].pieces == 1


def test_damaged_objects_are_not_lost(spark, tmp_path):
    content = smallfiles.encode(_table([("a", 1, 1, 1, "m", {})]))
    with pytest.raises(SegmentError):
        smallfiles.join_objects([content], [2], 10)
    with pytest.raises(SegmentError):
        smallfiles.join_objects([content, content[:-20]], [1, 1], 10)


def _items(spark, n=4000):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 4 + [f"m{i}" for i in range(30)] + [None]), {"env": rng.choice(["prod"] * 5 + ["x", None]), f"k{rng.randrange(40)}": str(i % 7)} if i % 9 else None, "") for i in range(n)]
    return rows, spark.createDataFrame(rows, RECORD).repartition(5)


def test_item_plan_splits_and_counts_stay_whole(spark):
    rows, df = _items(spark)
    want = Counter()
    for m, tags, _ in rows:
        want.update(["metric\x01" + m] if m is not None else [])
        want.update({f"tag\x01{k}={v}" for k, v in (tags or {}).items() if v is not None})
    plan = skew.plan_for_items(df.select("metric", "tags"), metric_and_tags, 16)
    assert len(plan.placed["tag\x01env=prod"]) > 2 and len(plan.placed["metric\x01hot"]) == 1
    facts = df.select("metric", "tags").mapInArrow(counted(skew.sharded(metric_and_tags, plan)), "field string, term string, shard bigint, occurrences bigint, n_rows bigint").cache()
    assert {r.k: r.n for r in facts.groupBy(skew.item_key().alias("k")).agg(F.sum("n_rows").alias("n")).collect()} == want
    shards = {r.shard: r.n for r in facts.where("term = 'env=prod'").groupBy("shard").agg(F.sum("n_rows").alias("n")).collect()}
    assert set(shards) == set(range(len(plan.placed["tag\x01env=prod"]))) and max(shards.values()) < 1.25 * min(shards.values())
    loads = skew.fragment(facts, skew.item_key(), [F.col("term")], plan, F.col("shard")).groupBy(skew.TASK).agg(F.sum("n_rows").alias("n")).collect()
    assert max(r.n for r in loads) * 16 <= 2 * sum(want.values())
    assert skew.plan_for_items(df.select("metric", "tags").limit(0), metric_and_tags, 4).placed == {}


def test_summary_is_bounded_and_errs_by_little(spark):
    rows, df = _items(spark)
    exact = Counter(m for m, *_ in rows if m is not None)
    only_metrics = lambda batch: [next(metric_and_tags(batch))]
    got = df.coalesce(1).select("metric", "tags").mapInArrow(skew.summarised(only_metrics, 6), "field string, term string, n bigint").collect()
    named = {r.term: r.n for r in got if r.field is not None}
    assert next(r.n for r in got if r.field is None) == sum(exact.values()) and len(named) <= 6 and "hot" in named
    assert all(exact[k] - sum(exact.values()) / 6 <= n <= exact[k] for k, n in named.items())


def test_registered_plan_splits_items_evenly(spark):
    import os

    from chronofind.queries.maintenance import queries

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test tables")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        r = queries()["p4_tasks"](spark, "/root/testdata/sf0.1").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert r.n_split >= 1 and r.largest <= 1.5 and r.n_tasks == 32
