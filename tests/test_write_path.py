"""Ingest, store, compaction, roll-up, streaming, record objects, settings and metrics."""

import struct

import pytest
from pyspark.sql import functions as F

from chronofind.config import EngineConfig
from chronofind.errors import EngineError, SegmentError
from chronofind.metrics import MemoryReporter, observed, report
from chronofind.model import MANIFEST, SERIES
from chronofind.operators import compaction, ingest, timeseries
from chronofind.operators.catalog import Catalog
from chronofind.queries.reference import metric, request
from chronofind.sources import records as r
from chronofind.sources.store import SegmentStore
from chronofind.streaming import ingest as streaming

S = 1704067200
SCHEMA = "metric string, tags map<string,string>, series_id bigint, batch bigint, seq bigint"


def test_dedup_buckets_and_routing(spark):
    rows = [("b", {"x": "2"}, -13, S + 7200, 1), ("a", {"x": "1"}, -13, S, 0), ("c", None, -13, S + 21600, 0), (None, None, 5, S, 0), ("n", {}, None, S, 0), ("n", {}, 1, None, 0)]
    got = {(x.shard, x.series_id): x for x in ingest.build_segments(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    assert set(got) == {(3, -13), (5, 5)}
    assert (got[3, -13].metric, got[3, -13].tags, got[3, -13].epochs, got[3, -13].segment) == ("a", {"x": "1"}, [S, S + 21600], S)
    assert ingest.build_segments(spark.createDataFrame([], SCHEMA), 10).count() == 0


def test_compaction_counts(spark):
    rows = [(0, S, i, f"metric{i}", {"foo": "bar"}, [S]) for i in range(8)] + [(0, S + 7200, i, f"metric{i}", {"foo": "late"}, [S + 7200]) for i in range(15)]
    got = compaction.compact(spark.createDataFrame(rows, SERIES), F.lit(S).cast("bigint")).collect()
    assert len(got) == 15 and {x.metric for x in got} == {f"metric{i}" for i in range(15)} and {x.segment for x in got} == {S}
    assert all(x.tags["foo"] == ("bar" if x.series_id < 8 else "late") and x.epochs == [S] for x in got)


def test_epochs_before_the_target_are_dropped(spark):
    rows = [(0, S - 86400, 1, "a", {}, [S - 86400]), (0, S, 1, "b", {}, [S + 25200])]
    got = compaction.compact(spark.createDataFrame(rows, SERIES), F.lit(S).cast("bigint")).collect()
    assert [(x.metric, x.epochs) for x in got] == [("a", [S + 21600])]


def test_rollup_selection(spark):
    day, now = 86400, S + 30 * 86400
    rows = [(0, S + i * day, day, True, None) for i in range(9)] + [(1, S + i * day, day, True, None) for i in range(6)] + [(0, S - day, day, False, None), (0, S - 2 * day, 8 * day, True, None)]
    got = compaction.rollup_candidates(spark.createDataFrame(rows, MANIFEST), 7, now).collect()
    assert sorted(x.segment for x in got) == [S + i * day for i in range(7)] and {(x.shard, x.target) for x in got} == {(0, S)}
    done = rows[1:] + [(0, S, 7 * day, True, ",".join(str(S + i * day) for i in range(7)))]
    assert compaction.rollup_candidates(spark.createDataFrame(done, MANIFEST), 7, now).count() == 0


def test_store_versions_visibility_and_rollup(spark, tmp_path):
    store = SegmentStore(spark, f"file://{tmp_path}/store")
    assert store.catalog().series.count() == 0
    rows = [(0, S + d * 86400, i, f"m{i}", {"x": str(i)}, [S + d * 86400]) for d in range(7) for i in range(3)]
    series = spark.createDataFrame(rows, SERIES)
    store.write(series, ingest.manifest_of(series, 86400))
    again = spark.createDataFrame([(0, S, 9, "m9", {}, [S])], SERIES)
    store.write(again, ingest.manifest_of(again, 86400))
    assert store.catalog().series.where(F.col("segment") == S).select("series_id").collect()[0][0] == 9
    target = SegmentStore(spark, f"file://{tmp_path}/rolled")
    assert store.rollup(7, S + 30 * 86400, target) and target.catalog().series.count() == 4
    assert target.manifest().first().duration == 7 * 86400 and target.rollup(7, S + 30 * 86400) is None
    store.compact_segments(0, [S + 86400, S + 2 * 86400])
    left = {(x.segment, x.series_id): x.epochs for x in store.catalog().series.where(F.col("segment") <= S + 2 * 86400).collect()}
    assert left[S + 86400, 1] == [S + 86400, S + 2 * 86400] and (S + 2 * 86400, 1) not in {k for k in left}


def test_stream_gives_what_one_batch_gives(spark, tmp_path):
    rows = [("m", {"h": str(i % 3)}, i % 7, S + (i % 5) * 7200, i) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        frame.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    config, reporter = EngineConfig(shards=4, max_files_per_trigger=1), MemoryReporter()
    store = SegmentStore(spark, f"file://{tmp_path}/store")
    streaming.start(spark, streaming.parquet_stream(spark, f"{tmp_path}/in", SCHEMA, config), store, config, f"{tmp_path}/cp", reporter, once=True).awaitTermination()
    got = {(x.shard, x.segment, x.series_id): x.epochs for x in store.catalog().series.collect()}
    want = {(x.shard, x.segment, x.series_id): x.epochs for x in ingest.build_segments(frame, 4).collect()}
    assert got == want and reporter.counts["ingest.batches"] == 3
    assert {x.duration for x in store.manifest().collect()} <= {36000, 28800, 21600, 14400, 7200}
    assert timeseries.search(store.catalog(), request(metric("m"), start=S, end=S + 3600)).count() == 7
    assert streaming.merge_records(store, frame.limit(0), config) is None


def test_record_objects(spark, tmp_path):
    good = [r.encode(-5, "cpu", {"host": "a", "dc": "ü"}), r.encode(2**63 - 1, "mem", {}), r.encode(7, "", {"": ""})]
    folder = tmp_path / "ns" / str(S)
    folder.mkdir(parents=True)
    (folder / "one.gz").write_bytes(r.frame([*good, b"short", bytes(14) + b"k\0v\0"]))
    (folder / "cut.gz").write_bytes(r.frame(good)[:-12])
    (folder / "none.gz").write_bytes(r.frame([]))
    decoded = r.read_objects(spark, f"{tmp_path}/ns")
    assert decoded.where("path like '%one.gz' and error is not null").count() == 2
    got = r.valid_records(decoded.where("path like '%one.gz'")).orderBy("seq").collect()
    assert [(x.series_id, x.metric, x.tags, x.batch) for x in got] == [(-5, "cpu", {"host": "a", "dc": "ü"}, S), (2**63 - 1, "mem", {}, S), (7, "", {"": ""}, S)]
    assert decoded.where("path like '%cut.gz' and error is not null").count() == 1


def test_record_bytes_by_hand():
    raw = b"\0\0\0\0" + struct.pack(">q", -2) + b"\0\0" + b"host\0web\0" + b"\x01\x00" + b"cpu"
    assert r.decode(raw) == (-2, "cpu", {"host": "web"})
    for bad in (raw[:10], raw[:18], raw[:-5], b"\0" * 14 + b"\xff\0v\0\x01\0m"):
        with pytest.raises(SegmentError):
            r.decode(bad)


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text('namespace = "n"\nshards = 3\n')
    (tmp_path / "b.toml").write_text("shards = 4\n")
    assert EngineConfig.load(str(tmp_path / "a.toml"), str(tmp_path / "b.toml")) == EngineConfig(namespace="n", shards=4)
    for text in ("shards = 0", "nope = 1", 'shards = "x"', "shards ="):
        (tmp_path / "c.toml").write_text(text)
        with pytest.raises(EngineError):
            EngineConfig.load(str(tmp_path / "c.toml"))
    with pytest.raises(EngineError):
        EngineConfig.load(str(tmp_path / "missing.toml"))


def test_metrics(spark):
    df, seen = observed(spark.range(10), "rows", n=F.count(F.lit(1)))
    df.collect()
    reporter = MemoryReporter()
    report(seen, reporter, "query")
    assert reporter.gauges == {"query.n": 10}


def test_queries_over_an_uncommitted_manifest_are_empty(spark):
    series = spark.createDataFrame([(0, S, 1, "m", {}, [S])], SERIES)
    assert timeseries.search(Catalog(series, spark.createDataFrame([], MANIFEST)), request(metric("m"), start=S, end=S)).count() == 0


def test_metric_filters_reach_the_scan(spark, tmp_path):
    from chronofind.plans.filters import parse_filter
    from chronofind.plans.pruning import metric_prefixes
    from chronofind.queries.reference import chain, key, negate, value

    prefixes = lambda f: metric_prefixes(parse_filter(f))
    assert prefixes(metric("Sys.cpu|mem")) == ["mem", "sys"] and prefixes(metric("ab*|c")) == ["a", "c"] and prefixes(metric("(a)")) is None and prefixes(metric(".*")) is None
    assert prefixes(chain("AND", key("x"), metric("cpu"), negate(metric("mem")))) == ["cpu"] and prefixes(chain("OR", key("x"), metric("cpu"))) is None
    assert prefixes(chain("OR", metric("b"), negate(key("x")), metric("a"))) == ["a", "b"] and prefixes(chain("AND", negate(metric("a")))) is None
    assert prefixes(metric("é")) is None and prefixes(metric("a?")) is None

    names = ["cpu", "CPU.user", "ſys", "SYS", "memory", "K", "k", None]
    series = spark.createDataFrame([(0, S, i, n, {"x": "1"} if i % 2 else {}, [S]) for i, n in enumerate(names)], SERIES)
    store = SegmentStore(spark, f"file://{tmp_path}/s")
    store.write(series, ingest.manifest_of(series, 86400))
    plain = Catalog(series, ingest.manifest_of(series, 86400))
    for f in (metric("cpu|sys"), metric("k"), metric("cpu.*"), chain("AND", metric("s.*|c.*"), value("x", "1")), chain("OR", metric("K"), value("y", "1")), metric("mem.*")):
        got, want = (sorted(map(str, timeseries.search(c, request(f, ("x",), start=S, end=S)).collect())) for c in (store.catalog(), plain))
        assert got == want
    plan = timeseries.search(store.catalog(), request(metric("cpu"), start=S, end=S))._jdf.queryExecution().toString()
    assert "StringStartsWith(metric_key,cpu)" in plan


def test_object_stream(spark, tmp_path):
    for i in range(2):
        folder = tmp_path / "in" / "ns" / str(S + i * 7200)
        folder.mkdir(parents=True)
        (folder / "o.gz").write_bytes(r.frame([r.encode(k, "m", {"h": str(k)}) for k in range(3 + i)] + [b"bad"]))
    config = EngineConfig(namespace="ns", input_path=f"{tmp_path}/in", shards=2)
    store = SegmentStore(spark, f"file://{tmp_path}/store")
    streaming.start(spark, streaming.object_stream(spark, config), store, config, f"{tmp_path}/cp", once=True).awaitTermination()
    assert {x.series_id: x.epochs for x in store.catalog().series.collect()} == {k: [S] for k in range(4)}
    assert {x.duration for x in store.manifest().collect()} == {14400}


def _days(spark, store, days, ids=3):
    rows = [(0, S + d * 86400, i, f"m{i}", {"x": str(i)}, [S + d * 86400]) for d in days for i in range(ids)]
    series = spark.createDataFrame(rows, SERIES)
    return store.write(series, ingest.manifest_of(series, 86400))


def test_only_live_folders_are_opened_and_vacuum_deletes_the_others(spark, tmp_path):
    from chronofind.sources.objects import ObjectStore

    store, files = SegmentStore(spark, f"file://{tmp_path}/s"), ObjectStore(spark, f"file://{tmp_path}/s/data")
    first, second = _days(spark, store, range(4)), _days(spark, store, [1, 2], 2)
    opened = lambda c: {f.split("/data/")[1].rsplit("/", 1)[0] for f in c.series.inputFiles()}
    folder = lambda v, d: f"version={v}/shard=0/segment={S + d * 86400}"
    everything = {folder(first, 0), folder(second, 1), folder(second, 2), folder(first, 3)}
    assert opened(store.catalog()) == everything
    assert opened(store.catalog(S + 86400, S + 86400)) == {folder(first, 0), folder(second, 1)}
    assert store.vacuum(3600) == 0 and folder(first, 1) in {"/".join(f.path.split("/")[-4:-1]) for f in files.list_files()}
    before = sorted(map(tuple, store.catalog().rows.select("segment", "series_id").collect()))
    assert store.vacuum(0) >= 2
    assert {"/".join(f.path.split("/")[-4:-1]) for f in files.list_files() if f.path.endswith(".parquet")} == everything
    assert sorted(map(tuple, store.catalog().rows.select("segment", "series_id").collect())) == before
    assert {r.tag_key for r in store.catalog().key_table.collect()} == {"x"} and store.manifest().count() == 4
    third = _days(spark, store, [0, 1, 2, 3])
    (tmp_path / "s/manifest" / f"{third:020d}" / "_SUCCESS").unlink()
    assert opened(store.catalog()) == everything
    _days(spark, store, [0, 1, 2, 3])
    store.vacuum(0)
    assert files.list_folders() == sorted(files.list_folders())[-1:]


def test_many_commits_are_summarised(spark, tmp_path, monkeypatch):
    import chronofind.sources.store as module

    monkeypatch.setattr(module, "MOST_COMMITS", 2)
    store = SegmentStore(spark, f"file://{tmp_path}/s")
    for day in range(4):
        _days(spark, store, [day, 0], 1)
    assert len(store._commits()) <= 2 and sorted((r.segment - S) // 86400 for r in store.live()) == [0, 1, 2, 3] and store.catalog().rows.count() == 4
    store.vacuum(0)
    assert len(store._folders("manifest")) == 1 and store.catalog().rows.count() == 4


def test_a_large_metric_is_spread_over_tasks(spark, tmp_path):
    store = SegmentStore(spark, f"file://{tmp_path}/s")
    series = spark.range(20_000).select(F.lit(0).alias("shard"), F.lit(S).cast("bigint").alias("segment"), F.col("id").alias("series_id"), F.lit("one").alias("metric"),
                                        F.create_map(F.lit("k"), F.col("id").cast("string")).alias("tags"), F.array(F.lit(S).cast("bigint")).alias("epochs"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write(series, ingest.manifest_of(series, 86400))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in store.catalog().series.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes) and sum(sizes) == 20_000


def test_rollup_in_place_retires_what_it_merged(spark, tmp_path):
    from chronofind.programs import run_rollup

    store, target = SegmentStore(spark, f"file://{tmp_path}/n"), SegmentStore(spark, f"file://{tmp_path}/t")
    _days(spark, store, range(16))
    assert store.rollup(7, S + 60 * 86400, target) and store.rollup(7, S + 60 * 86400, target) and store.rollup(7, S + 60 * 86400, target) is None
    assert target.catalog().rows.count() == 6 and store.catalog().rows.count() == 48
    reporter = MemoryReporter()
    config = EngineConfig(namespace="n", store_path=f"file://{tmp_path}", rollup_size=7)
    assert run_rollup(spark, config, True, reporter, S + 60 * 86400) == 2
    assert sorted((r.segment - S) // 86400 for r in store.live()) == [0, 7, 14, 15] and store.catalog().rows.count() == 12
    assert reporter.gauges["rollup.segment.series"] == 3 and reporter.counts["segment.build.timeseries.count"] == 6 and "rollup.generation.ms" in reporter.gauges
    with pytest.raises(EngineError):
        run_rollup(spark, EngineConfig(), True, reporter)


def test_object_store_client(spark, tmp_path):
    from chronofind.sources.objects import ObjectStore

    store = ObjectStore(spark, f"file://{tmp_path}/o")
    (tmp_path / "x").write_bytes(b"abc")
    assert store.metadata("a/b") is None and store.list_files("a") == [] and store.list_folders() == []
    store.upload(str(tmp_path / "x"), "a/b")
    (tmp_path / "x").write_bytes(b"abcd")
    store.upload(str(tmp_path / "x"), "a/b")
    assert store.metadata("a/b").size == 4 and store.list_folders() == ["a"] and [f.size for f in store.list_files()] == [4]
    store.download("a/b", str(tmp_path / "y"))
    assert (tmp_path / "y").read_bytes() == b"abcd" and store.delete("a") and not store.delete("a")


def test_served_messages(spark, tmp_path):
    from chronofind.errors import QueryError
    from chronofind.serving import answer

    store, reporter = SegmentStore(spark, f"file://{tmp_path}/s"), MemoryReporter()
    _days(spark, store, [0], 5)
    ask = lambda **kw: {"from": 0, "to": 0, "limit": 0, "start": S, "end": S, "type": "TIMESERIES", "group": ["x"], "query": metric("m.*")} | kw
    *chunks, last = list(answer(store, ask(), EngineConfig(response_size=2), reporter))
    assert [len(m.rows) for m in chunks] == [2, 2, 1] and all(m.dictionary is None for m in chunks) and last.rows == [] and last.dictionary == {0: ["0", "1", "2", "3", "4"]}
    assert reporter.counts["query.rows"] == 5 and reporter.gauges["query.latency"] > 0
    assert [r.term for m in answer(store, ask(type="METRICS", limit=2)) for r in m.rows] == ["m0", "m1"]
    for bad in (ask(start=0, end=1), ask(type="?"), "{"):
        with pytest.raises(QueryError):
            list(answer(store, bad))


def test_programs(spark, tmp_path, capsys):
    from chronofind.programs import main

    records = spark.createDataFrame([("m", {"h": str(i)}, i, S + (i % 2) * 7200) for i in range(6)] + [(None, None, None, S), ("m", {"h": None}, 9, None)], "metric string, tags map<string,string>, series_id bigint, batch bigint")
    written = r.write_objects(records, f"file://{tmp_path}/in/ns").collect()
    assert sorted(x.n for x in written) == [3, 3]
    (tmp_path / "c.toml").write_text(f'namespace = "ns"\ninput_path = "file://{tmp_path}/in"\nstore_path = "file://{tmp_path}/st"\nstart_epoch = {S}\nmax_files_per_trigger = 1\n')
    (tmp_path / "q.json").write_text('{"type": "TIMESERIES", "start": %d, "end": %d, "group": ["h"], "query": {"type": "MetricLiteral", "metric": "m"}}' % (S, S))
    main(["ingest", str(tmp_path / "c.toml"), "--once"])
    main(["vacuum", str(tmp_path / "c.toml")])
    main(["query", str(tmp_path / "c.toml"), "--request", str(tmp_path / "q.json")])
    lines = capsys.readouterr().out.strip().split("\n")
    assert len(lines) == 2 and all(f'"series_id": {i}' in lines[0] for i in range(6)) and '"dictionary": {' in lines[1]


def test_what_ingest_counts(spark, tmp_path):
    rows = [("m", {}, 1, S + 7200, 0, None), (None, None, None, None, 1, "bad"), ("m", {}, None, S, 2, None), ("m", {}, 2, S - 7200, 3, None), ("m", {}, 3, None, 4, None)]
    store, reporter = SegmentStore(spark, f"file://{tmp_path}/s"), MemoryReporter()
    frame = spark.createDataFrame(rows, SCHEMA + ", error string")
    assert streaming.merge_records(store, frame, EngineConfig(start_epoch=S), reporter=reporter)
    assert reporter.counts == {"ingest.records": 5, "ingest.damaged": 1, "ingest.unplaced": 2, "ingest.rejected": 1, "ingest.late": 0}
    assert streaming.merge_records(store, spark.createDataFrame([("m", {}, 1, S, 0)], SCHEMA), EngineConfig(), reporter=reporter) and reporter.counts["ingest.late"] == 1
    assert {x.series_id: x.epochs for x in store.catalog().rows.collect()} == {1: [S]}
    assert streaming.merge_records(store, frame.where("error is not null"), EngineConfig(), reporter=reporter) is None
