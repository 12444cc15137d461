"""The series search on small hand-made segments."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chronofind.errors import QueryError
from chronofind.model import MANIFEST, SERIES
from chronofind.operators import discovery, timeseries
from chronofind.operators.catalog import Catalog
from chronofind.plans.filters import ExplicitTags, parse_filter
from chronofind.plans.request import parse_request
from chronofind.queries.reference import chain, explicit, key, metric, negate, request, value

S = 1704067200
TAGS = {"foo": "bar", "do": "re", "hi": "hello"}


def catalog(spark, rows, duration=86400, committed=True):
    """rows: (segment, id, metric, tags, epochs)."""
    series = spark.createDataFrame([(1, s, i, m, t, e) for s, i, m, t, e in rows], SERIES)
    segments = sorted({r[0] for r in rows})
    return Catalog(series, spark.createDataFrame([(1, s, duration, committed, None) for s in segments], MANIFEST))


def found(c, f, group=(), start=S, end=S + 3600, **kw):
    return [(tuple(r.grp), r.series_id, list(r.epochs)) for r in timeseries.search(c, request(f, group, start=start, end=end), **kw).orderBy("grp", "series_id").collect()]


def basic(segment=S):
    return [(segment, i, f"metric{i}", TAGS, [segment]) for i in range(100)]


def test_all_values_of_a_key_grouped(spark):
    rows = found(catalog(spark, basic()), value("foo", ".*", True), ("foo", "do", "hi"))
    assert {r[0] for r in rows} == {("bar", "re", "hello")} and len(rows) == 100 and all(r[2] == [S] for r in rows)


def test_segments_of_a_shard_merge(spark):
    rows = found(catalog(spark, basic() + basic(S + 30)), value("foo", ".*", True), ("foo",))
    assert len(rows) == 100 and rows[0][2] == [S, S + 30]


def test_window_selects_but_does_not_clip_epochs(spark):
    rows = [(S, 0, "metric0", TAGS, [S, S + 50400]), (S, 4, "metric4", TAGS, [S + 50400])]
    assert found(catalog(spark, rows), value("foo", ".*", True), ("foo",), end=S + 11 * 3600) == [(("bar",), 0, [S, S + 50400])]


def test_not_and_explicit(spark):
    c = catalog(spark, basic())
    assert found(c, chain("AND", metric("metric0"), negate(value("foo", "bar")))) == []
    three = chain("AND", metric("metric0"), value("foo", "bar"), value("do", "re"), value("hi", "hello"))
    assert [r[1] for r in found(c, explicit(three))] == [0]
    assert found(c, explicit(chain("AND", metric("metric0"), value("foo", "bar")))) == []


def test_group_order_follows_request(spark):
    c = catalog(spark, basic())
    assert found(c, metric("metric1"), ("foo", "do"))[0][0] == ("bar", "re")
    assert found(c, metric("metric1"), ("do", "foo"))[0][0] == ("re", "bar")
    assert found(c, metric("metric1"), ("FOO|do",))[0][0] == ("re", "bar")


def test_missing_keys(spark):
    rows = [(S, 1, "a", {"x": "1"}, [S]), (S, 2, "b", {"y": "1"}, [S]), (S + 86400, 3, "a", {"x": "1"}, [S + 86400])]
    c, f = catalog(spark, rows), chain("OR", metric("a"), value("y", "1"))
    assert [r[1] for r in found(c, f, end=S + 90000)] == [1, 2]
    assert [r[1] for r in found(c, f, end=S + 90000, compat=False)] == [1, 2, 3]
    assert found(c, metric("a|b"), ("x", "y"), end=S + 90000) == [(("1",), 3, [S + 86400]), (("1", "__no_data__"), 1, [S]), (("__no_data__", "1"), 2, [S])]


def test_time_edges(spark):
    c = catalog(spark, [(S, 1, "a", {}, [S])])
    assert len(found(c, metric("a"), start=S + 21600, end=S + 21600)) == 1
    assert found(c, metric("a"), start=S + 23400, end=S + 23400) == []
    assert found(catalog(spark, [(S, 1, "a", {}, [S])], duration=None), metric("a"), start=S + 1800, end=S + 3600) == []
    assert found(catalog(spark, [(S, 1, "a", {}, [S])], committed=None), metric("a")) == []


def test_nulls_empty_table_and_extra_columns(spark):
    rows = [(S, 1, None, {"x": "1"}, [S]), (S, 2, "a", None, [S]), (S, None, "a", {}, [S]), (S, 4, "a", {}, None), (S, 5, "a", {"x": None}, [S])]
    c = catalog(spark, rows)
    assert [r[1] for r in found(c, metric("a"))] == [None, 2, 5]
    assert [r[1] for r in found(c, chain("AND", value("x", ".*", True), negate(metric("a"))))] == [1]
    assert found(Catalog(c.series.limit(0), c.manifest.limit(0)), metric("a"), ("x",)) == []
    wide = Catalog(c.series.withColumn("duration", F.lit("x")).withColumn("group_keys", F.lit(1)).withColumn("grp", F.lit(1)), c.manifest.withColumn("metric", F.lit(1)))
    assert found(wide, metric("a"), ("x",)) == found(c, metric("a"), ("x",))


def test_need_segments_and_chunks(spark):
    c = catalog(spark, basic())
    with pytest.raises(QueryError):
        timeseries.search(c, request(metric("a"), start=0, end=10), need_segments=True)
    sizes = [len(x) for x in timeseries.chunks(timeseries.search(c, request(metric(".*"), start=S, end=S)), 40)]
    assert sizes == [40, 40, 20]
    with pytest.raises(QueryError):
        next(timeseries.chunks(c.series, 0))


@pytest.mark.parametrize("change", [
    {"type": None}, {"type": "NOPE"}, {"group": None}, {"group": [1]}, {"start": "x"}, {"start": -1}, {"end": None}, {"query": {"type": "x"}}, {"query": 3},
    {"query": {"type": "Chain"}}, {"query": {"type": "Not"}}, {"query": {"type": "MetricLiteral"}}, {"query": {"type": "TagValueRegex", "filter": "a"}},
    {"type": "METRICS", "limit": None}, {"type": "TAG_KEYS_AND_VALUES", "group": []},
])
def test_malformed_requests(change):
    good = {"from": 0, "to": 1, "limit": 0, "start": S, "end": S, "type": "TIMESERIES", "group": [], "query": metric("a"), "order": "x", "namespace": "y"}
    assert parse_request(good).end == S + 1800
    with pytest.raises(QueryError):
        parse_request({k: v for k, v in (good | change).items() if v is not None})


def test_malformed_json():
    for text in ("", "[]", "{", "3"):
        with pytest.raises(QueryError):
            parse_request(text)


def test_type_is_case_insensitive_and_bad_pattern_finds_nothing(spark):
    assert parse_filter({"type": "EXPLICITTAGS", "filter": key("a")}) == ExplicitTags(parse_filter(key("a")))
    assert found(catalog(spark, basic()), chain("OR", metric("metric0"), metric("(")), ()) == []
    assert found(catalog(spark, basic()), chain("and", metric("metric0")), ()) == []
    for pattern in ("(?=m)metric0", r"(m)\1|metric0", "metric0++", "(?>metric0)", r"\Qmetric0\E", "(?<!x)metric0"):
        assert found(catalog(spark, basic()), metric(pattern), ()) == [], pattern
        assert found(catalog(spark, basic()), value(pattern, ".*", True), ()) == [], pattern
    for pattern in (r"metric0|a\++", "metric0|[+*+]", "metric0|a+?", "(?:metric0)", r"metric0|\\+"):
        assert [r[1] for r in found(catalog(spark, basic()), metric(pattern), ())] == [0], pattern


def test_matchers_on_odd_terms(spark):
    words = ["web", "myweb", "web01", "WEB", "Größe", "GRÖSSE", "a\nb", "web\n", ""]
    c = catalog(spark, [(S, i, w, {"k": w}, [S]) for i, w in enumerate(words)])
    ids = lambda f: [r[1] for r in found(c, f)]
    assert ids(metric("web")) == [0, 3] and ids(value("k", "web", True)) == [0, 1, 3]
    assert ids(metric("größe")) == [4] and ids(metric("a.b")) == [] and ids(metric("web|größe")) == [0, 3, 4]
    assert ids(value("k", "", True)) == list(range(9)) and ids(key(".*", True)) == []


def _oracle(node, rows, keys):
    """Set evaluation of a filter tree; None where it fails. rows: id -> (metric, tags)."""
    kind = node["type"]
    full = lambda p, v: v is not None and re.fullmatch(p, v, re.I) is not None
    tail = lambda p, v: v is not None and re.search(f"(?:{p})\\Z", v, re.I) is not None
    if kind == "MetricLiteral":
        return {i for i, (m, _) in rows.items() if full(node["metric"], m)}
    if kind.startswith("TagKey"):
        test = full if kind == "TagKeyLiteralOr" else tail
        if kind == "TagKeyRegex" and node["filter"] == ".*":
            return {i for i, (_, t) in rows.items() if any(full("__tagkey", k) for k in t)}
        return {i for i, (_, t) in rows.items() if any(test(node["filter"], k) for k in t)}
    if kind.startswith("TagValue"):
        if kind == "TagValueRegex" and node["filter"] == ".*":
            return {i for i, (_, t) in rows.items() if any(full(node["tagKey"], k) for k in t)}
        if node["tagKey"] not in keys:
            return None
        test = full if kind == "TagValueLiteralOr" else tail
        return {i for i, (_, t) in rows.items() if test(node["filter"], t.get(node["tagKey"]))}
    if kind in ("Not", "ExplicitTags"):
        return _oracle(node["filter"], rows, keys)
    sets = [(_oracle(f["filter"] if f["type"] == "Not" else f, rows, keys), f["type"] == "Not") for f in node["filters"]]
    if any(s is None for s, _ in sets):
        return None
    plus, minus = [s for s, no in sets if not no], [s for s, no in sets if no]
    if not plus:
        return set()
    return set.union(*plus) if node["op"] == "OR" else set.intersection(*plus) - set().union(*minus)


def _random_filter(rng, depth):
    kind = rng.random()
    if depth and kind < 0.5:
        return chain(rng.choice(["AND", "OR"]), *[_random_filter(rng, depth - 1) for _ in range(rng.randint(1, 3))])
    if depth and kind < 0.65:
        return negate(_random_filter(rng, depth - 1))
    if depth and kind < 0.7:
        return explicit(_random_filter(rng, depth - 1))
    return rng.choice([
        lambda: metric(rng.choice(["m1", "m1|m2", "M.", ".*"])), lambda: key(rng.choice(["a", "B", "a|c", ".*"]), rng.random() < 0.5),
        lambda: value(rng.choice("abcz"), rng.choice(["x", "x|y", ".*", "Y"]), rng.random() < 0.5)])()


def test_random_trees_against_set_evaluation(spark):
    rng = random.Random(7)
    rows = {(s, i): (rng.choice(["m1", "m2", "m3"]), {k: rng.choice(["x", "y", "yx"]) for k in rng.sample(["a", "b", "c"], rng.randint(0, 3)) if k != "c" or s})
            for s in range(2) for i in range(12)}
    c = catalog(spark, [(S + s * 86400, s * 100 + i, m, t, [S + s * 86400]) for (s, i), (m, t) in rows.items()])
    c.series.cache()
    for _ in range(25):
        tree = _random_filter(rng, 3)
        expected = set()
        for s in range(2):
            own = {s * 100 + i: v for (g, i), v in rows.items() if g == s}
            got = _oracle(tree, own, {k for _, t in own.values() for k in t})
            if got and tree["type"] == "ExplicitTags":
                count = parse_filter(tree).count
                got = {i for i in got if len(own[i][1]) == count}
            expected |= got or set()
        assert {r[1] for r in found(c, tree, end=S + 90000)} == expected, tree


def test_discovery(spark):
    c = catalog(spark, [(S, 1, "a", {"x": "1", "y": None}, [S]), (S, 2, "b", {"x": "2"}, [S]), (S, 3, None, {"z": "2"}, [S])])
    terms = lambda kind, group=(): sorted(r.term for r in discovery.discover(c, request(chain("OR", metric("a"), key("z|x")), group, kind, S, S)).collect())
    assert terms("METRICS") == ["a", "b"] and terms("TAG_KEYS") == ["x", "y", "z"] and terms("TAG_KEYS_AND_VALUES", ("x",)) == ["1", "2"]
    limited = parse_request({"from": 0, "to": 0, "limit": 1, "start": S, "end": S, "type": "METRICS", "group": [], "query": metric(".*")})
    assert [r.term for r in discovery.discover(c, limited).collect()] == ["a"]
    with pytest.raises(QueryError):
        discovery.discover(c, request(metric("a"), start=S, end=S))
