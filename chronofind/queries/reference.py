"""Registered queries of the search engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofind.fixtures import FULL, SHARDS, event_catalog, event_records
from chronofind.functions.routing import assigned
from chronofind.functions.timing import epoch_bucket, floor_to
from chronofind.operators import compaction, discovery, ingest, setops, timeseries
from chronofind.operators.catalog import Catalog
from chronofind.plans.request import parse_request

Query = Callable[[SparkSession, str], DataFrame]

START, END = 1704067200, 1704326400
ALIGNED_END = 1704328200


def metric(p: str) -> dict:
    return {"type": "MetricLiteral", "metric": p}


def key(p: str, regex: bool = False) -> dict:
    return {"type": "TagKeyRegex" if regex else "TagKeyLiteralOr", "filter": p}


def value(k: str, p: str, regex: bool = False) -> dict:
    return {"type": "TagValueRegex" if regex else "TagValueLiteralOr", "tagKey": k, "filter": p}


def chain(op: str, *filters: dict) -> dict:
    return {"type": "Chain", "op": op, "filters": list(filters)}


def negate(f: dict) -> dict:
    return {"type": "Not", "filter": f}


def explicit(f: dict) -> dict:
    return {"type": "ExplicitTags", "filter": f}


def request(f: dict, group: tuple[str, ...] = (), kind: str = "TIMESERIES", start: int = START, end: int = END):
    return parse_request({"from": 0, "to": 0, "limit": 0, "start": start, "end": end, "type": kind, "group": list(group), "query": f})


FLAGSHIP = chain("AND", metric("click"), value("host", "h1.*", True), negate(value("band", "b0|b3")))

_BASE = """
WITH ev AS (
  SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type AS metric, 'h' || (user_id % 20) AS host,
         'b' || (CAST(json_extract_string(props, '$.k') AS BIGINT) // 25) AS band,
         CASE WHEN user_id % 5 = 0 THEN 'y' END AS vip,
         CASE WHEN user_id % 50 = 7 AND event_id % 7 = 0 THEN 'y' END AS canary
  FROM events),
k AS (SELECT *, t - t % 7200 AS batch, metric || '|' || host || '|' || band || '|' || coalesce(vip, '') || '|' || coalesce(canary, '') AS skey FROM ev),
r AS (SELECT *, CAST('0x' || substr(md5(skey), 1, 15) AS BIGINT) - 576460752303423488 AS series_id, batch - batch % 86400 AS segment FROM k),
se AS (SELECT DISTINCT CAST(abs(series_id % 10) AS INTEGER) AS shard, segment, series_id, metric, host, band, vip, canary,
         segment + ((batch - segment) // 21600) * 21600 AS epoch FROM r)"""

_HAS = "(shard, segment) IN (SELECT (shard, segment) FROM se WHERE {0} IS NOT NULL)"


def _matched(where: str, start: int, end: int) -> str:
    return f"""{_BASE},
seg AS (SELECT DISTINCT shard, segment FROM se WHERE ({start} <= segment AND {end} >= segment) OR ({start} >= segment AND {start} <= segment + 86400)),
live AS (SELECT DISTINCT shard, segment, series_id FROM se WHERE {start} <= epoch + 21600 AND {end} >= epoch),
m AS (SELECT DISTINCT shard, segment, series_id, metric, host, band, vip, canary FROM se
      JOIN seg USING (shard, segment) JOIN live USING (shard, segment, series_id) WHERE {where})"""


def _sql(where: str, grp: str = "''", start: int = START, end: int = ALIGNED_END, select: str | None = None) -> str:
    return f"""{_matched(where, start, end)},
found AS (SELECT shard, {grp} AS grp, series_id, epoch FROM m JOIN (SELECT shard, segment, series_id, epoch FROM se) USING (shard, segment, series_id))
{select or '''SELECT shard, grp, series_id, count(DISTINCT epoch) AS n_epochs, min(epoch) AS first_epoch, max(epoch) AS last_epoch
FROM found GROUP BY shard, grp, series_id'''}"""


def m1(column: str, pattern: str) -> str:
    return f"coalesce(regexp_full_match({column}, '{pattern}', 'i'), false)"


def m2(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, '(?:{pattern})$', 'i'), false)"


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    _QUERIES[name], _SQL[name] = query, sql


def _search(name: str, f: dict, where: str, group: tuple[str, ...] = (), grp: str = "''", start: int = START, end: int = END, compat: bool = True) -> None:
    asked = request(f, group, start=start, end=end)
    _add(name, lambda spark, d: timeseries.summary(timeseries.search(event_catalog(spark, d, asked.start, asked.end), asked, compat)), _sql(where, grp, asked.start, asked.end))


_CANARY, _VIP = _HAS.format("canary"), _HAS.format("vip")

_search("flagship_timeseries", FLAGSHIP, f"{m1('metric', 'click')} AND {m2('host', 'h1.*')} AND NOT {m1('band', 'b0|b3')}", ("band",), "band")
_search("metric_literal", metric("click"), m1("metric", "click"))
_search("metric_literal_or", metric("click|view"), m1("metric", "click|view"))
_search("metric_case_insensitive", metric("CLICK"), m1("metric", "CLICK"))
_search("metric_dot_is_wildcard", metric("c.ick"), m1("metric", "c.ick"))
_search("tagkey_literal", key("VIP|canary"), "vip IS NOT NULL OR canary IS NOT NULL")
_search("tagkey_regex", key("ip", True), "vip IS NOT NULL")
_search("tagvalue_literal_or", value("band", "B1|b2"), m1("band", "b1|b2"))
_search("tagvalue_regex", value("host", "1.*", True), m2("host", "1.*"))
_search("tagvalue_regex_suffix", value("host", "5", True), m2("host", "5"))
_search("tagvalue_regex_any", value("VIP", ".*", True), "vip IS NOT NULL")
_search("tagvalue_key_is_case_sensitive", value("BAND", "b1"), "false")
_search("chain_and", chain("AND", metric("click"), value("band", "b1")), f"{m1('metric', 'click')} AND {m1('band', 'b1')}")
_search("chain_or", chain("OR", metric("click"), value("band", "b1")), f"{m1('metric', 'click')} OR {m1('band', 'b1')}")
_search("chain_nested", chain("AND", chain("OR", metric("click"), metric("view")), chain("AND", value("band", "b1"), value("host", "h1.*", True))),
        f"{m1('metric', 'click|view')} AND {m1('band', 'b1')} AND {m2('host', 'h1.*')}")
_search("chain_unknown_op", chain("XOR", metric("click")), "false")
_search("not_in_and", chain("AND", metric("click"), negate(value("band", "b0"))), f"{m1('metric', 'click')} AND NOT {m1('band', 'b0')}")
_search("not_keeps_series_without_the_tag", chain("AND", metric("click"), negate(value("vip", "y"))), f"{m1('metric', 'click')} AND vip IS NULL AND {_VIP}")
_search("not_in_or_ignored", chain("OR", metric("click"), negate(value("band", "b0"))), m1("metric", "click"))
_search("not_root_identity", negate(metric("click")), m1("metric", "click"))
_search("not_only_empty", chain("AND", negate(metric("click"))), "false")
_search("not_of_not", chain("AND", metric("click"), negate(negate(value("band", "b0")))), f"{m1('metric', 'click')} AND NOT {m1('band', 'b0')}")
_search("explicit_tags", explicit(chain("AND", value("host", "h.*", True), value("band", "b.*", True))), "vip IS NULL AND canary IS NULL")
_search("explicit_tags_below_root", chain("AND", explicit(value("host", "h1.*", True))), m2("host", "h1.*"))
_search("explicit_tags_counts_keys", explicit(chain("AND", key("host"), value("band", "b1"), value("vip", "y"))), f"{m1('band', 'b1')} AND vip = 'y' AND canary IS NULL AND {_VIP}")
_search("missing_key_segment_drop", chain("OR", metric("click"), value("canary", "y")), f"({m1('metric', 'click')} OR canary = 'y') AND {_CANARY}")
_search("missing_key_row_semantics", chain("OR", metric("click"), value("canary", "y")), f"{m1('metric', 'click')} OR canary = 'y'", compat=False)
_search("time_filter_boundary", metric("click"), m1("metric", "click"), start=1704153600, end=1704175200)
_search("time_filter_unaligned", metric("view"), m1("metric", "view"), start=1704161111, end=1704162222)
_search("group_by_one", metric("click"), m1("metric", "click"), ("band",), "band")
_search("group_by_two", metric("click"), m1("metric", "click"), ("host", "BAND"), "host || '|' || band")
_search("group_by_missing_value", metric("click"), m1("metric", "click"), ("vip",), f"CASE WHEN {_VIP} THEN coalesce(vip, '__no_data__') ELSE '' END")
_search("group_by_unknown_key", metric("click"), m1("metric", "click"), ("nosuchkey",))
_search("group_by_many_keys", metric("click"), m1("metric", "click"), ("vip|band",),
        f"band || CASE WHEN {_VIP} THEN '|' || coalesce(vip, '__no_data__') ELSE '' END")


def _catalog_query(f: Callable[[Catalog], DataFrame]) -> Query:
    return lambda spark, d: f(event_catalog(spark, d))


_CLICK, _CLICK_BAND = request(metric("click")), request(metric("click"), ("band",))

_add("tagkey_regex_any", _catalog_query(lambda c: timeseries.search(c, request(key(".*", True))).agg(F.count(F.lit(1)).alias("n"))), "SELECT CAST(0 AS BIGINT) AS n")
_add("group_sizes", _catalog_query(lambda c: timeseries.group_sizes(timeseries.search(c, _CLICK_BAND))),
     _sql(m1("metric", "click"), "band", select="SELECT grp, count(DISTINCT series_id) AS n_series FROM found GROUP BY grp"))
_add("group_merge_segments", _catalog_query(lambda c: timeseries.search(c, _CLICK_BAND).select(
    F.array_join("grp", "|").alias("grp"), "series_id", F.array_join(F.transform("epochs", lambda e: e.cast("string")), ",").alias("epochs"))),
     _sql(m1("metric", "click"), "band", select="SELECT grp, series_id, string_agg(DISTINCT CAST(epoch AS VARCHAR), ',' ORDER BY CAST(epoch AS VARCHAR)) AS epochs FROM found GROUP BY grp, series_id"))
_add("group_dict", _catalog_query(lambda c: timeseries.group_dictionary(timeseries.search(c, request(metric("click"), ("band", "host"))))),
     _sql(m1("metric", "click"), "band", select="SELECT DISTINCT shard, grp AS value FROM found UNION SELECT DISTINCT shard, host FROM m"))
_add("match_cardinality", _catalog_query(lambda c: timeseries.matching_rows(c, _CLICK).agg(F.count_distinct("series_id").alias("n"))),
     _matched(m1("metric", "click"), START, ALIGNED_END) + " SELECT count(DISTINCT series_id) AS n FROM m")
_add("segment_prune", _catalog_query(lambda c: c.segments_in(1704160800, 1704250800)),
     f"{_BASE} SELECT DISTINCT shard, segment FROM se WHERE (1704160800 <= segment AND 1704250800 >= segment) OR (1704160800 >= segment AND 1704160800 <= segment + 86400)")
_add("segment_prune_without_duration", lambda spark, d: Catalog((c := event_catalog(spark, d)).series, c.manifest.withColumn("duration", F.lit(None).cast("int"))).segments_in(1704160800, 1704250800),
     f"{_BASE} SELECT DISTINCT shard, segment FROM se WHERE 1704160800 <= segment AND 1704250800 >= segment")
_add("uncommitted_segments_hidden", lambda spark, d: timeseries.summary(timeseries.search(
    Catalog((c := event_catalog(spark, d)).series, c.manifest.withColumn("committed", F.col("shard") % 3 != 0)), _CLICK)),
     _sql(f"{m1('metric', 'click')} AND shard % 3 <> 0"))

_add("discover_metrics", _catalog_query(lambda c: discovery.discover(c, request(value("host", "h1.*", True), kind="METRICS"))),
     _matched(m2("host", "h1.*"), START, ALIGNED_END) + " SELECT DISTINCT metric AS term FROM m")
_KEYS = "SELECT 'host' AS term FROM m UNION SELECT 'band' FROM m UNION SELECT 'vip' FROM m WHERE vip IS NOT NULL UNION SELECT 'canary' FROM m WHERE canary IS NOT NULL"
_add("discover_tag_keys", _catalog_query(lambda c: discovery.discover(c, request(metric("click"), kind="TAG_KEYS"))),
     _matched(m1("metric", "click"), START, ALIGNED_END) + f" {_KEYS}")
_add("discover_tag_values", _catalog_query(lambda c: discovery.discover(c, request(metric("click"), ("host",), "TAG_KEYS_AND_VALUES"))),
     _matched(m1("metric", "click"), START, ALIGNED_END) + " SELECT DISTINCT host AS term FROM m")
_add("term_cardinality", _catalog_query(lambda c: discovery.cardinality(c, request(metric("click"), ("host",), "TAG_KEYS_AND_VALUES"))),
     _matched(m1("metric", "click"), START, ALIGNED_END) + " SELECT host AS term, count(DISTINCT series_id) AS n FROM m GROUP BY host")
_add("all_metrics", _catalog_query(discovery.all_metrics), f"{_BASE} SELECT DISTINCT shard, segment, metric AS term FROM se")
_add("all_tagkeys", _catalog_query(discovery.all_tag_keys), _BASE + "".join(
    f" {'UNION' if i else ''} SELECT shard, segment, '{c}' AS term FROM se WHERE {c} IS NOT NULL" for i, c in enumerate(("host", "band", "vip", "canary"))))
_add("all_tagvalues", _catalog_query(lambda c: discovery.all_tag_values(c, "band")), f"{_BASE} SELECT DISTINCT shard, segment, band AS term FROM se")


def _keys_of(f: dict) -> Callable[[Catalog], DataFrame]:
    return lambda c: timeseries.matching_rows(c, request(f))


def _setop(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return _catalog_query(lambda c: op(_keys_of(metric("click|view"))(c), _keys_of(value("band", "b1"))(c)))


for _name, _op, _where in (
    ("set_union", setops.union, "{0} OR {1}"), ("set_intersection", setops.intersection, "{0} AND {1}"), ("set_and_not", setops.and_not, "{0} AND NOT {1}"),
):
    _add(_name, _setop(_op), _matched(_where.format(m1("metric", "click|view"), m1("band", "b1")), START, ALIGNED_END) + " SELECT DISTINCT shard, segment, series_id FROM m")

_add("shard_route", lambda spark, d: ingest.route(event_records(spark, d), SHARDS).groupBy("shard").agg(F.count(F.lit(1)).alias("n")),
     f"{_BASE} SELECT CAST(abs(series_id % 10) AS INTEGER) AS shard, count(*) AS n FROM r GROUP BY 1")
_add("shard_assignment", _catalog_query(lambda c: c.shards.where(assigned(F.col("shard"), 5, 1))),
     f"{_BASE} SELECT DISTINCT shard FROM se WHERE shard % 5 = 1")
_add("ingest_dedup", lambda spark, d: ingest.build_segments(event_records(spark, d), SHARDS, FULL).groupBy("shard", "segment").agg(
    F.count(F.lit(1)).alias("n_series"), F.sum(F.size("epochs")).alias("n_epochs"), F.min("metric").alias("min_metric"), F.sum(F.size("tags")).alias("n_tags")),
     f"""{_BASE} SELECT shard, segment, count(DISTINCT series_id) AS n_series, count(*) AS n_epochs, min(metric) AS min_metric,
     (SELECT CAST(sum(2 + (x.vip IS NOT NULL)::INT + (x.canary IS NOT NULL)::INT) AS BIGINT) FROM (SELECT DISTINCT shard, segment, series_id, vip, canary FROM se) x
      WHERE x.shard = se.shard AND x.segment = se.segment) AS n_tags FROM se GROUP BY shard, segment""")
_add("epoch_bucket", lambda spark, d: event_records(spark, d).select(
    epoch_bucket(F.col("batch"), floor_to(F.col("batch"), FULL)).alias("epoch")).groupBy("epoch").agg(F.count(F.lit(1)).alias("n")),
     f"{_BASE} SELECT segment + ((batch - segment) // 21600) * 21600 AS epoch, count(*) AS n FROM r GROUP BY 1")
_add("ingest_terms", lambda spark, d: ingest.terms(event_catalog(spark, d).rows).groupBy("field", "tag_key").agg(F.count(F.lit(1)).alias("n")),
     _BASE + ", t AS (SELECT DISTINCT shard, segment, 'metric' AS field, NULL::VARCHAR AS tag_key, metric AS term FROM se" + "".join(
         f" UNION SELECT DISTINCT shard, segment, 'tag_value', '{c}', {c} FROM se WHERE {c} IS NOT NULL UNION SELECT DISTINCT shard, segment, 'tag_key', NULL, '{c}' FROM se WHERE {c} IS NOT NULL"
         for c in ("host", "band", "vip", "canary")) + ") SELECT field, tag_key, count(*) AS n FROM t GROUP BY field, tag_key")

_TWO_DAYS = 2 * FULL
_add("compact_two", _catalog_query(lambda c: compaction.compact(c.rows, floor_to(F.col("segment"), _TWO_DAYS)).groupBy("shard", "segment").agg(
    F.count(F.lit(1)).alias("n_series"), F.sum(F.size("epochs")).alias("n_epochs"))),
     f"""{_BASE}, c AS (SELECT DISTINCT shard, segment - segment % {_TWO_DAYS} AS segment, series_id, epoch FROM se)
     SELECT shard, segment, count(DISTINCT series_id) AS n_series, count(*) AS n_epochs FROM c GROUP BY shard, segment""")
_NOW = 1704067200 + 20 * FULL
_PICK = f""", p AS (SELECT shard, segment, row_number() OVER (PARTITION BY shard ORDER BY segment) AS rk FROM (SELECT DISTINCT shard, segment FROM se WHERE {_NOW} - segment > 7 * 86400)),
f AS (SELECT shard, min(segment) AS target, count(*) AS n FROM p WHERE rk <= 7 GROUP BY shard HAVING count(*) = 7)"""
_add("rollup_candidates", _catalog_query(lambda c: compaction.rollup_candidates(c.manifest, 7, _NOW)),
     f"{_BASE}{_PICK} SELECT shard, segment, CAST(86400 AS INTEGER) AS duration, target FROM p JOIN f USING (shard) WHERE rk <= 7")
_add("rollup_week", _catalog_query(lambda c: compaction.rollup(c, 7, _NOW)[0].select(
    "shard", "segment", "series_id", F.array_join(F.transform("epochs", lambda e: e.cast("string")), ",").alias("epochs"))),
     f"""{_BASE}{_PICK} SELECT shard, target AS segment, series_id, string_agg(DISTINCT CAST(target + ((epoch - target) // 21600) * 21600 AS VARCHAR), ',' ORDER BY CAST(target + ((epoch - target) // 21600) * 21600 AS VARCHAR)) AS epochs
     FROM se JOIN p USING (shard, segment) JOIN f USING (shard) WHERE rk <= 7 GROUP BY shard, target, series_id""")
_add("rollup_manifest", _catalog_query(lambda c: compaction.rollup(c, 7, _NOW)[1].select("shard", "segment", "duration", "merged_segments")),
     f"""{_BASE}{_PICK} SELECT shard, target AS segment, CAST(7 * 86400 AS INTEGER) AS duration, string_agg(CAST(segment AS VARCHAR), ',' ORDER BY segment) AS merged_segments
     FROM p JOIN f USING (shard) WHERE rk <= 7 GROUP BY shard, target""")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
