"""Registered queries on training data, with SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofind.llm import distinct, leaks, pairs, sampling, seen, terms, tokenize, truncation
from chronofind.session import materialise, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

DAY = 86_400
#: Share of series in the sample.
RATE = Fraction(1, 10)
#: Percents of the records after which p1_kept looks at the sample again.
GROWTH = (25, 50, 90, 95, 100)
#: Batches in which records arrive at the filter of earlier keys.
ARRIVALS = 4
#: Thresholds of reported pairs: rows that hold both, and times as often as by chance.
TOGETHER, LIFT = 12, 8
#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1. Sample


def _arriving(records: DataFrame) -> DataFrame:
    return records.select(F.col("xx_hash").alias("key"), F.col("record_id").alias("order"))


def grown_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, priority, step, chosen: every series seen, in the step that first saw it. The ledger of closed
    steps is stored by the table's folder; a later run reads it, keeps it and appends what closed since."""
    return sampling.kept(spark, sampling.ledger_path(spark, sf_dir), _arriving(_table(spark, sf_dir, "records")), RATE)


def ledger_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """percent, n_keys, n_chosen, n_lost: the ledger stored in a new folder as the records arrive; n_lost are
    keys that an earlier look found chosen and this one doesn't."""
    records = _table(spark, sf_dir, "records")
    path, last, before, out = scratch_path(spark, "ledger"), records.agg(F.max("record_id")).first()[0] or 0, None, None
    for percent in GROWTH:
        now = materialise(sampling.kept(spark, path, _arriving(records.where(F.col("record_id") <= last * percent // 100)), RATE), "p1-look")
        lost = F.lit(0).cast("bigint") if before is None else F.lit(before.join(now.where("chosen"), "key", "left_anti").count())
        row = now.agg(F.lit(percent).alias("percent"), F.count(F.lit(1)).alias("n_keys"), F.count_if("chosen").alias("n_chosen"), lost.alias("n_lost"))
        out, before = row if out is None else out.union(row), now.where("chosen").select("key")
    return out


def sampled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "records").select("record_id", "xx_hash")
    return sampling.sample(rows, "xx_hash", grown_ledger(spark, sf_dir))


# 2. Distinct counts

_GROUPS = ["what", "day", "ns", "metric"]


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what, day, ns, metric, value: the series of records, their metrics, and the series of timeseries."""
    r = _table(spark, sf_dir, "records")
    t = _table(spark, sf_dir, "timeseries")
    row = lambda df, what, epoch, metric, value: df.select(
        F.lit(what).alias("what"), F.expr(f"{epoch} div {DAY}").alias("day"), "ns", metric.alias("metric"), value.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    return (row(r, "xx_hash", "batch_epoch", F.col("metric"), F.col("xx_hash"))
            .union(row(r, "metric", "batch_epoch", none, F.col("metric")))
            .union(row(t, "timeseries_id", "epoch", F.col("metric"), F.col("timeseries_id"))))


def day_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest sketches, from which all others are merged; written to the shared folder."""
    return materialise(distinct.sketch(_identifiers(spark, sf_dir), _GROUPS, F.col("value")), "p2-sketches")


_LEVELS = {"day_ns_metric": ("day", "ns", "metric"), "ns_metric": ("ns", "metric"), "day_metric": ("day", "metric"), "day_ns": ("day", "ns"),
           "metric": ("metric",), "day": ("day",), "ns": ("ns",), "all": ()}


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, what, day, ns, metric, estimate, lower, upper: by day, by ns, by metric, by each two of them, by
    all three, and in total. Each level is merged from finer sketches. Metrics as identifiers have no
    metric to be grouped by."""
    finest = day_sketches(spark, sf_dir)
    merged = lambda source, *group: distinct.merge(source, ["what", *group])
    by_metric, by_day_ns = materialise(merged(finest, "ns", "metric"), "p2-metric"), materialise(merged(finest, "day", "ns"), "p2-day")
    ready = {"day_ns_metric": finest, "ns_metric": by_metric, "day_metric": merged(finest, "day", "metric"), "day_ns": by_day_ns,
             "metric": merged(by_metric, "metric"), "day": merged(by_day_ns, "day"), "ns": merged(by_metric, "ns"), "all": merged(by_day_ns)}
    out = None
    for name, sketches in ready.items():
        columns = [F.col(c) if c in ("what", *_LEVELS[name]) else F.lit(None).cast(finest.schema[c].dataType).alias(c) for c in _GROUPS]
        rows = distinct.with_estimates(sketches.select(F.lit(name).alias("level"), *columns, "hashes")).drop("hashes")
        out = rows if out is None else out.union(rows)
    return out


def combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, what, day, ns, metric: estimates of the identifiers of a group or of the next one, of both, and of
    one only. The next one is the next day (day: over everything; day_ns_metric: of each namespace and
    metric) or the namespace next by name (ns). Groups without a next one have no row."""
    finest = day_sketches(spark, sf_dir)
    day = materialise(distinct.merge(finest, ["what", "day"]), "p2-days")
    ns = distinct.merge(finest, ["what", "ns"]).where(F.col("ns").isNotNull())
    # There are as many namespaces as the settings name.
    order = Window.partitionBy("what").orderBy("ns")
    ns = materialise(ns.select("what", "ns", F.row_number().over(order).cast("bigint").alias("day"), "hashes"), "p2-ns")
    out = None
    for level, groups in (("day", day), ("day_ns_metric", finest), ("ns", ns)):
        missing = [F.lit(None).cast("string").alias(c) for c in ("ns", "metric") if c not in groups.columns]
        groups = groups.select("*", *missing).select("what", "day", "ns", "metric", "hashes")
        after = groups.select(F.col("what").alias("w"), (F.col("day") - 1).alias("d"), F.col("ns").alias("n"), F.col("metric").alias("m"), F.col("hashes").alias("after"))
        same = (F.col("what") == F.col("w")) & (F.col("day") == F.col("d")) & F.col("metric").eqNullSafe(F.col("m"))
        same = same if level == "ns" else same & F.col("ns").eqNullSafe(F.col("n"))
        joined = groups.join(after, same).drop("w", "d", "n", "m")
        rows = distinct.combined(joined, F.col("hashes"), F.col("after")).drop("hashes", "after")
        rows = rows.withColumn("day", F.lit(None).cast("bigint")) if level == "ns" else rows
        rows = rows.select(F.lit(level).alias("level"), *rows.columns)
        out = rows if out is None else out.union(rows)
    return out


# 3. Terms


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "records")
    return terms.marked(terms.frequencies(records), records.count())


def marked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "term", "mark")


# 5. Pairs


def pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two tags that stand together in any row, with lift and pmi."""
    records = _table(spark, sf_dir, "records")
    counted = pairs.pair_counts(records, pairs.marginals(records), 1)
    return pairs.with_association(counted, records.count())


def associated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "records")
    counted = pairs.pair_counts(records, pairs.marginals(records), TOGETHER)
    return pairs.associated(counted, records.count(), LIFT).select("item_a", "item_b")


# 6. Seen before


def _arrivals(records: DataFrame) -> list[tuple[int, int]]:
    low, high = records.agg(F.min("record_id"), F.max("record_id")).first()
    if low is None:
        return [(0, 1)]
    edges = [low + (high + 1 - low) * i // ARRIVALS for i in range(ARRIVALS + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def repeated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "records").select("record_id", "xx_hash")
    stored = _table(spark, sf_dir, "tags_and_timestamp").select(F.col("xx_hash").alias("key"))
    parts = seen.parts_for(stored.count() + records.count())
    new = seen.firsts(records, "xx_hash", "record_id", stored, parts, _arrivals(records))
    return seen.seen_before(records, new, "xx_hash", "record_id").select("record_id")


def probed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_probed, n_absent, within: what p6_error measured on, and whether the rate keeps to ten times what
    fingerprints of this length let expect for the indexes probed."""
    expected = ARRIVALS * 2.0**-seen.FINGERPRINT_BITS
    return wrong_answers(spark, sf_dir).select("n_probed", "n_absent", (F.col("n_wrong") <= F.ceil(10 * expected * F.col("n_absent"))).alias("within"))


def wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "records").select("record_id", "xx_hash")
    stored = _table(spark, sf_dir, "tags_and_timestamp").select(F.col("xx_hash").alias("key"))
    parts = seen.parts_for(stored.count() + records.count())
    answered = seen.answers(records, "xx_hash", "record_id", stored, parts, _arrivals(records))
    return seen.answers_error_rate(answered, records, "xx_hash", "record_id", stored)


# 8. Tokens


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


# 9. Leaks


def leak_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


# 10. Truncation


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(materialise(truncation.features(_table(spark, sf_dir, "documents")), "p10-features"))


def cut_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("truncated").select("doc_id")


def cut_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.by_source(_judged(spark, sf_dir))


def measured_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.length_counts(materialise(truncation.features(_table(spark, sf_dir, "documents")), "p10-features"))


def field_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.limits(materialise(truncation.features(_table(spark, sf_dir, "documents")), "p10-features"))


def queries() -> dict[str, Query]:
    return {
        "p1_sample": sampled_records,
        "p1_ledger": grown_ledger,
        "p1_kept": ledger_growth,
        "p2_distinct": distinct_counts,
        "p2_combined": combined_days,
        "p3_found": marked_terms,
        "p3_terms": term_counts,
        "p5_found": associated_pairs,
        "p5_pairs": pair_report,
        "p6_found": repeated_records,
        "p6_error": wrong_answers,
        "p6_probed": probed_answers,
        "p8_ids": token_ids,
        "p9_found": leaked,
        "p9_spans": leak_spans,
        "p10_found": cut_documents,
        "p10_sources": cut_shares,
        "p10_limits": field_limits,
        "p10_lengths": measured_lengths,
    }


def _ledger_sql(records: str) -> str:
    """Steps, counts and ledger of a table of records. The sample of closed steps is short by the greatest
    lack of any of them so far, which is what is filled up."""
    limit, goal = sampling.limit_of(RATE), f"CAST(ceil(total * {RATE.numerator} / {RATE.denominator}) AS BIGINT)"
    return f"""
k AS (SELECT xx_hash AS key, min(record_id) AS o FROM {records} WHERE xx_hash IS NOT NULL GROUP BY 1),
p AS (SELECT key, CASE WHEN o < {sampling.FIRST} THEN 0 ELSE CAST(floor(log2(o)) AS INTEGER) - {sampling.FIRST.bit_length() - 2} END AS step, CAST('0x' || substr(md5(CAST(key AS VARCHAR)), 1, 15) AS BIGINT) AS priority FROM k),
o AS (SELECT CASE WHEN max(record_id) < {sampling.FIRST} THEN 0 ELSE CAST(floor(log2(max(record_id))) AS INTEGER) - {sampling.FIRST.bit_length() - 2} END AS last FROM {records} WHERE xx_hash IS NOT NULL),
n AS (SELECT step, count(*) AS n, count(*) FILTER (priority < {limit}) AS below, sum(count(*)) OVER (ORDER BY step) AS total, sum(count(*) FILTER (priority < {limit})) OVER (ORDER BY step) AS cut FROM p GROUP BY step),
f AS (SELECT *, greatest(0, max({goal} - cut) OVER (ORDER BY step)) AS filled FROM n, o WHERE step < last),
q AS (SELECT step, below + filled - coalesce(lag(filled) OVER (ORDER BY step), 0) AS quota FROM f),
ledger AS (SELECT key, priority, CAST(p.step AS INTEGER) AS step, priority < {limit} OR coalesce(row_number() OVER (PARTITION BY p.step ORDER BY priority, key) <= quota, false) AS chosen FROM p LEFT JOIN q USING (step))"""


_LEDGER = _ledger_sql("records")


def _growth_sql() -> str:
    looks = []
    for percent in GROWTH:
        part = f"(SELECT * FROM records WHERE record_id <= (SELECT max(record_id) FROM records) * {percent} // 100)"
        looks.append(f"SELECT * FROM (WITH {_ledger_sql(part)} SELECT CAST({percent} AS INTEGER) AS percent, count(*) AS n_keys, count(*) FILTER (chosen) AS n_chosen, CAST(0 AS BIGINT) AS n_lost FROM ledger)")
    return " UNION ALL ".join(looks)


_TERMS = """
i AS (SELECT 'metric' AS field, metric AS term, 1 AS n FROM records WHERE metric IS NOT NULL
  UNION ALL SELECT 'tag_key', unnest(map_keys(tags)), 1 FROM records
  UNION ALL SELECT 'tag_value', v, count(*) FROM (SELECT record_id, unnest(map_values(tags)) AS v FROM records) WHERE v IS NOT NULL GROUP BY record_id, v),
c AS (SELECT field, term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS n_rows FROM i GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN n_rows <= 2 THEN 'rare' WHEN n_rows * 100 > (SELECT count(*) FROM records) * 30 THEN 'common' END AS mark FROM c)"""

_PAIRS = """
i AS (SELECT record_id, unnest(list_distinct(list_transform(list_filter(map_entries(tags), lambda e: e.value IS NOT NULL), lambda e: e.key || '=' || e.value))) AS item FROM records),
s AS (SELECT item, count(*) AS n FROM i GROUP BY 1),
t AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS together FROM i a JOIN i b ON a.record_id = b.record_id AND a.item < b.item GROUP BY 1, 2),
r AS (SELECT t.*, x.n AS n_a, y.n AS n_b, (SELECT count(*) FROM records) AS total FROM t JOIN s x ON t.item_a = x.item JOIN s y ON t.item_b = y.item)"""

_LEAKS = f"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dw AS (SELECT doc_id, i, array_to_string(w[i:i + {leaks.WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {leaks.WORDS - 2})) AS i FROM w)),
ew AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {leaks.WORDS - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {leaks.WORDS - 2})) AS i FROM e)),
l AS (SELECT doc_id, item_id, i FROM dw JOIN ew USING (g))"""

_VALUES = f"""
v AS (SELECT 'xx_hash' AS what, batch_epoch // {DAY} AS day, ns, metric, CAST(xx_hash AS VARCHAR) AS value FROM records
  UNION ALL SELECT 'metric', batch_epoch // {DAY}, ns, NULL, metric FROM records
  UNION ALL SELECT 'timeseries_id', epoch // {DAY}, ns, metric, CAST(timeseries_id AS VARCHAR) FROM timeseries),
h AS (SELECT DISTINCT what, day, ns, metric, CAST('0x' || substr(md5(value), 1, 15) AS BIGINT) AS h FROM v WHERE value IS NOT NULL)"""


def _estimates() -> str:
    parts = []
    for name, group in _LEVELS.items():
        columns = ", ".join(c if c in group else f"CAST(NULL AS {'BIGINT' if c == 'day' else 'VARCHAR'}) AS {c}" for c in ("day", "ns", "metric"))
        keys = ", ".join(("what", *group))
        parts.append(f"SELECT '{name}' AS level, what, {columns}, count(*) AS n, max(h) AS last FROM (SELECT {keys}, h FROM (SELECT DISTINCT {keys}, h FROM h) "
                     f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY h) <= {distinct.K}) GROUP BY {keys}")
    error = distinct.Z / (distinct.K - 2) ** 0.5
    return f"""WITH {_VALUES}, s AS ({' UNION ALL '.join(parts)}),
        e AS (SELECT *, CASE WHEN n < {distinct.K} THEN CAST(n AS DOUBLE) ELSE {(distinct.K - 1) * distinct.SPACE!r}::DOUBLE / CAST(last AS DOUBLE) END AS e FROM s)
        SELECT level, what, day, ns, metric, CAST(round(e) AS BIGINT) AS estimate,
          CAST(round(CASE WHEN n < {distinct.K} THEN e ELSE e / {1 + error!r}::DOUBLE END) AS BIGINT) AS lower,
          CAST(round(CASE WHEN n < {distinct.K} THEN e ELSE e / {1 - error!r}::DOUBLE END) AS BIGINT) AS upper FROM e"""


def _combinations() -> str:
    k, parts = distinct.K, []
    for name, group in (("day", ("what", "day")), ("day_ns_metric", ("what", "day", "ns", "metric"))):
        keys = ", ".join(group)
        parts.append(f"SELECT '{name}' AS level, what, day, {'ns, metric' if 'ns' in group else 'NULL::VARCHAR AS ns, NULL::VARCHAR AS metric'}, h FROM (SELECT DISTINCT {keys}, h FROM h) "
                     f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY h) <= {k}")
    # Namespaces are numbered by name, so that the next one is found as the next day is.
    parts.append(f"SELECT 'ns' AS level, what, number AS day, NULL::VARCHAR AS ns, NULL::VARCHAR AS metric, h FROM (SELECT DISTINCT what, ns, h FROM h) JOIN names USING (what, ns) "
                 f"QUALIFY row_number() OVER (PARTITION BY what, ns ORDER BY h) <= {k}")
    g = "level, what, day, ns, metric"
    error, z, z2 = distinct.Z / (k - 2) ** 0.5, f"{distinct.Z!r}::DOUBLE", f"{distinct.Z * distinct.Z!r}::DOUBLE"
    columns = []
    for name, count in (("union", "n"), ("intersection", "nab"), ("only_a", "na"), ("only_b", "nb")):
        p = f"(CAST({count} AS DOUBLE) / n)"
        middle = f"({p} + {z2} / (n * 2.0::DOUBLE)) / (1.0::DOUBLE + {z2} / n)"
        spread = f"{z} * sqrt({p} * (1.0::DOUBLE - {p}) / n + {z2} / (n * n * 4.0::DOUBLE)) / (1.0::DOUBLE + {z2} / n)"
        low, high = ("1.0::DOUBLE", "1.0::DOUBLE") if name == "union" else (f"greatest(0.0::DOUBLE, {middle} - {spread})", f"least(1.0::DOUBLE, {middle} + {spread})")
        columns.append(f"CAST(round({p} * t) AS BIGINT) AS n_{name}, CAST(round(CASE WHEN exact THEN {p} * t ELSE {low} * (t / {1 + error!r}::DOUBLE) END) AS BIGINT) AS {name}_lower, "
                       f"CAST(round(CASE WHEN exact THEN {p} * t ELSE {high} * (t / {1 - error!r}::DOUBLE) END) AS BIGINT) AS {name}_upper")
    return f"""WITH {_VALUES}, names AS (SELECT what, ns, row_number() OVER (PARTITION BY what ORDER BY ns) AS number FROM (SELECT DISTINCT what, ns FROM h WHERE ns IS NOT NULL)),
        s AS ({' UNION ALL '.join(parts)}),
        z AS (SELECT {g}, count(*) AS size FROM s GROUP BY {g}),
        pr AS (SELECT a.level, a.what, a.day, a.ns, a.metric, a.size AS sa, b.size AS sb FROM z a JOIN z b ON a.level = b.level AND a.what = b.what AND a.day + 1 = b.day
               AND a.ns IS NOT DISTINCT FROM b.ns AND a.metric IS NOT DISTINCT FROM b.metric),
        m AS (SELECT {g}, h, bool_or(ina) AS ina, bool_or(NOT ina) AS inb FROM (SELECT {g}, h, true AS ina FROM s UNION ALL SELECT level, what, day - 1, ns, metric, h, false FROM s) GROUP BY {g}, h),
        j AS (SELECT pr.*, m.h, m.ina, m.inb FROM pr JOIN m ON pr.level = m.level AND pr.what = m.what AND pr.day = m.day AND pr.ns IS NOT DISTINCT FROM m.ns AND pr.metric IS NOT DISTINCT FROM m.metric
              QUALIFY row_number() OVER (PARTITION BY pr.level, pr.what, pr.day, pr.ns, pr.metric ORDER BY m.h) <= {k}),
        c AS (SELECT {g}, any_value(sa) AS sa, any_value(sb) AS sb, CAST(count(*) AS DOUBLE) AS n, max(h) AS last, count(*) FILTER (ina AND inb) AS nab, count(*) FILTER (NOT inb) AS na, count(*) FILTER (NOT ina) AS nb FROM j GROUP BY {g}),
        e AS (SELECT *, CASE WHEN n < {k} THEN n ELSE {(k - 1) * distinct.SPACE!r}::DOUBLE / CAST(last AS DOUBLE) END AS t, sa < {k} AND sb < {k} AND n < {k} AS exact FROM c)
        SELECT level, e.what, CASE WHEN level <> 'ns' THEN day END AS day, coalesce(e.ns, names.ns) AS ns, metric, {", ".join(columns)}
        FROM e LEFT JOIN names ON level = 'ns' AND e.what = names.what AND e.day = names.number"""


def _lengths() -> str:
    """Counts of lengths, by part and form."""
    count = lambda x: f"len(regexp_extract_all(t, '{x}'))"
    entities = f"4 * {count('&')} + 3 * {count('[<>]')}"
    astral, escaped = count(r"[\x{10000}-\x{10FFFF}]"), count(r'["\\\n\r\t\x08\f]') + " + 5 * " + count(r"[\x{00}-\x{07}\x{0B}\x{0E}-\x{1F}]")
    alone = f"{count(chr(92) + 'n')} - {count(chr(92) + 'r' + chr(92) + 'n')}"
    forms = {"chars": "length(t)", "utf8": "strlen(t)", "utf16": f"length(t) + {astral}", "entities": f"length(t) + {entities}", "entities_utf8": f"strlen(t) + {entities}",
             "json": f"length(t) + {escaped}", "json_ascii": f"length(t) + {escaped} + 5 * {count(r'[^\x{00}-\x{7E}]')} + 6 * {astral}", "json_utf8": f"strlen(t) + {escaped}",
             "crlf": f"length(t) + {alone}", "crlf_utf8": f"strlen(t) + {alone}"}
    rows = " UNION ALL ".join(f"SELECT source, part, '{form}' AS form, CAST({sql} AS BIGINT) AS \"at\" FROM p" for form, sql in forms.items())
    return f"""WITH d AS (SELECT source, text AS t FROM documents WHERE regexp_matches(text, '\\S')),
        p AS (SELECT source, 'text' AS part, t FROM d UNION ALL SELECT source, 'message', split_part(t, chr(10) || 'diff --git ', 1) FROM d WHERE contains(t, chr(10) || 'diff --git ')),
        l AS ({rows}) SELECT source, part, form, "at", count(*) AS here FROM l GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p10_lengths": _lengths(),
        "p1_sample": f"WITH {_LEDGER} SELECT r.record_id, r.xx_hash, l.step AS sample_step FROM records r JOIN ledger l ON r.xx_hash = l.key WHERE chosen",
        "p1_ledger": f"WITH {_LEDGER} SELECT key, priority, step, chosen FROM ledger",
        "p1_kept": _growth_sql(),
        "p2_distinct": _estimates(),
        "p2_combined": _combinations(),
        "p3_found": f"WITH {_TERMS} SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
        "p3_terms": f"WITH {_TERMS} SELECT field, term, occurrences, n_rows, mark FROM m",
        "p5_found": f"WITH {_PAIRS} SELECT item_a, item_b FROM r WHERE together >= {TOGETHER} AND CAST(together AS HUGEINT) * total >= CAST({LIFT} AS HUGEINT) * n_a * n_b",
        "p5_pairs": f"""WITH {_PAIRS} SELECT item_a, item_b, together, n_a, n_b, CAST(together AS DOUBLE) * CAST(total AS DOUBLE) / (CAST(n_a AS DOUBLE) * CAST(n_b AS DOUBLE)) AS lift,
            log2(CAST(together AS DOUBLE) * CAST(total AS DOUBLE) / (CAST(n_a AS DOUBLE) * CAST(n_b AS DOUBLE))) AS pmi FROM r""",
        "p6_found": """SELECT record_id FROM (SELECT record_id, xx_hash, min(record_id) OVER (PARTITION BY xx_hash) AS first FROM records WHERE xx_hash IS NOT NULL)
            WHERE record_id > first OR xx_hash IN (SELECT xx_hash FROM tags_and_timestamp WHERE xx_hash IS NOT NULL)""",
        "p6_probed": """WITH k AS (SELECT DISTINCT xx_hash FROM records WHERE xx_hash IS NOT NULL)
            SELECT count(*) AS n_probed, count(*) FILTER (xx_hash NOT IN (SELECT xx_hash FROM tags_and_timestamp WHERE xx_hash IS NOT NULL)) AS n_absent, true AS within FROM k""",
        "p9_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM l",
        "p9_spans": f"""WITH {_LEAKS}, b AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) > {leaks.WORDS} AS fresh FROM l),
            s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS span FROM b)
            SELECT doc_id, item_id, min(i) - 1 AS first_word, max(i) + {leaks.WORDS - 2} AS last_word FROM s GROUP BY doc_id, item_id, span""",
    }
