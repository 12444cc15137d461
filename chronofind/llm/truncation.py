"""Text cut off by field limits: hidden limits from lengths, notices from the texts at them, broken endings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofind.llm.endings import DIFF, is_cut
from chronofind.session import materialise

#: Forms in which a store may have measured a text, and parts of it that may have a field of their own.
FORMS = ("chars", "utf8", "utf16", "entities", "entities_utf8", "json", "json_ascii", "json_utf8", "crlf", "crlf_utf8")
PARTS = ("text", "message")
LENGTHS = tuple(f"{part}_{form}" for part in PARTS for form in FORMS)

#: A length is a limit where at least MIN_AT different texts of a source have it, PEAK times as many as have
#: each of the NEAR lengths on either side on average. Either at most TAIL of them as many are longer, or at
#: least CUT of the texts there break off by their endings.
MIN_AT, PEAK, NEAR, TAIL, CUT = 4, 20, 50, 0.1, 0.5
#: Share of the texts at a limit that must end in the same mark for it to be a notice of the cut.
MARKED = 0.5

_MARK = re.compile(r"[\[(<{][^\[\](){}<>\n]{2,40}[\])>}]\s*\Z")


def _counts(part: str) -> dict[str, Column]:
    """What the forms are made of. Rare characters are counted only in texts that hold any."""
    text, chars, size, strange = (F.col(f"__{part}{n}") for n in ("", "_chars", "_size", "_strange"))
    without = lambda c: chars - F.length(F.replace(text, F.lit(c), F.lit("")))
    matching = lambda pattern: chars - F.length(F.regexp_replace(text, pattern, ""))
    none = chars * 0
    foreign = lambda pattern: F.when(size > chars, matching(pattern)).otherwise(none)
    control, short = r"[\x00-\x07\x0B\x0E-\x1F]", r"[\x08\x0C]"
    rare = lambda pattern: F.when(strange, matching(pattern)).otherwise(none)
    return {"chars": chars, "size": size, "amp": without("&"), "angle": without("<") + without(">"), "lf": without("\n"), "cr": without("\r"), "crlf": without("\r\n"),
            "pair": without('"') + without("\\") + without("\t") + rare(short), "control": rare(control), "astral": foreign(r"[\x{10000}-\x{10FFFF}]"),
            "wide": foreign(r"[^\x00-\x7F]") + rare(r"\x7F")}


def _forms(n: Callable[[str], Column]) -> dict[str, Column]:
    """The length in each of FORMS: as it is, in bytes, with entities, as a JSON string, with CRLF."""
    entities, escaped, alone = 4 * n("amp") + 3 * n("angle"), n("pair") + n("lf") + n("cr") + 5 * n("control"), n("lf") - n("crlf") / 2
    found = {"chars": n("chars"), "utf8": n("size"), "utf16": n("chars") + n("astral"), "entities": n("chars") + entities, "entities_utf8": n("size") + entities,
             "json": n("chars") + escaped, "json_ascii": n("chars") + escaped + 5 * n("wide") + 6 * n("astral"), "json_utf8": n("size") + escaped,
             "crlf": n("chars") + alone, "crlf_utf8": n("size") + alone}
    return {form: found[form].cast("bigint") for form in FORMS}


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut, ended, mark = [], [], []
        for text in batch.column("text").to_pylist():
            blank = text is None or not text.strip()
            cut.append(not blank and is_cut(text))
            ended.append(blank or text.endswith(("\n", "\r")))
            found = None if blank else _MARK.search(text[-60:])
            mark.append(found[0].rstrip() if found else None)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(cut, pa.bool_()), pa.array(ended, pa.bool_()), pa.array(mark, pa.string())], names=[*names, "cut", "ended", "mark"])


def features(documents: DataFrame) -> DataFrame:
    """doc_id, source, hash, LENGTHS, cut (by its ending), ended (by a line end), mark (a bracketed run at the
    very end). Lengths are measured in the JVM, endings text by text; those of null and blank texts are null,
    and such texts are never cut. A text without a diff is all text and has no message length."""
    # One step at a time, so that nothing is worked out twice.
    rows = documents.select("doc_id", "source", "text", F.xxhash64("text").alias("hash"), F.when(F.col("text").rlike(r"\S"), F.col("text")).alias("__text"))
    rows = rows.withColumn("__message", F.when(F.instr("__text", DIFF) > 0, F.substring_index("__text", DIFF, 1)))
    kept = ["doc_id", "source", "text", "hash"]
    for part in PARTS:
        text = F.col(f"__{part}")
        rows = rows.withColumns({f"__{part}_chars": F.length(text), f"__{part}_size": F.octet_length(text), f"__{part}_strange": text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")})
    rows = rows.select(*kept, *[c.alias(f"__{part}_{n}") for part in PARTS for n, c in _counts(part).items()])
    rows = rows.select(*kept, *[c.alias(f"{part}_{form}") for part in PARTS for form, c in _forms(lambda n, p=part: F.col(f"__{p}_{n}")).items()])
    schema = "doc_id bigint, source string, hash bigint, " + ", ".join(f"{n} bigint" for n in LENGTHS) + ", cut boolean, ended boolean, mark string"
    return rows.mapInArrow(_endings, schema)


def length_counts(measured: DataFrame) -> DataFrame:
    """source, part, form, at, here: how many texts of each source have each length; counted map-side first."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("at")) for n in LENGTHS]))
    counts = measured.select("source", each.alias("x")).select("source", "x.*").where(F.col("at").isNotNull()).groupBy("source", "name", "at").agg(F.count(F.lit(1)).alias("here"))
    return counts.select("source", F.substring_index("name", "_", 1).alias("part"), F.regexp_replace("name", "^[a-z]+_", "").alias("form"), "at", "here")


def _value(part: Column, form: Column) -> Column:
    """The length that a row has in the named part and form."""
    name = F.concat_ws("_", part, form)
    return F.coalesce(*[F.when(name == n, F.col(n)) for n in LENGTHS])


def limits(measured: DataFrame) -> DataFrame:
    """source, part, form, at, n_texts: each source's field limits, however many it has.

    A limit shows as a peak in the counts of lengths. Peaks of one text repeated are none: at those that
    stand out, different texts are counted. A limit in one form makes lower peaks in others, too; each text
    speaks for the highest peak that it stands at (ties go to the first of PARTS and FORMS), and a peak is
    a limit if most of its texts speak for it. A null source has its own limits, like any other.
    """
    ordered = Window.partitionBy("source", "part", "form").orderBy("at")
    around = lambda a, b: F.coalesce(F.sum("here").over(ordered.rangeBetween(a, b)), F.lit(0))
    seen = length_counts(measured).select("*", around(1, Window.unboundedFollowing).alias("beyond"), around(-NEAR, -1).alias("below"), around(1, NEAR).alias("above"))
    stands_out = (F.col("here") >= MIN_AT) & (F.col("here") * NEAR >= PEAK * F.greatest("below", "above"))
    peaks = seen.where(stands_out).select(F.col("source").alias("s"), "part", "form", "at", (F.col("beyond") <= TAIL * F.col("here")).alias("last"))
    peaks = materialise(peaks, "p10-peaks")
    at = measured.join(peaks, F.col("source").eqNullSafe(F.col("s")) & (_value(F.col("part"), F.col("form")) == F.col("at")))
    texts = materialise(at.groupBy("source", "part", "form", "at", "last", "hash").agg(F.max("cut").alias("cut")), "p10-at-peaks")
    peak = ["source", "part", "form", "at"]
    real = texts.groupBy(*peak, "last").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut")).where(
        (F.col("n_texts") >= MIN_AT) & (F.col("last") | (F.col("n_cut") >= CUT * F.col("n_texts"))))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")) & (F.col("form") == F.col("f")) & (F.col("at") == F.col("a"))
    named = real.select(F.col("source").alias("s"), F.col("part").alias("p"), F.col("form").alias("f"), F.col("at").alias("a"), "n_texts")
    place = lambda names, column: F.array_position(F.array(*map(F.lit, names)), F.col(column))
    highest = Window.partitionBy("source", "hash").orderBy(F.desc("n_texts"), place(PARTS, "part"), place(FORMS, "form"), "at")
    spoken = texts.join(named, same).select(*peak, "n_texts", (F.row_number().over(highest) == 1).alias("own"))
    own = spoken.groupBy(*peak, "n_texts").agg(F.count_if("own").alias("n_own"))
    return own.where((F.col("n_own") >= MIN_AT) & (F.col("n_own") * 2 > F.col("n_texts"))).select(*peak, "n_texts")


def _at_limit(measured: DataFrame, found: DataFrame) -> DataFrame:
    """measured with at_limit: whether one of the lengths is a limit of the source."""
    # Written first, so that Spark knows the size of a few rows for each source and checks it before it broadcasts
    # them: rows of a source that holds most texts must not meet in one task.
    by_source = found.groupBy(F.col("source").alias("s")).agg(F.collect_list(F.struct("part", "form", "at")).alias("limits"))
    by_source = materialise(by_source, "p10-limits")
    joined = measured.join(by_source, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.withColumn("at_limit", F.coalesce(F.exists("limits", lambda x: _value(x["part"], x["form"]) == x["at"]), F.lit(False))).drop("s", "limits")


def notices(placed: DataFrame) -> DataFrame:
    """source, notice: marks in which at least MARKED of the texts at the source's limits end, different texts
    counted. placed: measured rows with at_limit."""
    at = placed.where("at_limit")
    total = at.groupBy(F.col("source").alias("s")).agg(F.count_distinct("hash").alias("total"))
    marks = at.where(F.col("mark").isNotNull()).groupBy("source", "mark").agg(F.count_distinct("hash").alias("n"))
    return marks.join(total, F.col("source").eqNullSafe(F.col("s"))).where((F.col("n") >= MIN_AT) & (F.col("n") >= MARKED * F.col("total"))).select("source", F.col("mark").alias("notice"))


def truncated(measured: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, source, cut, at_limit, noticed, truncated of every document.

    at_limit: a length of the text or its message is a limit of its source. Such a text is truncated
    unless it ends in whole lines, as one that was finished or filled up to the limit does; where its ending
    breaks off, even then. noticed: it ends in a notice that its source puts where it cuts at a limit. Texts
    elsewhere are truncated where their ending alone tells (cut).
    """
    placed = _at_limit(measured, limits(measured) if found is None else found)
    marks = materialise(notices(placed).select(F.col("source").alias("s"), "notice"), "p10-notices")
    judged = placed.join(marks, F.col("source").eqNullSafe(F.col("s")) & (F.col("mark") == F.col("notice")), "left")
    by_limit = F.col("at_limit") & (~F.col("ended") | F.col("cut"))
    noticed = F.col("notice").isNotNull()
    return judged.select("doc_id", "source", "cut", "at_limit", noticed.alias("noticed"), (by_limit | noticed | F.col("cut")).alias("truncated"))


def by_source(judged: DataFrame) -> DataFrame:
    """source, n, n_cut, n_limit, n_limit_only, share of truncated texts; n_limit stand at a limit, and
    n_limit_only of them only their limit, or the notice found at limits, gives away."""
    bad = F.count_if("truncated")
    only = F.count_if(F.col("truncated") & ~F.col("cut"))
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), bad.alias("n_cut"), F.count_if(F.col("truncated") & F.col("at_limit")).alias("n_limit"), only.alias("n_limit_only"), (bad / F.count(F.lit(1))).alias("share"))
