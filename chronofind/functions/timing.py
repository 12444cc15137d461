"""Integer time arithmetic; all times are epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofind.model import ALIGN_SECONDS, EPOCH_SECONDS


def align(start: int, end: int) -> tuple[int, int]:
    """Start is floored to half an hour; end is floored and then moved on, even if aligned."""
    return start - start % ALIGN_SECONDS, end - end % ALIGN_SECONDS + ALIGN_SECONDS


def floor_to(column: Column, seconds: int) -> Column:
    return column - F.pmod(column, F.lit(seconds))


def epoch_bucket(time: Column, segment: Column) -> Column:
    """Six-hour bucket anchored at the segment's start; null where time lies before it."""
    return F.when(time >= segment, time - F.pmod(time - segment, F.lit(EPOCH_SECONDS).cast("bigint")))


def alive(epochs: Column, start: int, end: int) -> Column:
    """Some epoch overlaps [start, end], both ends included."""
    hit = F.exists(epochs, lambda e: (F.lit(start) <= e + EPOCH_SECONDS) & (F.lit(end) >= e))
    return F.coalesce(hit, F.lit(False))


def segment_in_range(segment: Column, duration: Column, start: int, end: int) -> Column:
    """A segment qualifies by its first second, or, where its duration is known, by covering start."""
    d = F.coalesce(duration, F.lit(0))
    first = (F.lit(start) <= segment) & (F.lit(end) >= segment)
    covers = (d > 0) & (F.lit(start) >= segment) & (F.lit(start) <= segment + d)
    return first | covers
