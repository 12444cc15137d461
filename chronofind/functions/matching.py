"""Term matchers: whole-term 'literal' patterns and end-anchored regular expressions.

Both are case-insensitive in Unicode; a dot matches anything but a line feed.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_FLAGS = "(?iud)"


def literal_pattern(text: str) -> str:
    return rf"{_FLAGS}\A(?:{text})\z"


def regex_pattern(text: str) -> str:
    return rf"{_FLAGS}(?:{text})\z"


def unsupported(text: str) -> bool:
    """Whether a pattern needs what automaton-based matching lacks: look-around, back-references, atomic
    groups, possessive quantifiers or quoted runs."""
    at, in_class, repeated = 0, False, False
    while at < len(text):
        c, after = text[at], text[at + 1 : at + 4]
        if c == "\\":
            if after[:1] in tuple("123456789kQEGZ"):
                return True
            at += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(" and after.startswith(("?=", "?!", "?>", "?<=", "?<!")) or c == "+" and repeated:
            return True
        repeated = c in "*+?}" and not in_class
        at += 1
    return False


def compiles(text: str) -> bool:
    """Whether the pattern is one of the supported dialect and the JVM accepts it."""
    if unsupported(text):
        return False
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(regex_pattern(text))
    except Exception:
        return False
    return True


def matches_literal(column: Column, text: str) -> Column:
    return F.coalesce(column.rlike(literal_pattern(text)), F.lit(False))


def matches_regex(column: Column, text: str) -> Column:
    return F.coalesce(column.rlike(regex_pattern(text)), F.lit(False))


def any_key(tags: Column, pattern: str) -> Column:
    """Whether some tag key matches; false for null tags."""
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: k.rlike(pattern)), F.lit(False))
