"""How a commit's text ends: pure functions on one text."""

from __future__ import annotations

import re

# Notices that exporters append where they cut a text.
NOTICES = ("[truncated]", "[message too long]", "(cut)", "<snip>")
ELLIPSES = ("…", "...")
_STOPS = ".!?。！？"

#: Where the diff begins, unless the text does.
DIFF = "\ndiff --git "

_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_LISTED = re.compile(r"\s*(?:[A-Z][\w-]*: |[-*] |#)")
_BLANK = re.compile(r"\n[ \t\r>]*\n")
_PATCH = re.compile(r"(?:literal|delta) (\d+)\r?\Z")


def without_notice(text: str) -> tuple[str, bool]:
    """The text before a notice at its very end, and whether there was one. Dots set off by a space, or
    followed by a line end, are an author's and no notice."""
    whole = text.rstrip("\r\n")
    for notice in NOTICES:
        if whole.endswith(notice) and (whole == text or whole[: -len(notice)].endswith("\n") or _in_diff(whole) or _unfinished(whole[: -len(notice)])):
            return whole[: -len(notice)].rstrip(" ").removesuffix("\n"), True
    for dots in ELLIPSES:
        if text.endswith(dots) and len(text) > len(dots):
            before = text[: -len(dots)]
            if not before[-1].isspace() or "\n" in before[len(before.rstrip()):] or _in_diff(before):
                return before, True
    return text, False


def _unfinished(text: str) -> bool:
    """Whether the last line breaks off: it isn't blank and no stop, bracket or quote closes it."""
    last = text.rstrip(" ").rsplit("\n", 1)[-1].strip()
    return bool(last) and last[-1] not in _STOPS + ")]}>\"'`:;"


def _in_diff(text: str) -> bool:
    return DIFF in text or text.startswith("diff --git ")


def body_lines(text: str) -> list[str]:
    """The diff's lines, without the message."""
    at = text.find(DIFF)
    if at < 0 and not text.startswith("diff --git "):
        return []
    return text[max(at, 0):].strip("\n").split("\n")


def _bytes_in(line: str) -> int:
    """Bytes that the first letter of a base-85 line announces, -1 if it is none or is incomplete."""
    c = line[:1]
    n = ord(c) - 64 if "A" <= c <= "Z" else ord(c) - 70 if "a" <= c <= "z" else -1
    return n if n > 0 and len(line) == 1 + 5 * -(-n // 4) else -1


def _diff_is_open(lines: list[str]) -> bool:
    """Whether the diff ends in a hunk that lacks lines, a file header or an unfinished binary patch."""
    old = new = due = 0
    header = True
    for line in lines:
        if old > 0 or new > 0:
            mark = line[:1]
            if mark == "+":
                new -= 1
            elif mark == "-":
                old -= 1
            elif mark in ("", " ", "\r"):
                old, new = old - 1, new - 1
            elif mark != "\\":
                old = new = 0
            if old > 0 or new > 0 or mark in ("+", "-", "", " ", "\r", "\\"):
                continue
        if due > 0:
            due = max(0, due - n) if (n := _bytes_in(line.rstrip("\r"))) > 0 else (due if line.rstrip("\r") else 0)
            continue
        if m := _HUNK.match(line):
            old, new, header = int(m[1] or 1), int(m[2] or 1), False
        elif m := _PATCH.match(line):
            due, header = int(m[1]), False
        elif line.startswith("diff --git "):
            header = True
        elif line.startswith("Binary files ") and line.rstrip().endswith(" differ") or line.startswith(("rename to ", "copy to ", "new mode ")):
            header = False
        elif not line.strip():
            header = header and False
    return old > 0 or new > 0 or due > 0 or header


def is_cut(text: str) -> bool:
    """Whether a non-blank text breaks off: a damaged last character, a notice, an unfinished diff, or a
    last sentence of the message's body without its end. A missing last line end alone is no sign."""
    if text.endswith(("\ufffd", "\0")):
        return True
    rest, noticed = without_notice(text)
    if noticed:
        return True
    if lines := body_lines(rest):
        return _diff_is_open(lines)
    if rest.endswith("\n"):
        return False
    parts = _BLANK.split(rest.replace("\r\n", "\n"))
    last = parts[-1].split("\n")[-1]
    prose = len(parts) > 1 and not _LISTED.match(last) and not _headed(parts)
    return prose and last.rstrip()[-1:] not in _STOPS


def _headed(parts: list[str]) -> bool:
    """Whether the last part is the subject: nothing but header lines stands before it."""
    if len(parts) != 2:
        return False
    first = parts[0].strip("\n").split("\n")
    return "Subject: " not in parts[0] and "] " not in first[0][:40] and "\n" not in parts[1]
