"""Patterns over the dictionary: what may be in one, and the prefix that prunes row groups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set(".^$*+?{}[]\\|()")


def checked(pattern: str) -> str:
    """The pattern for the JVM: named groups are written its way, classes are Unicode's. Look-around and back references,
    which take more than linear time, are refused, as is what doesn't compile."""
    if re.search(r"\(\?<?[=!]|\\[1-9]|\\k<", pattern):
        raise ValueError(f"look-around and back references are not allowed: {pattern}")
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    pattern = re.sub(r"\[\[:(\^?)(\w+):\]\]", lambda m: ("\\P" if m[1] else "\\p") + "{" + m[2].capitalize() + "}", pattern)
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}", ".", pattern).replace("(?<", "(?P<"))
    except re.error as e:
        raise ValueError(f"not a pattern: {pattern}") from e
    return pattern


def prefix_of(pattern: str) -> str:
    """The plain letters that every match begins with."""
    if not pattern.startswith("^") or "|" in pattern:
        return ""
    at = 1
    while at < len(pattern) and pattern[at] not in _SPECIAL:
        at += 1
    if at < len(pattern) and pattern[at] in "*?{":
        at -= 1
    return pattern[1:at]


def term_filter(column: str, pattern: str) -> Column:
    """Whether a term matches anywhere. A literal prefix is tested too, which reaches the scan; a pattern doesn't."""
    found = F.col(column).rlike("(?U)" + checked(pattern))
    prefix = prefix_of(pattern)
    return F.col(column).startswith(prefix) & found if prefix else found
