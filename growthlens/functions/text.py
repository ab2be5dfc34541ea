"""Small text helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def bracket_or_tail(name: Column | str, pattern: str = r"en\((.*?)\)") -> Column:
    """Region named inside a file name: the pattern's group, else any bracket, else the last dash part."""
    c = F.col(name) if isinstance(name, str) else name
    by_pattern = F.regexp_extract(c, pattern, 1)
    bracket = F.regexp_extract(c, r"\(([^()]*)\)[^()]*$", 1)
    tail = F.regexp_replace(F.substring_index(c, "-", -1), r"\.csv$", "")
    return F.trim(F.when(by_pattern != "", by_pattern).when(bracket != "", bracket).otherwise(tail))


def mapped(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup on trimmed text; NULL where the text is not listed."""
    key = F.trim(F.col(f"`{c}`") if isinstance(c, str) else c)
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)
