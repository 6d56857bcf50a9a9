"""Rewrites at plan time that the optimizer can't make on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of rules, grants or sites is broadcast up to so many rows; a larger one is joined as Spark sees fit.
BROADCAST_ROWS = 100_000


def next_prefix(prefix: str) -> str | None:
    """The least text after all texts with this prefix; none if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i])
        if c < 0x10FFFF:
            c += 1
            return prefix[:i] + chr(0xE000 if 0xD800 <= c <= 0xDFFF else c)
    return None


def prefix_range(column: Column, prefix: str) -> Column:
    """startswith with the range that it implies: both reach the scan, and the range prunes row groups by their statistics."""
    if not prefix:
        return column.isNotNull()
    end = next_prefix(prefix)
    found = (column >= prefix) & column.startswith(prefix)
    return found & (column < end) if end is not None else found


def small(rules: DataFrame, most: int | None = None) -> DataFrame:
    """A rule table marked for broadcast if it is as small as it should be, or as it is."""
    return F.broadcast(rules) if is_small(rules, most) else rules


def is_small(rules: DataFrame, most: int | None = None) -> bool:
    most = BROADCAST_ROWS if most is None else most
    return rules.limit(most + 1).count() <= most


def with_list(rows: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """rows, each with all rules as one sorted array: for few rules, so that matching them needs no shuffle at all.
    Rules are sorted by their columns from left to right; more than BROADCAST_ROWS of them are an error."""
    if not is_small(rules):
        raise ValueError(f"a list of more than {BROADCAST_ROWS} rows is not sent to every row")
    every = rules.agg(F.array_sort(F.collect_list(F.struct(*rules.columns))).alias(name))
    return rows.crossJoin(F.broadcast(every))
