"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most, and the least rows that make a key one of them: as many narrow rows as one task joins
#: in a second or two. Fewer are not worth the jobs that find and split them, which small networks spend most of their time on.
HOT_KEYS, HOT_ROWS = 100_000, 1_000_000


def hot_keys(rows: DataFrame, *on: str, total: int) -> DataFrame | None:
    """The keys of ``rows`` that hold more than one row in ``HOT_KEYS`` of all ``total``: at most ``HOT_KEYS`` keys.

    None where there are too few rows for any key to be one.
    """
    if total <= HOT_ROWS:
        return None
    return rows.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(*on)


def even_join(rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``table``, whose keys are unique; rows with a key in ``hot`` stay where they are.

    ``hot`` must be bounded, as :func:`hot_keys` is. It and its rows of ``table`` are
    broadcast, so no shuffled key has more rows than a key outside ``hot``.
    """
    if hot is None:
        return rows.join(table, on)
    few = F.broadcast(hot)
    rest = rows.join(few, on, "left_anti").join(table, on)
    return rest.unionByName(rows.join(F.broadcast(table.join(few, on, "left_semi")), on))
