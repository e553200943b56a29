"""A join that stays even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as heavy from one row in this many; so at most this many keys are heavy.
HEAVY_SHARE = 1000


def join_even(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner-join ``rows`` with ``table`` (one row a key) on ``key`` (never null).

    ``weight`` is the number of ``rows`` that have the key and ``total`` their
    sum.  Keys with at least ``total / HEAVY_SHARE`` rows, at most
    ``HEAVY_SHARE`` of them by arithmetic, are broadcast; the others are
    shuffled, and none of those can overload a task.
    """
    heavy = table.where(F.col(weight) * HEAVY_SHARE >= max(1, total))
    light = table.where(F.col(weight) * HEAVY_SHARE < max(1, total))
    marks = heavy.select(F.col(key).alias("_heavy"))
    rest = rows.join(F.broadcast(marks), rows[key] == F.col("_heavy"), "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light.hint("shuffle_merge"), key))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that isn't a column of ``df`` (upper and lower case count as equal)."""
    have = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(1, len(have) + 2))) if x.lower() not in have)
