"""Joins in which a key may have any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that :func:`by_group` broadcasts.
HOT = 10_000


def by_group(rows: DataFrame, groups: DataFrame, keys: list[str], total: int | None = None) -> DataFrame:
    """``rows`` joined with ``groups``, which has a row for each key and in ``_n`` how many rows the key has.

    Keys with more than a ``HOT``-th of all rows, of which there are at most ``HOT``, are broadcast,
    so that their rows stay where they are; the others meet by key, in groups of a bounded share."""
    total = rows.count() if total is None else total
    usual = max(64, -(-total // HOT))
    hot = F.broadcast(groups.where(F.col("_n") > usual).drop("_n"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col("_n") <= usual).drop("_n"), keys)
    return rows.join(hot, keys).unionByName(rest)
