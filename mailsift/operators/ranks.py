"""Running sums and row numbers over a whole order without one task holding a whole key.

Rows are dealt by ranges of (keys, order) and written once with the number of their range, so every later use sees the same
ranges. Each range sums its own rows; a table with one row for each range and key carries what lies in front of it. The
largest unit of work is a range, however many rows share a key; rows equal in keys and order are separated by a last
order column that the caller gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.session import written


def unused(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], slices: int | None = None) -> DataFrame:
    """``df`` with one column for each entry of ``sums``: the sum over the rows of the same keys up to and with this one.

    ``order`` must order the rows of a key fully where equal rows should differ; null keys count as equal to each other.
    ``slices`` is the number of ranges (the session's shuffle partitions by default). The columns of ``df`` keep their
    names; an empty table gives an empty table.
    """
    part = unused(df, "slice_no")
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = [F.col(f"`{k}`") for k in keys] + order
    rows = written(df.repartitionByRange(n, *ordered).withColumn(part, F.spark_partition_id()), "ranges")
    group = [F.col(f"`{part}`")] + [F.col(f"`{k}`") for k in keys]
    totals = rows.groupBy(*[g.alias(f"k{i}") for i, g in enumerate(group)]).agg(*[F.sum(c).alias(f"t{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*[f"k{i}" for i in range(1, len(group))]).orderBy("k0").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[f"k{i}" for i in range(len(group))], *[F.sum(f"t{i}").over(before).alias(f"t{i}") for i in range(len(sums))])
    same = None
    for i, g in enumerate(group):
        same = g.eqNullSafe(F.col(f"k{i}")) if same is None else same & g.eqNullSafe(F.col(f"k{i}"))
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *[F.sum(c).over(within).alias(f"o{i}") for i, c in enumerate(sums.values())])
    return own.join(totals, same).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"o{i}") + F.coalesce(F.col(f"t{i}"), F.lit(0))).alias(name) for i, name in enumerate(sums)])


def numbered(df: DataFrame, order: list[Column], name: str = "number", keys: list[str] | None = None) -> DataFrame:
    """``df`` with row numbers from 1 in ``order``, over all rows or for each value of ``keys``."""
    return running_sums(df, keys or [], order, {name: F.lit(1).cast("long")})
