"""Operators over ordered rows: gaps, intervals, windows up to the next row, nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(df: DataFrame, group: list[str], at: Column, most: Column, order: list[str]) -> DataFrame:
    """Adds ``cluster`` (from 1): a new one starts where the distance to the row before is more than ``most``."""
    w = Window.partitionBy(*group).orderBy(*order)
    gap = at - F.lag(at).over(w)
    flagged = df.withColumn("_new", F.when(gap.isNull() | (gap <= most), 0).otherwise(1))
    return flagged.withColumn("cluster", 1 + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged_intervals(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """``group, start, end, n``: overlapping and touching intervals as one; null bounds are left out."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    known = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    flagged = known.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = flagged.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*group, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_i")


def until_next(df: DataFrame, group: list[str], order: list[str], at: str, name: str = "next_at") -> DataFrame:
    """Adds the next row's ``at`` within the group; null for the last."""
    return df.withColumn(name, F.lead(at).over(Window.partitionBy(*group).orderBy(*order)))


def first_per(df: DataFrame, group: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group with their place ``n_in_group``."""
    return df.withColumn("n_in_group", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("n_in_group") <= n)


def reading_order(boxes: DataFrame, group: list[str], x: str, y: str, order: list[str], least_gap: float = 18.0) -> DataFrame:
    """Adds ``col`` and ``place``: columns by gaps in x, read from right to left and from top to bottom.

    A gap is more than 18 per cent of the page's span and more than
    ``least_gap``; a page that would fall into more than six columns is one.
    """
    page = Window.partitionBy(*group)
    span = F.max(x).over(page) - F.min(x).over(page)
    most = F.greatest(span * 0.18, F.lit(least_gap))
    with_most = boxes.withColumn("_most", most)
    clustered = gap_clusters(with_most, group, F.col(x), F.col("_most"), [x, *order])
    col = F.when(F.max("cluster").over(page) > 6, 1).otherwise(F.col("cluster"))
    placed = clustered.withColumn("col", col).drop("_most", "cluster")
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("col"), y, *order)))
