"""Ordered logic within an owner: occurrences, first spellings, running maxima, neighbours, islands.

Owners are files, functions, users: each fits a task. Nothing here orders a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeats(rows: DataFrame, key: list[str], order: list, beyond: int = 1) -> DataFrame:
    """Occurrences of a key after its ``beyond``-th."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("nth") > beyond).drop("nth")


def unlike_first(rows: DataFrame, key: list[str], order: list, value: str, name: str) -> DataFrame:
    """Rows whose value differs from the first one of their key, which is added as ``name``."""
    return rows.withColumn(name, F.first(value).over(Window.partitionBy(*key).orderBy(*order))).where(F.col(value) != F.col(name))


def first_drop(rows: DataFrame, key: list[str], order: list, rank: str) -> DataFrame:
    """The first row of each key whose rank is below the highest before it."""
    w = Window.partitionBy(*key).orderBy(*order)
    low = rows.withColumn("top", F.max(rank).over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.col(rank) < F.col("top"))
    return low.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "top")


def like_previous(rows: DataFrame, key: list[str], order: list, value: str) -> DataFrame:
    return rows.withColumn("before", F.lag(value).over(Window.partitionBy(*key).orderBy(*order))).where(F.col("before") == F.col(value)).drop("before")


def following(rows: DataFrame, key: list[str], order: list, value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.lead(value).over(Window.partitionBy(*key).orderBy(*order)))


def last_before(rows: DataFrame, key: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` before each row of its key."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(rows: DataFrame, key: list[str], pos: str, pad: int) -> DataFrame:
    """Positions padded on both sides and merged where the padded ranges touch: ``key, lo, hi, changes``."""
    w = Window.partitionBy(*key).orderBy(pos)
    fresh = F.when(F.col(pos) - pad > F.lag(pos).over(w) + pad + 1, 1).otherwise(0)
    marked = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return marked.groupBy(*key, "island").agg((F.min(pos) - pad).alias("lo"), (F.max(pos) + pad).alias("hi"), F.count(F.lit(1)).alias("changes")).drop("island")
