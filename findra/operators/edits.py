"""Edits: conflicts between them and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conflicting(spans: DataFrame) -> DataFrame:
    """``file, id`` of spans (``file, id, lo, hi``) that overlap another one of their file.

    Sorted by start, a span overlaps an earlier one if it starts before the furthest end so far, and a
    later one if the least start among those behind it is before its end: two windows instead of all pairs.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("lo", "hi", "id")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    some = spans.where("lo < hi").withColumn("end_before", F.max("hi").over(before)).withColumn("start_after", F.min("lo").over(after))
    return some.where((F.col("end_before") > F.col("lo")) | (F.col("start_after") < F.col("hi"))).select("file", "id").distinct()


def applied(text: Column, made: Column) -> Column:
    """The text with non-overlapping edits (``start, end, new_text``, offsets from 0) spliced in from the back."""
    back = F.array_sort(made, lambda a, b: F.when(a["start"] != b["start"], b["start"] - a["start"]).otherwise(b["end"] - a["end"]))
    return F.aggregate(back, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["new_text"], F.substring(t, e["end"] + 1, F.length(t))))


def without_conflicts(edits: DataFrame) -> DataFrame:
    """Edits (``file, id, lo, hi, new_text``) that conflict with no other; equal ones count once."""
    once = edits.dropDuplicates(["file", "lo", "hi", "new_text"])
    return once.join(conflicting(once), ["file", "id"], "left_anti")
