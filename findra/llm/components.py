"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """``u, m``: the least of each ``u`` and its neighbours ``v``; partial aggregation spares hubs."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (columns ``u``, ``v``): the least node of its component.

    Rounds are written to the shared folder; their number grows with the logarithm of the diameter.
    Self-links and repeated links are allowed; nodes that are their component's least are left out.
    """
    now = stored(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = None
    for _ in range(MAX_ROUNDS):
        now = stored(spark, _small(_large(now)), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == print_of or new[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        print_of = new
    raise RuntimeError("components did not settle")
