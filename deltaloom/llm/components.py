"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two aggregations and joins over the links, so no node's links need to fit in one task: the minimum of a
node's neighbours is pre-aggregated before its shuffle, and the join that hands it back may be split where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import drop_folder, keep


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    """e: rows with u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def _stars(e: DataFrame) -> bool:
    """Whether every node has one link to a root, or is a root: then the components are found."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(spark: SparkSession, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    links: columns a and b, longs; rows with a null or a = b say nothing. The loop ends when all links are stars about
    a smallest node; its state is written to the shared folder after each round.
    """
    e = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, path = keep(spark, e, "links")
    while not _stars(now):
        step, new_path = keep(spark, _small_star(_large_star(now).distinct()).distinct(), "links")
        drop_folder(spark, path)
        now, path = step, new_path
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
