"""Counts, percentiles and rates of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = ("c", "u", "d", "r", "t", "s")


def op_counts(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count_if(F.col("op") == o).alias(f"n_{o}") for o in OPS), F.count("*").alias("total"))


def by_table(df: DataFrame) -> DataFrame:
    return df.groupBy("schema", "table").agg(F.count("*").alias("n"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))


def percentiles(df: DataFrame, value: str, group: list[str], ps=(50, 95, 99)) -> DataFrame:
    """The value at index floor(n p / 100) of the sorted values, at most the last; and the largest.

    Values are ranked within value ranges: counts per distinct value come first, so a range holds no more than those.
    """
    from pyspark.sql import Window as W

    counts = df.groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*group).orderBy("_v")
    upto = counts.withColumn("_end", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(W.partitionBy(*group)))
    at = lambda p: F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1)
    return upto.groupBy(*group).agg(*(F.min(F.when(F.col("_end") > at(p), F.col("_v"))).alias(f"p{p}") for p in ps), F.max("_v").alias("largest"))


def rate(df: DataFrame, seconds: str, width: int) -> DataFrame:
    """Events per second of each window of `width` seconds."""
    return df.groupBy((F.floor(F.col(seconds) / width) * width).alias("start_s")).agg(F.count("*").alias("n"), (F.count("*") / width).alias("per_second"))


def chunks(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """The number of the fixed-size chunk that each row of a group is in."""
    from pyspark.sql import Window as W

    return df.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1) / size))
