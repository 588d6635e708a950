"""Extensions: joins over change streams that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time; null where there is none.

    Both sides are sorted once by (key, time) and the last right row is carried forward, so no pair of rows is ever made.
    Ties of right rows at one time: the largest values.
    """
    a = left.select(F.struct(*left.columns).alias("_l"), F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_l.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def interval_join(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, width: int) -> DataFrame:
    """Pairs of one key with 0 <= right_time - time <= width (numbers). Times are cut into steps of `width`, so a pair meets in
    one of two steps and the join stays an equi-join, also where a key is hot."""
    step = lambda c: F.floor(F.col(c) / max(width, 1))
    a = left.withColumn("_s", F.explode(F.array(step(time), step(time) + 1)))
    b = right.withColumn("_s", step(right_time))
    return a.join(b, [key, "_s"]).where((F.col(right_time) >= F.col(time)) & (F.col(right_time) <= F.col(time) + width)).drop("_s")
