"""De-duplication keys and the time-limited de-duplicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions import predicates as P


def event_key(mode: str = "safe", columns: list[str] | None = None, pk: str = "id") -> Column:
    """safe: transaction position, or table, key of after else before, and order. faithful: table, after's key, op (so all
    updates of a row within the time limit are one, and all deletes of a table). columns: the named fields and op."""
    if mode == "faithful":
        return F.concat_ws(":", "schema", "table", F.coalesce(F.col(f"after.{pk}").cast("string"), F.lit("")), "op")
    if mode == "columns":
        return F.concat_ws(":", "schema", "table", *(F.coalesce(P.field(c).cast("string"), F.lit("null")) for c in columns or ()), "op")
    if mode == "table_time":
        return F.concat_ws(":", "database", "table", F.col("ts_s").cast("string"))
    own = F.coalesce(F.concat_ws("/", "txn.lsn", F.col("txn.sequence").cast("string")), F.lit(""))
    return F.concat_ws(":", "schema", "table", F.coalesce(P.field(pk).cast("string"), F.lit("")), "op", F.when(F.col("txn").isNotNull(), own).otherwise(F.col("seq").cast("string")))


def first_within(df: DataFrame, key: Column, seconds: str, order: list[str], ttl_s: int = 3600) -> DataFrame:
    """Events that are not within ttl_s after the last kept event of their key. The time runs from the kept event.

    An event ttl_s after the one before it is always kept, so a key's seconds fall into sessions without such a gap, and only
    within one of them the kept ones follow from each other. A session's distinct seconds are folded in order by aggregate():
    an array is as long as one session lasts in seconds, however many events a second has and however hot the key is.
    """
    rows = df.withColumn("_k", key)
    times = rows.select("_k", seconds).distinct()
    w = Window.partitionBy("_k").orderBy(seconds)
    times = times.withColumn("_new", F.coalesce(F.col(seconds) - F.lag(seconds).over(w) >= ttl_s, F.lit(True)).cast("int"))
    times = times.withColumn("_s", F.sum("_new").over(w)).groupBy("_k", "_s").agg(F.sort_array(F.collect_list(seconds)).alias("_t"))
    keeps = F.aggregate(
        "_t", F.array().cast("array<bigint>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= ttl_s), F.concat(acc, F.array(t))).otherwise(acc),
    )
    heads = times.select("_k", F.explode(keeps).alias(seconds))
    w = Window.partitionBy("_k", seconds).orderBy(*order)
    firsts = rows.join(heads, ["_k", seconds], "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return firsts.select(df.columns)
