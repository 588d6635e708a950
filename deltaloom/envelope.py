"""Change events as DataFrames.

Columns: source_type, database, schema, table, op (c, u, d, r, t, s), before and after (structs of one type), ts_s (epoch
seconds), seq (arrival order), txn (struct id, lsn, sequence, total_events, commit_ts, is_last; may be null).
A field that is missing and one that is null are the same here; use the variant lane where they must differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "topic string, partition int, offset long, key binary, value binary, timestamp long, headers array<struct<key: string, value: binary>>, producer_id long, producer_epoch int, transaction_marker string, is_transactional boolean"
TXN = "struct<id: string, lsn: string, sequence: long, total_events: long, commit_ts: long, is_last: boolean>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(rows: DataFrame, op: Column, seconds: Column, seq: Column, name: str, schema: str = "public", txn: Column | None = None) -> DataFrame:
    """Rows as change events: a delete has only `before`, any other event only `after`."""
    image = F.struct(*rows.columns)
    return rows.select(
        F.lit("tables").alias("source_type"), F.lit("driver").alias("database"), F.lit(schema).alias("schema"), F.lit(name).alias("table"), op.alias("op"),
        F.when(op == "d", image).alias("before"), F.when(op != "d", image).alias("after"), seconds.cast("long").alias("ts_s"), seq.cast("long").alias("seq"),
        (F.lit(None).cast(TXN) if txn is None else txn).alias("txn"),
    )


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def seconds(c: str) -> Column:
    return F.floor(micros(c) / 1_000_000).cast("long")


def events_log(spark: SparkSession, sf_dir: str, txn: bool = False) -> DataFrame:
    """events: signup creates, error deletes, all else updates; key user_id, order (ts, event_id)."""
    rows = table(spark, sf_dir, "events").withColumn("ts", micros("ts"))
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    group = None
    if txn:
        base = F.floor(F.col("event_id") / 10)
        group = F.struct(base.cast("string").alias("id"), F.lpad(F.hex(base.cast("long")), 8, "0").alias("lsn"), (F.col("event_id") % 10).alias("sequence"), F.lit(10).cast("long").alias("total_events"), F.col("ts").alias("commit_ts"), (F.col("event_id") % 10 == 9).alias("is_last"))
    return change_log(rows, op, F.floor(F.col("ts") / 1_000_000), F.col("event_id"), "events", txn=group)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("o_orderdate", micros("o_orderdate"))
    op = F.when(F.col("o_orderstatus") == "O", "c").when(F.col("o_orderstatus") == "F", "d").otherwise("u")
    return change_log(rows, op, F.floor(F.col("o_orderdate") / 1_000_000), F.col("o_orderkey"), "orders", "sales")


def customer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_log(table(spark, sf_dir, "customer"), F.lit("r"), F.lit(0), F.col("c_custkey"), "customer", "sales")


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a partitioned log: key user_id, partition user_id mod 4, dense offsets, value props (empty for error)."""
    from deltaloom.operators.offsets import dense_offsets

    e = table(spark, sf_dir, "events").select("event_id", micros("ts").alias("timestamp"), F.col("user_id").alias("key"), (F.col("user_id") % 4).cast("int").alias("partition"), F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("props")).alias("value"), (F.col("user_id") % 5).alias("producer_id"))
    return dense_offsets(e, ["partition"], ["timestamp", "event_id"])


def images(df: DataFrame) -> dict[str, list[str]]:
    return {im: [f.name for f in df.schema[im].dataType] for im in ("before", "after") if im in df.columns}
