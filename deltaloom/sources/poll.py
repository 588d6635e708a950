"""Incremental polls of tables, as filters that reach the scan; and the outbox's step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bulk(t: DataFrame, columns: list[str] | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    t = t.where(where) if where else t
    t = t.select(columns) if columns else t
    return t.limit(limit) if limit is not None else t


def incrementing(t: DataFrame, column: str, last, limit: int) -> DataFrame:
    t = t if last is None else t.where(F.col(column) > F.lit(last))
    return t.orderBy(column).limit(limit)


def timestamp(t: DataFrame, column: str, last, limit: int, before=None, ties: list[str] | None = None) -> DataFrame:
    """before: now less the delay, so that late rows of open transactions are not passed over. ties: for a fixed order."""
    t = t if last is None else t.where(F.col(column) > F.lit(last))
    t = t if before is None else t.where(F.col(column) < F.lit(before))
    return t.orderBy(column, *(ties or ())).limit(limit)


def timestamp_incrementing(t: DataFrame, ts: str, id_: str, last_ts, last_id, limit: int) -> DataFrame:
    after = (F.col(ts) > F.lit(last_ts)) | ((F.col(ts) == F.lit(last_ts)) & (F.col(id_) > F.lit(last_id)))
    return t.where(after).orderBy(ts, id_).limit(limit)


def custom(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(sql, **tables)


def jdbc(spark: SparkSession, url: str, query: str, fetch: int = 10_000, **options) -> DataFrame:
    """A database by JDBC; the driver's jar has to be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=fetch, **options).load()


def kafka(spark: SparkSession, servers: str, topics: str, start: str = "latest", isolation: str = "read_committed", **options) -> DataFrame:
    """A stream of a Kafka topic as log records; the connector package has to be on the class path."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": start, "kafka.isolation.level": isolation, "includeHeaders": "true"} | options).load()
    return raw.select("topic", "partition", "offset", "key", "value", F.unix_millis("timestamp").alias("timestamp"), "headers")


def outbox_step(events: DataFrame, delivered: Column, max_retries: int = 3) -> DataFrame:
    """attempts and status after one delivery: delivered, or pending again while attempts stay below max_retries, else failed."""
    n = F.col("attempts") + 1
    return events.withColumns({"attempts": n, "status": F.when(delivered, "delivered").when(n < max_retries, "pending").otherwise("failed")})


def outbox_claim(events: DataFrame, batch: int, now_s: int, worker: str, lease_s: int = 60) -> DataFrame:
    """At most `batch` events to deliver, oldest first: pending ones, and those whose claim by a worker has run out."""
    free = (F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("claimed_s") + lease_s <= now_s))
    due = events.where(free).orderBy("created_s", "event_id").limit(batch)
    return due.withColumns({"status": F.lit("processing"), "claimed_s": F.lit(now_s).cast("long"), "worker": F.lit(worker)})


def outbox_round(events: DataFrame, delivered: Column, max_retries: int = 3, now_s: int = 0, keep_s: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the table after one delivery of its claimed events, dead letters): see outbox_step. Delivered events older than keep_s go."""
    claimed = F.col("status") == "processing"
    n = F.when(claimed, F.col("attempts") + 1).otherwise(F.col("attempts"))
    after = F.when(claimed, F.when(delivered, "delivered").when(F.col("attempts") + 1 < max_retries, "pending").otherwise("failed")).otherwise(F.col("status"))
    out = events.withColumns({"status": after, "attempts": n, "_tried": claimed})
    dead = out.where(F.col("_tried") & (F.col("status") == "failed")).drop("_tried")
    if keep_s is not None:
        out = out.where((F.col("status") != "delivered") | (F.col("created_s") + keep_s > now_s))
    return out.drop("_tried"), dead
