"""Generated rows: seven patterns, and change events over a pool of live records. The same seed gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATTERNS = ("sequence", "random", "users", "orders", "events", "metrics", "key_value")
# Fixed values of the generated rows.
COUNTRIES = ("US", "DE", "FR", "JP", "BR")
PRODUCTS = ("laptop", "phone", "tablet", "monitor", "keyboard")
STATUSES = ("pending", "paid", "shipped", "delivered", "cancelled")
EVENT_TYPES = ("page_view", "click", "signup", "purchase")
METRICS = ("cpu", "memory", "disk", "network")
START_S = 1_700_000_000


def _n(seed: int, field: str, below: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(field)), F.lit(below))


def _pick(seed: int, field: str, values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_n(seed, field, len(values)) + 1).cast("int"))


def generate(spark: SparkSession, pattern: str, rows: int, seed: int = 0, per_second: int = 100, custom: dict[str, Column] | None = None) -> DataFrame:
    n = lambda f, b: _n(seed, f, b)
    pick = lambda f, v: _pick(seed, f, v)
    at = F.timestamp_seconds(F.lit(START_S) + F.floor(F.col("id") / per_second))
    cols = {
        "sequence": lambda: [F.col("id").alias("value"), F.col("id").alias("_sequence"), at.alias("_timestamp")],
        "random": lambda: [F.col("id"), n("value", 1000).alias("value"), (n("ratio", 10_000) / 10_000).alias("ratio"), (n("active", 2) == 1).alias("active"), pick("category", ("a", "b", "c")).alias("category")],
        "users": lambda: [F.col("id").alias("user_id"), F.concat(F.lit("First"), n("f", 100)).alias("first_name"), F.concat(F.lit("Last"), n("l", 100)).alias("last_name"), F.concat(F.lit("user"), "id", F.lit("@example.com")).alias("email"), (n("age", 60) + 18).alias("age"), pick("country", COUNTRIES).alias("country"), (n("p", 10) < 3).alias("premium"), F.to_date(at).alias("signup_date")],
        "orders": lambda: [F.col("id").alias("order_id"), n("c", 1000).alias("customer_id"), pick("product", PRODUCTS).alias("product"), (n("q", 10) + 1).alias("quantity"), (n("u", 10_000) / 100).alias("unit_price"), ((n("q", 10) + 1) * n("u", 10_000) / 100).alias("total_amount"), F.lit("USD").alias("currency"), pick("s", STATUSES).alias("status"), at.alias("created_at")],
        "events": lambda: [F.col("id").alias("event_id"), pick("t", EVENT_TYPES).alias("event_type"), F.col("id").alias("sequence"), F.lit("datagen").alias("source"), n("user", 500).alias("user_id"), F.concat(F.lit("s"), n("session", 2000)).alias("session_id"), F.struct(F.concat(F.lit("/page/"), n("page", 50)).alias("page"), n("ms", 30_000).alias("duration_ms")).alias("payload")],
        "metrics": lambda: [F.col("id").alias("metric_id"), pick("m", METRICS).alias("name"), (n("v", 10_000) / 100).alias("value"), F.lit("percent").alias("unit"), F.concat(F.lit("host-"), n("h", 20)).alias("host"), F.struct(pick("env", ("prod", "test")).alias("env"), pick("r", ("eu", "us")).alias("region")).alias("tags"), at.alias("timestamp")],
        "key_value": lambda: [F.concat(F.lit("key-"), n("k", 100)).alias("key"), F.col("id").alias("value")],
    }
    if pattern not in cols:
        raise ValueError(f"unknown pattern {pattern!r}")
    return spark.range(rows).select(*cols[pattern](), *(c.alias(k) for k, c in (custom or {}).items()))


def change_events(spark: SparkSession, rows: int, pool: int = 10_000, seed: int = 0) -> DataFrame:
    """60 % inserts, 30 % updates, 10 % deletes, consistent per record: whoever is not live is inserted first."""
    draws = spark.range(rows).withColumns({"record": _n(seed, "record", pool), "draw": _n(seed, "draw", 10)})
    w = Window.partitionBy("record").orderBy("id")
    # A draw below 1 deletes; what stands after a delete, or first, inserts; the rest are updates.
    wants = draws.withColumn("deletes", F.col("draw") < 1)
    prior = F.lag("deletes").over(w)
    op = F.when(prior.isNull() | prior, "c").when(F.col("deletes"), "d").otherwise("u")
    named = wants.withColumn("op", op).where(~((F.col("op") == "c") & F.col("deletes")))
    value = F.struct(F.col("record").alias("id"), _n(seed, "value", 1000).alias("value"))
    return named.select("op", F.when(F.col("op") == "d", value).alias("before"), F.when(F.col("op") != "d", value).alias("after"), F.col("id").alias("seq"))
