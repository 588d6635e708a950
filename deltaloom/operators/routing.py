"""Routing of events to destinations, and partition assignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions import predicates as P
from deltaloom.functions.scalar import finalized_partition


@dataclass
class Route:
    condition: Column
    destinations: list[str]
    priority: int = 0
    go_on: bool = False


def route(df: DataFrame, rules: list[Route], default: str | None = None, dead_letter: str | None = None, drop_unroutable: bool = False, target: str = "destinations") -> DataFrame:
    """Destinations, sorted and distinct, by rules in order of priority; the first match ends unless it goes on.

    Unrouted events go to the default, else (unless they are to be dropped) to the dead letters; empty: dropped.
    """
    found, done = F.array().cast("array<string>"), F.lit(False)
    for r in sorted(rules, key=lambda r: -r.priority):
        hit = F.coalesce(r.condition, F.lit(False)) & ~done
        found = F.concat(found, F.when(hit, F.array(*map(F.lit, r.destinations))).otherwise(F.array().cast("array<string>")))
        done = done if r.go_on else done | hit
    found = F.array_sort(F.array_distinct(found))
    other = [default] if default else [] if drop_unroutable or not dead_letter else [dead_letter]
    rest = F.array(*map(F.lit, other)) if other else F.array().cast("array<string>")
    return df.withColumn(target, F.when(F.size(found) > 0, found).otherwise(rest))


def regex_route(df: DataFrame, rules: list[tuple[str, str]], default: str | None = None, target: str = "__topic") -> DataFrame:
    """The topic of the first expression that fits `schema.table`; events without after have none. Bad expressions are skipped."""
    name, topic = F.concat_ws(".", "schema", "table"), F.lit(default)
    for pattern, to in reversed([r for r in rules if P.portable(r[0])]):
        topic = F.when(P.matches(name, pattern), to).otherwise(topic)
    return df.withColumn(target, F.when(F.col("after").isNotNull(), topic))


def content_route(df: DataFrame, rules: list[tuple[Column, str]], default: str | None = None, target: str = "__routing_topic") -> DataFrame:
    topic = F.lit(default)
    for condition, to in reversed(rules):
        topic = F.when(F.coalesce(condition, F.lit(False)), to).otherwise(topic)
    return df.withColumn(target, F.when(F.col("after").isNotNull(), topic))


def key_partition(n: int, *parts: Column) -> Column:
    """The finalized 64-bit hash of the parts, modulo n. One long part is its own hash."""
    return finalized_partition(F.xxhash64(*parts), n)


def table_partition(n: int, full: bool = False) -> Column:
    """All events of a table go to one partition; full: the database counts too."""
    return key_partition(n, *([F.col("database")] if full else []), F.col("schema"), F.col("table"))


def batch_groups(df: DataFrame, partition: Column, order: Column) -> DataFrame:
    """A batch of records per partition: rows, first and last of `order`."""
    return df.groupBy(partition.alias("partition")).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def round_robin(position: Column, n: int) -> Column:
    return (position % n).cast("int")


def sticky(position: Column, n: int, batch: int = 16_384) -> Column:
    return (F.floor(position / batch) % n).cast("int")


def ring_partition(df: DataFrame, key: Column, n: int, nodes: int = 100, target: str = "partition") -> DataFrame:
    """Consistent hashing: the partition of the first virtual node at or after the key's hash, round the ring.

    The ring has n x nodes points; it goes to the tasks as an array, and a binary search finds the place.
    """
    import numpy as np
    import xxhash

    points = sorted((xxhash.xxh64_intdigest(f"{p}-{v}".encode(), 42), p) for p in range(n) for v in range(nodes))
    at, of = np.array([p for p, _ in points], np.uint64), np.array([p for _, p in points], np.int32)

    @F.pandas_udf("int")
    def find(h):
        i = np.searchsorted(at, h.to_numpy().astype(np.int64).view(np.uint64), "left")
        import pandas as pd

        return pd.Series(of[i % len(of)])

    return df.withColumn(target, find(F.xxhash64(key)))


def distribution(df: DataFrame, partition: str, n: int, within: float = 20.0) -> DataFrame:
    """Rows and percent of each of n partitions, standard deviation of the counts, and whether all lie within so many percent of the mean."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(partition).cast("long").alias("partition")).agg(F.count("*").alias("n"))
    whole = spark.range(n).select(F.col("id").alias("partition")).join(F.broadcast(counts), "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy()  # n rows
    mean = F.avg("n").over(w)
    return whole.select("partition", "n", (100.0 * F.col("n") / F.sum("n").over(w)).alias("percent"), F.stddev_pop("n").over(w).alias("deviation"), (F.max(F.abs(F.col("n") - mean)).over(w) <= mean * within / 100).alias("balanced"))
