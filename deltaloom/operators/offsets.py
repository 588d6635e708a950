"""Offsets of partitioned logs: dense numbering, bounds, lookups, consumer positions, assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds_below(at: Column, bounds: list) -> Column:
    """How many of the sorted bounds are less than `at` (none for null), by binary search.

    No lambda: a join on a column made by a lambda may get an inferred filter on columns that its side does not have
    (INTERNAL_ERROR_ATTRIBUTE_NOT_FOUND, if expression ids are as small as in a new session's first query).
    """

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.lit(bounds[mid]) < at, search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))


def dense_offsets(df: DataFrame, partition: list[str], order: list[str], name: str = "offset", blocks: int | None = None) -> DataFrame:
    """0, 1, 2 ... per partition in the given order; the order must be total for one fixed result.

    Two passes, so that no task needs a whole partition: the first order column, which must be a number or a time, is cut
    into `blocks` ranges of about equally many rows (default: the shuffle partitions); a block numbers its own rows, and
    prefix sums over the blocks' row counts (partitions x blocks numbers) give each block its first offset.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.select(order[0]).schema[0].dataType.typeName()
    if blocks < 2 or kind in ("string", "binary", "boolean", "struct", "array"):
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))
    at = F.unix_micros(order[0]) if kind == "timestamp" else F.unix_date(order[0]) if kind == "date" else F.col(order[0])
    cuts = df.agg(F.percentile_approx(at, [k / blocks for k in range(1, blocks)], 1000).alias("cuts")).first()["cuts"]
    bounds = sorted(set(cuts or []))  # blocks - 1 numbers at most
    rows = df.withColumn("_b", bounds_below(at, bounds))
    count = rows.groupBy(*partition, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*partition).orderBy("_b")
    first = count.select(*partition, "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_first"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*partition, "_b").orderBy(*order)) - 1)
    out = own.join(first.select(*(F.col(c).alias(f"_p{k}") for k, c in enumerate(partition)), F.col("_b").alias("_pb"), "_first"), [own[c].eqNullSafe(F.col(f"_p{k}")) for k, c in enumerate(partition)] + [own["_b"] == F.col("_pb")])
    return out.withColumn(name, (F.col("_first") + F.col("_own")).cast("long")).select(*(c for c in df.columns if c != name), name)


def read_from(log: DataFrame, partition: int, offset: int, most: int, server_cap: int = 10_000) -> DataFrame:
    """At most `most` records of one partition from an offset on."""
    return log.where((F.col("partition") == partition) & (F.col("offset") >= offset)).orderBy("offset").limit(min(most, server_cap))


def bounds(log: DataFrame) -> DataFrame:
    return log.groupBy("partition").agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest"))


def offset_for_time(log: DataFrame, at: Column) -> DataFrame:
    """The first offset with a timestamp at or after the given one; partitions without one have no row."""
    return log.where(F.col("timestamp") >= at).groupBy("partition").agg(F.min("offset").alias("offset"))


def truncate_before(log: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Records at or above their partition's low watermark."""
    return log.join(watermarks, "partition", "left").where(F.col("offset") >= F.coalesce("low_watermark", F.lit(0))).drop("low_watermark")


def committed(commits: DataFrame, order: str = "seq") -> DataFrame:
    """The last committed offset per group, topic and partition."""
    return commits.groupBy("group_id", "topic", "partition").agg(F.max_by("offset", order).alias("committed"))


def list_groups(commits: DataFrame) -> DataFrame:
    """Every group that has committed, with its partitions."""
    return commits.groupBy("group_id").agg(F.count_distinct("topic", "partition").alias("partitions"))


def describe_group(commits: DataFrame, bounds_: DataFrame, group_id: str, order: str = "seq") -> DataFrame:
    """Committed offset and lag of each partition of one group."""
    own = committed(commits.where(F.col("group_id") == group_id), order)
    return own.join(bounds_, "partition").select("topic", "partition", "committed", "latest", (F.col("latest") - F.col("committed")).alias("lag"))


def delete_group(commits: DataFrame, group_id: str) -> DataFrame:
    return commits.where(F.col("group_id") != group_id)


def reset_group(commits: DataFrame, bounds_: DataFrame, group_id: str, to: str | int = "earliest", order: str = "seq") -> DataFrame:
    """commits with one more commit for each partition of the group: its earliest or latest offset, or a number within them."""
    new = {"earliest": F.col("earliest"), "latest": F.col("latest")}.get(to, F.least(F.greatest(F.lit(to), "earliest"), "latest"))
    last = commits.where(F.col("group_id") == group_id).groupBy("group_id", "topic", "partition").agg((F.max(order) + 1).alias(order))
    moved = last.join(bounds_, "partition").withColumn("offset", new.cast("long"))
    return commits.unionByName(moved.select(commits.columns))


def lag(bounds_: DataFrame, commits: DataFrame) -> DataFrame:
    return bounds_.join(commits, "partition", "left").select("partition", "latest", F.coalesce("committed", F.lit(0)).alias("committed"), (F.col("latest") - F.coalesce("committed", F.lit(0))).alias("lag"))


def assign_range(members: list[str], topics: dict[str, int]) -> list[tuple[str, str, int]]:
    """Per topic, gapless ranges over the sorted members; the first ones take one more."""
    members, out = sorted(members), []
    for t in sorted(topics):
        each, extra = divmod(topics[t], len(members)) if members else (0, 0)
        at = 0
        for k, m in enumerate(members):
            for p in range(at, at := at + each + (k < extra)):
                out.append((m, t, p))
    return out


def assign_round_robin(members: list[str], topics: dict[str, int]) -> list[tuple[str, str, int]]:
    members = sorted(members)
    return [(members[k % len(members)], t, p) for k, (t, p) in enumerate((t, p) for t in sorted(topics) for p in range(topics[t]))] if members else []


def assign_sticky(members: list[str], topics: dict[str, int], previous: list[tuple[str, str, int]] = ()) -> list[tuple[str, str, int]]:
    """What a member had stays where it may; the rest goes to whoever has fewest; then no two members differ by over one."""
    held: dict[str, list[tuple[str, int]]] = {m: [] for m in sorted(members)}
    if not held:
        return []
    open_ = {(t, p) for t in topics for p in range(topics[t])}
    for m, t, p in sorted(previous):
        if m in held and (t, p) in open_:
            held[m].append((t, p))
            open_.discard((t, p))
    for tp in sorted(open_):
        held[min(held, key=lambda m: (len(held[m]), m))].append(tp)
    while True:
        most, least = max(held, key=lambda m: (len(held[m]), m)), min(held, key=lambda m: (len(held[m]), m))
        if len(held[most]) - len(held[least]) <= 1:
            return sorted((m, t, p) for m, tps in held.items() for t, p in tps)
        held[least].append(held[most].pop())
