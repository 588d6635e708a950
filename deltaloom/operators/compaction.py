"""Latest row per key, tombstones, and log compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions import predicates as P


def key_of(columns: list[str]) -> Column:
    """`schema:table:value:...` over the columns of after, else before."""
    return F.concat_ws(":", "schema", "table", *(F.coalesce(P.field(c).cast("string"), F.lit("null")) for c in columns))


def row_hash_key(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.coalesce("after", "before")), 256)


def latest(df: DataFrame, key: Column, order: list[str], keep_deletes: bool = False) -> DataFrame:
    """The last event per key; keys whose last event is a delete go, unless they are kept.

    One aggregation: events are folded per key before the shuffle, so a hot key moves one row per task.
    """
    cols = [c for c in df.columns if c != "_key"]
    best = df.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    out = best.select("_key", "_row.*")
    return out if keep_deletes else out.where("op <> 'd'")


def needs_compaction(df: DataFrame, key: Column, ratio: float = 0.5, segment: int = 1_000_000, last_s: int | None = None, now_s: int | None = None, interval_s: int = 300) -> DataFrame:
    """total, dirty (events that another one of their key has replaced), and whether a compaction is due.

    Due: dirty ones reach their ratio, the events reach a segment's size, or the last compaction (last_s) is interval_s ago.
    """
    per = df.groupBy(key.alias("_key")).agg(F.count("*").alias("n"))
    out = per.agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("dirty"))
    waited = last_s is not None and now_s is not None and now_s - last_s >= interval_s
    return out.withColumn("due", (F.col("dirty") >= ratio * F.col("total")) | (F.col("total") >= segment) | F.lit(waited))


def merge_state(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Two key tables as one: where both have a key, the newer table's row stays."""
    rest = [c for c in old.columns if c != key]
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_side").alias("_r")).select(key, "_r.*")


def segment_and_merge(df: DataFrame, key: Column, order: list[str], segment: Column) -> DataFrame:
    """The latest per key, segment by segment and then over all of them. Segments keep their deletes, so a delete in a newer
    segment hides older values."""
    per = latest(df, F.concat_ws("/", segment, key), order, keep_deletes=True).drop("_key")
    return latest(per, key, order)


def expire_tombstones(df: DataFrame, now_s: int, retention_s: int = 24 * 3600) -> DataFrame:
    return df.where(~((F.col("op") == "d") & (F.col("ts_s") < now_s - retention_s)))


def emit_tombstones(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """A delete is followed by a tombstone (no images) of the same key; excluded tables have none."""
    emits = (F.col("op") == "d") & (P.negate(P.table_match(exclude)) if exclude else F.lit(True))
    both = df.withColumn("tombstone", F.explode(F.when(emits, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return both.withColumns({"before": F.when(~F.col("tombstone"), F.col("before")), "after": F.when(~F.col("tombstone"), F.col("after"))})


def compact_log(log: DataFrame, active_from: int) -> DataFrame:
    """Sealed records (offset below active_from) keep the highest offset per key, without empty values; others stay.

    Keyless records stay. log: topic/partition columns, offset, key, value; keys are compacted within a partition.
    """
    sealed = F.col("offset") < active_from
    last = log.where(sealed & F.col("key").isNotNull()).groupBy("partition", "key").agg(F.max("offset").alias("offset"))
    kept = log.where(sealed & F.col("key").isNotNull()).join(last, ["partition", "key", "offset"], "left_semi").where(F.octet_length(F.coalesce(F.col("value"), F.lit(""))) > 0)
    return kept.select(log.columns).unionByName(log.where(~sealed | F.col("key").isNull()))


def retain(log: DataFrame, bytes_kept: int | None = None, not_before: int | None = None) -> DataFrame:
    """Retention by age, and by size: per partition the newest records whose running bytes stay within bytes_kept."""
    from pyspark.sql import Window as W

    if not_before is not None:
        log = log.where(F.col("timestamp") >= not_before)
    if bytes_kept is not None:
        # Sizes are summed per run of offsets first, so only the run on the border is summed row by row.
        size = F.octet_length(F.coalesce("value", F.lit("")))
        run = F.floor(F.col("offset") / 4096)
        runs = log.groupBy("partition", run.alias("_run")).agg(F.sum(size).alias("_b"))
        newer = runs.withColumn("_newer", F.sum("_b").over(W.partitionBy("partition").orderBy(F.desc("_run"))) - F.col("_b")).select("partition", "_run", "_newer")
        rows = log.withColumn("_run", run).join(newer, ["partition", "_run"])
        total = F.sum(size).over(W.partitionBy("partition", "_run").orderBy(F.desc("offset"))) + F.col("_newer")
        log = rows.withColumn("_t", total).where(F.col("_t") <= bytes_kept).select(log.columns)
    return log
