"""Sinks and formats: object layouts, merges, publishing, wire frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions import predicates as P
from deltaloom.operators.compaction import latest
from deltaloom.operators.offsets import dense_offsets

EXTENSIONS = {"none": "", "gzip": ".gz", "zstd": ".zst", "snappy": ".snappy", "lz4": ".lz4"}


def write_objects(df: DataFrame, path: str, seconds: str, by: str = "none", fmt: str = "parquet", compression: str = "zstd") -> None:
    """by: none, day or hour: folders by time. Each folder's rows are dealt over tasks as their number asks for."""
    at = F.timestamp_seconds(seconds)
    parts = {"none": {}, "day": {"day": F.date_format(at, "yyyy-MM-dd")}, "hour": {"day": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")}}[by]
    out = df.withColumns({f"p_{k}": v for k, v in parts.items()}) if parts else df
    if parts:
        out = out.hint("rebalance", *(f"p_{k}" for k in parts))
    w = out.write.format(fmt).option("compression", compression)
    (w.partitionBy(*(f"p_{k}" for k in parts)) if parts else w).save(path)


def write_csv(df: DataFrame, path: str, null: str = "") -> None:
    """Columns in order of their names; nested ones as JSON text; quotes doubled."""
    cols = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name) for f in sorted(df.schema, key=lambda f: f.name)]
    df.select(cols).write.csv(path, header=True, quote='"', escape='"', nullValue=null)


def json_array(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """One JSON array per group; groups have to be of a bounded size."""
    return df.groupBy(*group).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct("*").alias("_r")))), lambda x: x["_r"])).alias("json"))


def merge(target: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The target after upserts and deletes: the last event per key wins, untouched rows stay."""
    last = latest(changes, P.field(key), order, keep_deletes=True)
    kept = target.join(last.select(F.col("_key").alias(key)), key, "left_anti").select(target.columns)
    new = last.where("op <> 'd'").select(*(F.col(f"after.{c}") for c in target.columns))
    return kept.unionByName(new)


def publish(df: DataFrame, ends: DataFrame, order: list[str]) -> DataFrame:
    """Records with offsets that go on from each partition's end (partition, latest)."""
    out = dense_offsets(df, ["partition"], order, "_n").join(ends.select("partition", "latest"), "partition", "left")
    return out.withColumn("offset", (F.col("_n") + F.coalesce("latest", F.lit(0))).cast("long")).drop("_n", "latest")


def sync(old: DataFrame, new: DataFrame, mode: str, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """append, overwrite, or append_dedup (the last row per key by order)."""
    if mode == "overwrite":
        return new
    both = old.unionByName(new)
    if mode == "append":
        return both
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def schema_frame(payload: Column, schema_id: int) -> Column:
    """A zero byte, the schema id in 4 bytes (big-endian), the payload."""
    return F.concat(F.lit(bytes([0]) + schema_id.to_bytes(4, "big")), payload.cast("binary"))


def unframe(data: Column) -> Column:
    """(schema_id, payload), or null where the frame's first byte is not zero or it is too short."""
    ok = (F.octet_length(data) >= 5) & (F.hex(F.substring(data, 1, 1)) == "00")
    return F.when(ok, F.struct(F.conv(F.hex(F.substring(data, 2, 4)), 16, 10).cast("long").alias("schema_id"), F.substr(data, F.lit(6)).alias("payload")))


def backoff_ms(attempt: Column, first: int = 100) -> Column:
    """The wait after a failed attempt, counted from 0: it doubles each time."""
    return (F.lit(first) * F.pow(F.lit(2.0), attempt)).cast("long")


def retried(df: DataFrame, failures: Column, attempts: int = 3) -> DataFrame:
    """df with tries (publish attempts made), waited_ms between them, and dead: all `attempts` of them failed.

    failures: how many attempts fail before one succeeds.
    """
    tries = F.least(failures + 1, F.lit(attempts)).cast("int")
    waits = F.aggregate(F.sequence(F.lit(0), F.lit(attempts)), F.lit(0).cast("long"), lambda s, k: s + F.when(k < F.least(failures, F.lit(attempts)), backoff_ms(k)).otherwise(0))
    return df.withColumns({"tries": tries, "waited_ms": waits, "dead": failures >= attempts})


def dead_letter_envelope(topic: Column, connector: str, payload: Column, error: Column, retries: Column, at: Column) -> Column:
    """The dead-letter record as JSON: where it was bound for, the payload in base 64, the error, the retries, the time."""
    return F.to_json(F.struct(topic.alias("original_topic"), F.lit(connector).alias("connector_name"), F.base64(payload.cast("binary")).alias("payload_b64"), error.alias("error"), retries.cast("int").alias("retry_count"), at.alias("timestamp")))


def dead_letters(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, rows for the dead-letter sink): by whether the error column is null."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
