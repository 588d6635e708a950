"""Incremental snapshots: chunks, windows against the stream, read-only watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_range(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Rows with low < key <= high; an open end does not restrict."""
    if low is not None:
        df = df.where(F.col(key) > F.lit(low))
    return df if high is None else df.where(F.col(key) <= F.lit(high))


def chunk_of(key: Column, bounds: list) -> Column:
    """The number of the chunk that a key is in, for ascending bounds (each the upper, inclusive end of its chunk)."""
    out = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(key <= F.lit(bounds[k]), k).otherwise(out)
    return out.cast("int")


def reconcile(snapshot: DataFrame, stream: DataFrame, key: str, watermark: int | None) -> DataFrame:
    """Snapshot rows that no stream event overrides: a delete of the key, or an event at or after the window's opening.

    Without a watermark any event overrides. stream: key, op, event_ts. Events are folded per key before the join.
    """
    over = F.lit(True) if watermark is None else (F.col("op") == "d") | (F.col("event_ts") >= watermark)
    keys = stream.where(over).select(F.col(key).alias("_k")).distinct()
    return snapshot.join(keys, snapshot[key] == keys["_k"], "left_anti")


def read_only_choice(events: DataFrame, snapshot: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Per snapshot row: keep the event (its xid lies within the window) or the snapshot row; xid: the latest event's."""
    last = events.where((F.col("xid") >= low) & (F.col("xid") <= high)).groupBy(F.col(key).alias("_k")).agg(F.max("xid").alias("xid"))
    out = snapshot.join(last, snapshot[key] == last["_k"], "left").drop("_k")
    return out.withColumn("choice", F.when(F.col("xid").isNotNull(), "event").otherwise("snapshot"))


#: What a start does by its mode: whether it reads the tables' rows, and whether it streams after that. "absent": only without
#: a stored position, "lost": also if the stored position is no longer in the log.
MODES = {
    "always": ("yes", True),
    "initial": ("absent", True),
    "initial_only": ("absent", False),
    "schema_only": ("no", True),
    "when_needed": ("lost", True),
    "recovery": ("no", True),
}


def phases(mode: str, has_position: bool, in_log: bool = True, snapshot_data: bool = True, start_stream: bool = True, on_data_error: bool = False) -> tuple[bool, bool]:
    """(read the rows, stream) at a start. configuration_based takes both from the flags, and reads the rows where the position
    is lost if on_data_error says so. recovery only rebuilds schemas, so it needs a stored position."""
    if mode == "configuration_based":
        lost = on_data_error and not (has_position and in_log)
        return (snapshot_data and not has_position) or lost, start_stream
    if mode == "recovery" and not has_position:
        raise ValueError("recovery needs a stored position")
    reads, streams = MODES[mode]
    return reads == "yes" or (reads in ("absent", "lost") and not has_position) or (reads == "lost" and not in_log), streams


def start(snapshot: DataFrame, stream: DataFrame, mode: str, has_position: bool, **flags) -> DataFrame:
    """What a connector emits at a start: the snapshot's rows if its mode reads them, then the stream if it streams."""
    reads, streams = phases(mode, has_position, **flags)
    return snapshot_then_stream(snapshot if reads else snapshot.where("false"), stream if streams else stream.where("false"))


def in_windows(snapshot: DataFrame, stream: DataFrame, key: str, chunk: Column, windows: DataFrame) -> DataFrame:
    """Rows of an incremental snapshot as reads, with the stream position at which their chunk's window closes.

    windows: (chunk, low, high) positions between which each chunk was read. A row goes if the stream has an event of its
    key within its chunk's window: that event is newer. stream: key, position.
    """
    rows = snapshot.withColumn("chunk", chunk).join(windows, "chunk")
    keys = rows.select(key, "chunk", "low", "high").join(stream.select(F.col(key).alias("_k"), "position"), F.col(key) == F.col("_k"))
    over = keys.where((F.col("position") >= F.col("low")) & (F.col("position") <= F.col("high"))).select(key, "chunk").distinct()
    return rows.join(over, [key, "chunk"], "left_anti").withColumn("position", F.col("high")).drop("low", "high")


def batches_left(rows: DataFrame, key: str, batch: int, done: DataFrame) -> DataFrame:
    """Rows of the batches (numbers of `batch` keys each) that the progress table (batch) does not list: where to go on."""
    return rows.withColumn("batch", F.floor(F.col(key) / batch)).join(done.select("batch"), "batch", "left_anti")


def snapshot_then_stream(snapshot: DataFrame, stream: DataFrame) -> DataFrame:
    """Snapshot rows as reads (op r, order 0), then the stream."""
    return snapshot.unionByName(stream, allowMissingColumns=True)


def progress(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("table").agg(F.count("*").alias("chunks"), F.count_if("done").alias("done"), (100.0 * F.count_if("done") / F.count("*")).alias("percent"))
