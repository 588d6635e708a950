"""Streaming twins: the same results as the batch operators on the same input, with state in the streaming engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicate(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """The first event per key, held for `delay` after the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tombstones(stream: DataFrame) -> DataFrame:
    from deltaloom.operators.compaction import emit_tombstones

    return emit_tombstones(stream)


def windows(stream: DataFrame, time: str, delay: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts per event-time window; rows later than the watermark are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width, slide or width), *keys).agg(F.count("*").alias("n"))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, delay: str) -> DataFrame:
    """Inner join of two streams on key, the right row at most `within` after the left one."""
    a, b = left.withWatermark(left_time, delay).alias("l"), right.withWatermark(right_time, delay).alias("r")
    return a.join(b, F.expr(f"l.{key} = r.{key} and r.{right_time} >= l.{left_time} and r.{right_time} <= l.{left_time} + interval {within}"))


def group_transactions(stream: DataFrame, txn: str = "txn_id", timeout_ms: int | None = 60_000) -> DataFrame:
    """(txn_id, n_events, complete): a row when a transaction's last event has come, or it has been silent too long
    (timeout_ms None: never).

    stream: txn_id, is_last. A count and a flag are all the state that a transaction holds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({"txn_id": [key[0]], "n_events": [n], "complete": [False]})
            return
        n, done = (state.get[0] if state.exists else 0), False
        for pdf in batches:
            n += len(pdf)
            done = done or bool(pdf["is_last"].any())
        if done:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"txn_id": [key[0]], "n_events": [n], "complete": [True]})
        else:
            state.update((n,))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)

    return stream.groupBy(txn).applyInPandasWithState(step, "txn_id string, n_events long, complete boolean", "n long", "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


class SequenceCheck(StatefulProcessor):
    """Producer sequences with transformWithState: the last epoch and sequence per producer and partition."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "epoch long, sequence long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        for pdf in rows:
            out = []
            for r in pdf.sort_values("offset").itertuples():
                at = (r.epoch, r.sequence)
                if last is None:
                    status = "valid" if r.sequence == 0 else "out_of_order"
                elif r.epoch < last[0]:
                    status = "fenced"
                elif r.epoch > last[0]:
                    status = "reset" if r.sequence == 0 else "out_of_order"
                else:
                    status = "duplicate" if r.sequence <= last[1] else "valid" if r.sequence == last[1] + 1 else "out_of_order"
                last = max(at, tuple(last)) if last is not None else at
                out.append((r.offset, status))
            yield pd.DataFrame(out, columns=["offset", "status"])
        if last is not None:
            self.last.update((int(last[0]), int(last[1])))

    def close(self) -> None:
        pass


def upsert_latest(stream: DataFrame, spark: SparkSession, path: str, key: str, order: list[str], checkpoint: str):
    """Keep the latest row per key in versions under path, one per batch, so that a batch that runs again writes the same.

    The newest version below the batch is read, folded with the batch, and written as the batch's own version.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark_ = batch.sparkSession
        cols = batch.columns
        rows = batch
        if batch_id > 0:
            rows = rows.unionByName(spark_.read.schema(batch.schema).parquet(f"{path}/version={batch_id - 1}"))
        best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select("_r.*")
        best.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
