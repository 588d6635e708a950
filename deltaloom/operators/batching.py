"""Batches of ordered logs: flushed by count, bytes or time, and transactions kept whole or forced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batches(df: DataFrame, log: list[str], order: list[str], max_events: int = 1000, max_bytes: int = 1 << 20, max_ms: int | None = None, size: str | None = None, at_ms: str | None = None, txn: str | None = None) -> DataFrame:
    """df with `batch` (from 0 in each log) and `flushed_by`: events, bytes, time or end.

    Each log (the columns `log`) is read in order. An event joins the open batch, which is flushed once it has max_events, or
    max_bytes of column `size`. A batch whose first event is max_ms of `at_ms` older than the next event is flushed before
    that one, but not within a transaction (equal, not null values of `txn`). What is open at the end is a batch too.

    The rule looks back at the batch's start, so a log is one sorted stream: a task holds the counters of its open batch and a
    slice of rows, never a log. Logs are dealt over the tasks.
    """
    cols = [*log, *order, *(c for c in (size, at_ms, txn) if c)]
    kind = df.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", batch long, flushed_by string"

    def run(parts):
        import pyarrow as pa

        key, number, count, held, began, last, waiting = None, -1, 0, 0, None, None, []

        def close(why):
            nonlocal count
            done = [(b, n, why) for b, n in waiting]
            waiting.clear()
            count = 0
            return done

        def emit(done, number):
            for rows, n, why in done:
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([number] * n, pa.int64()), pa.array([why] * n, pa.string())], [*rows.schema.names, "batch", "flushed_by"])

        for part in parts:
            values = {c: part.column(c).to_pylist() for c in dict.fromkeys(cols)}
            first = 0
            for i in range(part.num_rows):
                own = tuple(values[c][i] for c in log)
                if own != key or (count and at_ms and max_ms is not None and values[at_ms][i] - began >= max_ms and not (txn and last is not None and values[txn][i] == last)):
                    why = "end" if own != key else "time"
                    if i > first:
                        waiting.append((part.slice(first, i - first), i - first))
                        first = i
                    if waiting:
                        yield from emit(close(why), number)
                    count = 0
                    if own != key:
                        key, number = own, -1
                if not count:
                    number, held, began = number + 1, 0, values[at_ms][i] if at_ms else None
                count += 1
                held += (values[size][i] or 0) if size else 0
                last = values[txn][i] if txn else None
                if count >= max_events or held >= max_bytes:
                    waiting.append((part.slice(first, i + 1 - first), i + 1 - first))
                    first = i + 1
                    yield from emit(close("events" if count >= max_events else "bytes"), number)
            if part.num_rows > first:
                waiting.append((part.slice(first), part.num_rows - first))
        if waiting:
            yield from emit(close("end"), number)

    return df.repartition(*log).sortWithinPartitions(*log, *order).mapInArrow(run, out)


def forced_parts(df: DataFrame, max_events: int = 10_000, max_bytes: int = 64 << 20, size: str | None = None, timeout_s: int | None = None) -> DataFrame:
    """Transactions' parts: (txn_id, part, n_events, first_seq, last_seq, complete, forced_by).

    A transaction ends with its last event. One that reaches max_events or max_bytes before is forced out, and what follows
    is a further part; so is what comes timeout_s after the open part's first event. Nothing is lost: what is still open is
    a part that is not complete. Events without a transaction are parts of their own (null txn_id).
    """
    rows = df.where("txn is not null").select(F.col("txn.id").alias("txn_id"), F.col("txn.sequence").alias("_q"), "seq", F.col("txn.is_last").alias("is_last"), (F.col("ts_s") * 1000).alias("_ms"), (F.lit(0) if size is None else F.col(size)).cast("long").alias("_size"))
    cut = batches(rows, ["txn_id"], ["_q", "seq"], max_events, max_bytes, None if timeout_s is None else timeout_s * 1000, "_size", "_ms")
    out = cut.groupBy("txn_id", F.col("batch").alias("part")).agg(F.count("*").alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.bool_or("is_last").alias("complete"), F.first("flushed_by").alias("why"))
    alone = df.where("txn is null").select(F.lit(None).cast("string").alias("txn_id"), F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("n_events"), F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"), F.lit(True).alias("complete"), F.lit(None).cast("string").alias("forced_by"))
    return out.select("txn_id", "part", "n_events", "first_seq", "last_seq", "complete", F.when(~F.col("complete") & (F.col("why") != "end"), F.col("why")).alias("forced_by")).unionByName(alone)
