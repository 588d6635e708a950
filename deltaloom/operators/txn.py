"""Transactions: grouping, boundaries, isolation, idempotent producers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_transactions(df: DataFrame) -> DataFrame:
    """One row per transaction: lsn, commit time, events (seq numbers in order), count, whether the last event has come.

    The events come as an array of (sequence, seq, op): a transaction is as large as its source let it be.
    """
    t = df.where("txn is not null")
    return t.groupBy(F.col("txn.id").alias("txn_id")).agg(
        F.max("txn.lsn").alias("lsn"), F.max("txn.commit_ts").alias("commit_ts"), F.count("*").alias("n_events"),
        F.bool_or("txn.is_last").alias("complete"), F.sort_array(F.collect_list(F.struct(F.col("txn.sequence").alias("sequence"), "seq", "op"))).alias("events"),
    )


def first_last(df: DataFrame) -> DataFrame:
    """is_first, is_last (as the source says it) and single (the only event) within each transaction."""
    n = df.where("txn is not null").groupBy(F.col("txn.id").alias("_t")).agg(F.count("*").alias("_n"), F.min(F.struct("txn.sequence", "seq")).alias("_f"))
    out = df.join(n, df["txn.id"] == n["_t"])
    return out.withColumns({"is_first": F.struct("txn.sequence", "seq") == F.col("_f"), "is_last": F.col("txn.is_last"), "single": F.col("_n") == 1}).drop("_t", "_n", "_f")


def transaction_orders(df: DataFrame) -> DataFrame:
    """total_order in the transaction and collection_order in its table, both from 1."""
    w = Window.partitionBy("txn.id").orderBy("txn.sequence", "seq")
    c = Window.partitionBy("txn.id", "schema", "table").orderBy("txn.sequence", "seq")
    return df.where("txn is not null").withColumns({"total_order": F.row_number().over(w), "collection_order": F.row_number().over(c)})


def boundaries(df: DataFrame) -> DataFrame:
    """BEGIN and END per transaction; END has the events' count and each collection's."""
    t = df.where("txn is not null")
    per = t.groupBy(F.concat_ws(":", "txn.id", "txn.lsn").alias("id"), F.concat_ws(".", "schema", "table").alias("collection")).agg(F.count("*").alias("n"), F.min("ts_s").alias("first"), F.max("ts_s").alias("last"))
    whole = per.groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("collection", "n"))).alias("collections"))
    status = F.explode(F.array(F.lit("BEGIN"), F.lit("END"))).alias("status")
    rows = whole.select("*", status)
    end = F.col("status") == "END"
    return rows.select("status", "id", F.when(end, F.col("last")).otherwise(F.col("first")).alias("ts_s"), F.when(end, F.col("n")).alias("event_count"), F.when(end, F.to_json("collections")).alias("collections"))


def committed_only(log: DataFrame, aborted: DataFrame, open_from: DataFrame | None = None) -> DataFrame:
    """Records outside aborted ranges (producer_id, first, last), and below what is still open (partition, first_open)."""
    hit = (log["producer_id"] == aborted["producer_id"]) & (log["offset"] >= aborted["first"]) & (log["offset"] <= aborted["last"])
    if "partition" in aborted.columns:
        hit = hit & (log["partition"] == aborted["partition"])
    out = log.join(aborted, hit, "left_anti")
    if open_from is not None:
        out = out.join(open_from, "partition", "left").where(F.col("first_open").isNull() | (F.col("offset") < F.col("first_open"))).drop("first_open")
    return out


def sequence_steps(log: DataFrame, epoch: str = "epoch", sequence: str = "sequence") -> DataFrame:
    """step of each record against the one before it of its producer, partition and epoch: first, next, repeat or gap."""
    prev = F.lag(sequence).over(Window.partitionBy("producer_id", "partition", epoch).orderBy("offset"))
    at = log.withColumn("_p", prev)
    step = F.when(F.col("_p").isNull(), "first").when(F.col(sequence) == F.col("_p") + 1, "next").when(F.col(sequence) <= F.col("_p"), "repeat").otherwise("gap")
    return at.withColumn("step", step).drop("_p")


def check_sequences(log: DataFrame) -> DataFrame:
    """valid, duplicate, out_of_order, fenced or reset, by the running highest epoch and the sequence before."""
    w = Window.partitionBy("producer_id", "partition").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("epoch", "sequence")).over(w)
    seen = log.withColumn("_l", last)
    status = (
        F.when(F.col("_l").isNull(), F.when(F.col("sequence") == 0, "valid").otherwise("out_of_order"))
        .when(F.col("epoch") < F.col("_l.epoch"), "fenced")
        .when(F.col("epoch") > F.col("_l.epoch"), F.when(F.col("sequence") == 0, "reset").otherwise("out_of_order"))
        .when(F.col("sequence") <= F.col("_l.sequence"), "duplicate")
        .when(F.col("sequence") == F.col("_l.sequence") + 1, "valid")
        .otherwise("out_of_order")
    )
    return seen.withColumn("status", status).drop("_l")


def outcomes(markers: DataFrame) -> DataFrame:
    """The state of each transaction from its markers (txn_id, seq, marker: begin, prepare_commit, commit, prepare_abort, abort).

    Where markers have an epoch, a producer of an older epoch than one seen before is fenced: its markers don't count.
    """
    fenced = "epoch" in markers.columns
    if fenced:  # a marker of an older epoch than one before it is void
        top = F.max("epoch").over(Window.partitionBy("txn_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        markers = markers.withColumn("_top", top).where(F.col("_top").isNull() | (F.col("epoch") >= F.col("_top")))
    last = markers.groupBy("txn_id").agg(F.max_by("marker", "seq").alias("marker"))
    state = F.when(F.col("marker") == "commit", "complete_commit").when(F.col("marker") == "abort", "complete_abort").when(F.col("marker").isin("begin", "empty"), "ongoing")
    return last.select("txn_id", state.otherwise(F.col("marker")).alias("state"))
