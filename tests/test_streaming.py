from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import txn
from deltaloom.streaming import stateful


def stream_of(spark, tmp_path, df, files=3):
    path = str(tmp_path / "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return stream.sparkSession.table(name)


def test_transactions_stream_equals_batch(spark, tmp_path):
    rows = spark.range(50).select(F.floor(F.col("id") / 5).cast("string").alias("txn_id"), (F.col("id") % 5 == 4).alias("is_last"))
    got = run(stateful.group_transactions(stream_of(spark, tmp_path, rows, 1), timeout_ms=None), "txns", tmp_path).collect()
    assert sorted((int(r["txn_id"]), r["n_events"], r["complete"]) for r in got) == [(k, 5, True) for k in range(10)]


def test_deduplicate_stream(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 8).alias("k"), F.timestamp_seconds(F.col("id")).alias("at"))
    got = run(stateful.deduplicate(stream_of(spark, tmp_path, rows), "at", ["k"], "1 hour"), "dedup", tmp_path)
    assert got.count() == 8


def test_upsert_latest(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"))
    q = stateful.upsert_latest(stream_of(spark, tmp_path, rows), spark, str(tmp_path / "out"), "k", ["seq"], str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    versions = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if "=" in p.name)
    got = spark.read.parquet(str(tmp_path / "out" / f"version={versions[-1]}"))
    assert {r["k"]: r["seq"] for r in got.collect()} == {k: max(x for x in range(60) if x % 7 == k) for k in range(7)}


def test_sequences_in_batch(spark):
    rows = [(1, 0, 0, 0, 5), (2, 0, 0, 0, 0), (2, 0, 1, 2, 4)]
    df = spark.createDataFrame(rows, "producer_id long, partition int, offset long, epoch int, sequence int")
    assert sorted(r["status"] for r in txn.check_sequences(df).collect()) == ["out_of_order", "out_of_order", "valid"]


def test_sequence_check_keeps_its_state():
    import pandas as pd

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    p = stateful.SequenceCheck()
    p.init(Handle())
    give = lambda *rows: [s for out in p.handleInputRows((1, 0), iter([pd.DataFrame(rows, columns=["offset", "epoch", "sequence"])]), None) for s in out["status"]]
    assert give((0, 0, 0), (1, 0, 1), (2, 0, 1)) == ["valid", "valid", "duplicate"]
    assert give((3, 0, 3), (4, 1, 0), (5, 0, 4), (6, 1, 1)) == ["out_of_order", "reset", "fenced", "valid"]
