"""A thin client: topics as logs whose methods return DataFrames."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators import offsets, txn
from deltaloom.sources.files import content, create, names, remove, rename
from deltaloom.sources.formats import publish


class ChangeLog:
    """Topics under one path; each publish appends a batch with dense offsets per partition."""

    def __init__(self, spark: SparkSession, path: str, partitions: int = 4):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), partitions

    def publish(self, topic: str, records: DataFrame, order: list[str], attempts: int = 8) -> int:
        """records: key, value, timestamp and what order needs. Records are dealt to partitions by key; null keys by order.

        Returns the batch's number. Offsets go on from the batches before, so two writers must not have one number: a batch is
        written aside and takes the next number by creating its commit file, which only one writer can. The other one
        numbers its records anew. Readers see a batch once its folder has its final name.
        """
        rows = records
        if "partition" not in rows.columns:
            rows = rows.withColumn("partition", F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.concat_ws("|", *order))), F.lit(self.partitions)).cast("int"))
        for _ in range(attempts):
            number, own = self._finish(topic), uuid.uuid4().hex
            publish(rows, self._ends(topic), order).write.parquet(f"{self.path}/{topic}/_staging/{own}")
            if create(self.spark, f"{self.path}/{topic}/_commits/{number:020d}", own):
                self._finish(topic)
                return number
            remove(self.spark, f"{self.path}/{topic}/_staging/{own}")
        raise RuntimeError(f"other writers of {topic} were faster {attempts} times")

    def _finish(self, topic: str) -> int:
        """Give committed batches their final names, also those whose writer was lost; returns the next number."""
        done = set(names(self.spark, f"{self.path}/{topic}"))
        taken = sorted(names(self.spark, f"{self.path}/{topic}/_commits"))
        for n in taken:
            if f"batch-{n}" not in done:
                own = content(self.spark, f"{self.path}/{topic}/_commits/{n}")
                rename(self.spark, f"{self.path}/{topic}/_staging/{own}", f"{self.path}/{topic}/batch-{n}")
        return int(taken[-1]) + 1 if taken else 0

    def _ends(self, topic: str) -> DataFrame:
        if not self._exists(topic):
            return self.spark.createDataFrame([], "partition int, latest long")
        return offsets.bounds(self.log(topic)).select("partition", "latest")

    def _exists(self, topic: str) -> bool:
        return any(n.startswith("batch-") for n in names(self.spark, f"{self.path}/{topic}"))

    def topics(self) -> list[str]:
        return sorted(n for n in names(self.spark, self.path) if not n.startswith("_") and self._exists(n))

    def delete_topic(self, topic: str) -> None:
        remove(self.spark, f"{self.path}/{topic}")

    def commit(self, group: str, topic: str, positions: DataFrame) -> None:
        """positions: (partition, offset) that a group has read up to. A later commit counts more."""
        seq = F.lit(time.time_ns())
        rows = positions.select(F.lit(group).alias("group_id"), F.lit(topic).alias("topic"), F.col("partition").cast("int"), F.col("offset").cast("long"), seq.alias("seq"))
        rows.write.mode("append").parquet(f"{self.path}/group-positions")

    def positions(self, group: str, topic: str) -> DataFrame:
        """(partition, committed) of a group."""
        log = self.spark.read.parquet(f"{self.path}/group-positions").where((F.col("group_id") == group) & (F.col("topic") == topic))
        return offsets.committed(log).select("partition", "committed")

    def seek(self, group: str, topic: str, to: str | int) -> None:
        """Set a group's position in each partition: earliest, latest, or an offset within the bounds."""
        ends = self.bounds(topic)
        new = {"earliest": F.col("earliest"), "latest": F.col("latest")}.get(to, F.least(F.greatest(F.lit(to), "earliest"), "latest"))
        self.commit(group, topic, ends.select("partition", new.alias("offset")))

    def poll(self, group: str, topic: str) -> DataFrame:
        """What a group has not read yet."""
        log = self.log(topic)
        return log.join(self.positions(group, topic), "partition", "left").where(F.col("offset") >= F.coalesce("committed", F.lit(0))).drop("committed")

    def log(self, topic: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{topic}/batch-*")

    def consume(self, topic: str, partition: int, offset: int, most: int = 10_000) -> DataFrame:
        return offsets.read_from(self.log(topic), partition, offset, most)

    def bounds(self, topic: str) -> DataFrame:
        return offsets.bounds(self.log(topic))

    def offset_for(self, topic: str, timestamp: int) -> DataFrame:
        return offsets.offset_for_time(self.log(topic), F.lit(timestamp))

    def committed(self, topic: str, aborted: DataFrame, open_from: DataFrame | None = None) -> DataFrame:
        return txn.committed_only(self.log(topic), aborted, open_from)

    def stream(self, topic: str) -> DataFrame:
        return self.spark.readStream.schema(self.log(topic).schema).parquet(f"{self.path}/{topic}/batch-*")
