"""Connectors: a Python data source for generated rows, batch sinks, and the catalogue of what maps to what in Spark."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from deltaloom.functions.scalar import fnv1a64

#: How each kind of source and sink of a change-event platform is reached from Spark; None: no service or package here.
SOURCES = {
    "datagen": "spark.read.format('deltaloom_datagen') or datagen.generate", "rdbc": "poll.jdbc and the polls", "sqlserver_cdc": "poll.incrementing over change tables by JDBC", "kafka": "poll.kafka",
    "postgres_cdc": "a landed change log, read as a file stream", "mysql_cdc": "a landed change log, read as a file stream", "mqtt": None, "sqs": None, "pubsub": None, "http": None,
}
SINKS = {
    "stdout": "writeStream.format('console')", "http": "connectors.webhook", "kafka": "writeStream.format('kafka')", "object": "formats.write_objects", "delta": "format('delta') where the package is there, else Parquet",
    "iceberg": "format('iceberg') where the package is there, else Parquet", "rdbc": "formats.merge and write.jdbc", "vector": "connectors.vector_rows", "warehouse": "write.jdbc or staged Parquet", "sqs": None, "pubsub": None,
}


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


class DatagenReader(DataSourceReader):
    def __init__(self, rows: int, parts: int, seed: int):
        self.rows, self.parts, self.seed = rows, parts, seed

    def partitions(self):
        step = -(-self.rows // self.parts)
        return [_Rows(k, min(self.rows, k + step)) for k in range(0, self.rows, step)] if self.rows else []

    def read(self, part):
        for i in range(part.first, part.last):
            h = int.from_bytes(hashlib.blake2b(f"{self.seed}:{i}".encode(), digest_size=8).digest(), "little")
            yield (i, h % 1000, "abc"[h % 3])


class DatagenSource(DataSource):
    """Options rows, partitions, seed; the same options give the same rows however they are dealt out."""

    @classmethod
    def name(cls) -> str:
        return "deltaloom_datagen"

    def schema(self) -> str:
        return "id long, value long, category string"

    def reader(self, schema) -> DatagenReader:
        o = self.options
        return DatagenReader(int(o.get("rows", 100)), int(o.get("partitions", 4)), int(o.get("seed", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DatagenSource)


def signed(body: bytes, secret: str) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def webhook(df: DataFrame, send: Callable[[bytes, dict], None], secret: str | None = None, batch: int = 500) -> None:
    """Send rows as JSON arrays of at most `batch`, signed, once per task attempt; `send` must bear repeats.

    Each array carries an idempotency key, the hash of its content, by which the receiver can tell a repeat.
    """

    def post(rows) -> None:
        def flush(part) -> None:
            body = ("[" + ",".join(part) + "]").encode()
            headers = {"Content-Type": "application/json", "Idempotency-Key": hashlib.sha256(body).hexdigest()}
            send(body, headers | ({"X-Signature": signed(body, secret)} if secret else {}))

        held: list[str] = []
        for r in rows:
            held.append(r["json"])
            if len(held) == batch:
                flush(held)
                held = []
        if held:
            flush(held)

    df.select(F.to_json(F.struct("*")).alias("json")).foreachPartition(post)


def vector_rows(df: DataFrame, vector: str, how: str = "hash", key: str | None = None) -> DataFrame:
    """(id, vector, payload) for vector stores; id by field, uuid, or the FNV-1a hash of the payload."""
    payload = F.to_json(F.struct(*(c for c in df.columns if c != vector)))
    ident: Column = {"field": lambda: F.col(key).cast("string"), "uuid": F.uuid, "hash": lambda: fnv1a64(payload)}[how]()
    return df.select(ident.alias("id"), F.col(vector).alias("vector"), payload.alias("payload"))


@dataclass
class Source:
    """check, discover and read of a connector: each is a function, so that tests need no service."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    check: Callable[[], bool] = lambda: True
    options: dict = field(default_factory=dict)

    def discover(self, spark: SparkSession) -> dict:
        """The stream's JSON schema, without reading any row."""
        return {"stream": self.name, "json_schema": json.loads(self.read(spark).schema.json())}
