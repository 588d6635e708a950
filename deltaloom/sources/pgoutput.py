"""Landed logical-replication messages (pgoutput, protocol 1) as change events.

Messages are parsed one by one, without state; what a message means by what came before it, its relation's columns and its
transaction, comes from windows over the log.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = "array<struct<unchanged: boolean, value: string>>"
MESSAGE = f"slot string, pos long, kind string, xid long, lsn long, ts_us long, relation long, schema string, table string, identity string, columns array<struct<name: string, key: boolean, type: long>>, old_kind string, before {CELL}, after {CELL}, relations array<long>, error string"
#: Microseconds from 1970 to 2000, where the log's clock starts.
EPOCH_US = 946_684_800_000_000


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, fmt: str):
        got = struct.unpack_from(f">{fmt}", self.data, self.at)
        self.at += struct.calcsize(f">{fmt}")
        return got[0] if len(got) == 1 else got

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out

    def cells(self) -> list[dict]:
        out = []
        for _ in range(self.take("H")):
            kind = self.take("c")
            if kind in (b"t", b"b"):
                n = self.take("i")
                if self.at + n > len(self.data):
                    raise ValueError("cell beyond the message")
                out.append({"unchanged": False, "value": self.data[self.at : self.at + n].decode("utf-8", "replace")})
                self.at += n
            elif kind in (b"n", b"u"):
                out.append({"unchanged": kind == b"u", "value": None})
            else:
                raise ValueError(f"unknown cell {kind!r}")
        return out


def parse(data: bytes | None) -> dict:
    """The fields of one message; a broken or unknown one has only `error`."""
    out: dict = {}
    try:
        c = Cursor(data or b"")
        kind = out["kind"] = c.take("c").decode("latin-1")
        if kind == "B":
            out["lsn"], ts, out["xid"] = c.take("QqI")
            out["ts_us"] = ts + EPOCH_US
        elif kind in ("C", "c"):
            if kind == "c":
                out["xid"] = c.take("I")
            _, out["lsn"], _, ts = c.take("BQQq")
            out["ts_us"] = ts + EPOCH_US
        elif kind == "R":
            out["relation"], out["schema"], out["table"] = c.take("I"), c.text(), c.text()
            out["identity"], n = c.take("c").decode("latin-1"), c.take("H")
            out["columns"] = []
            for _ in range(n):
                flags, name, (oid, _) = c.take("B"), c.text(), c.take("ii")
                out["columns"].append({"name": name, "key": bool(flags & 1), "type": oid})
        elif kind in "IUD":
            out["relation"] = c.take("I")
            part = c.take("c")
            if kind != "I" and part in (b"K", b"O"):
                out["old_kind"], out["before"] = part.decode(), c.cells()
                part = c.take("c") if kind == "U" else b""
            if kind != "D":
                if part != b"N":
                    raise ValueError("no new row")
                out["after"] = c.cells()
            elif "before" not in out:
                raise ValueError("no old row")
        elif kind == "T":
            n, _ = c.take("IB")
            out["relations"] = [c.take("I") for _ in range(n)]
        elif kind == "O":
            out["lsn"] = c.take("Q")
        elif kind == "S":
            out["xid"] = c.take("IB")[0]
        elif kind == "A":
            out["xid"] = c.take("II")[0]
        elif kind not in "YE":
            raise ValueError(f"unknown message {kind!r}")
    except (struct.error, ValueError) as e:
        return {"error": str(e)}
    return out


def messages(log: DataFrame) -> DataFrame:
    """log: (slot, pos, data binary), pos ascending within a slot. One parsed row per message."""

    def run(batches):
        import pyarrow as pa

        names = ["slot", "pos", "kind", "xid", "lsn", "ts_us", "relation", "schema", "table", "identity", "columns", "old_kind", "before", "after", "relations", "error"]
        cell = pa.list_(pa.struct([("unchanged", pa.bool_()), ("value", pa.string())]))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("key", pa.bool_()), ("type", pa.int64())])), pa.string(), cell, cell, pa.list_(pa.int64()), pa.string()]
        for batch in batches:
            rows = [parse(d) for d in batch.column("data").to_pylist()]
            got = [pa.array([r.get(n) for r in rows], k) for n, k in zip(names[2:], kinds[2:])]
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("pos"), *got], names)

    return log.select(F.col("slot").cast("string"), F.col("pos").cast("long"), F.col("data").cast("binary")).mapInArrow(run, MESSAGE)


def change_events(log: DataFrame) -> DataFrame:
    """(slot, seq, schema, table, op, before, after, xid, lsn, ts_s): images are maps from column names to texts.

    A column that the source left out as unchanged takes its value from the old image if that is whole, and is missing
    otherwise. A delete's or update's key image holds the key's columns only. Events of a relation that the log has not
    described yet have no names; messages that can't be read, and those without events, give no rows.
    """
    m = messages(log)
    m = m.withColumn("relation", F.explode_outer(F.coalesce("relations", F.array("relation"))))
    described = F.when(F.col("kind") == "R", F.struct("schema", "table", "columns"))
    began = F.when(F.col("kind") == "B", F.struct("xid", "lsn", "ts_us"))
    to_here = lambda *by: Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("of", F.last(described, True).over(to_here("slot", "relation"))).withColumn("txn", F.last(began, True).over(to_here("slot")))
    e = m.where(F.col("kind").isin("I", "U", "D", "T")).withColumnsRenamed({"before": "was", "after": "now"})

    def image(cells, other=None, key_only=None):
        zipped = F.transform(F.arrays_zip(F.col("of.columns").alias("c"), cells.alias("v")), lambda x: F.struct(x["c"]["name"].alias("name"), x["c"]["key"].alias("key"), x["v"]["unchanged"].alias("unchanged"), x["v"]["value"].alias("value")))
        if other is not None:
            whole = F.col("old_kind") == "O"
            zipped = F.transform(zipped, lambda x, k: F.struct(x["name"].alias("name"), x["key"].alias("key"), (x["unchanged"] & ~F.coalesce(whole, F.lit(False))).alias("unchanged"), F.when(x["unchanged"], F.get(other, k)["value"]).otherwise(x["value"]).alias("value")))
        kept = F.filter(zipped, lambda x: ~x["unchanged"] & (x["key"] if key_only is None else (x["key"] | ~key_only)))
        return F.when(cells.isNotNull() & F.col("of").isNotNull(), F.map_from_entries(F.transform(kept, lambda x: F.struct(x["name"], x["value"]))))

    op = F.when(F.col("kind") == "I", "c").when(F.col("kind") == "U", "u").when(F.col("kind") == "D", "d").otherwise("t")
    return e.select(
        "slot", F.col("pos").alias("seq"), "of.schema", "of.table", op.alias("op"), image(F.col("was"), None, F.col("old_kind") == "K").alias("before"),
        image(F.col("now"), F.col("was"), F.lit(False)).alias("after"), "txn.xid", "txn.lsn", F.floor(F.col("txn.ts_us") / 1_000_000).alias("ts_s"),
    )
