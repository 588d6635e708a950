"""Landed replication messages and tables under a transaction log."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from deltaloom.sources import lakehouse, pgoutput


def text(s):
    return s.encode() + b"\0"


def cells(*values):
    out = struct.pack(">H", len(values))
    for v in values:
        out += b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">i", len(v.encode())) + v.encode()
    return out


def relation(number, name, *columns):
    return b"R" + struct.pack(">I", number) + text("public") + text(name) + b"d" + struct.pack(">H", len(columns)) + b"".join(bytes([k]) + text(c) + struct.pack(">ii", 25, -1) for c, k in columns)


def test_messages_become_events(spark):
    begin = lambda x, lsn: b"B" + struct.pack(">QqI", lsn, 1_000_000, x)
    commit = b"C" + struct.pack(">BQQq", 0, 9, 9, 1_000_000)
    dml = lambda k, n, *parts: k + struct.pack(">I", n) + b"".join(parts)
    log = [
        begin(7, 100), relation(1, "users", ("id", 1), ("name", 0), ("bio", 0)), dml(b"I", 1, b"N", cells("1", "Ann", "long")),
        dml(b"U", 1, b"N", cells("1", "Bo", ...)), commit, begin(8, 200), relation(2, "items", ("k", 1)), dml(b"D", 1, b"K", cells("1", None, None)),
        dml(b"U", 1, b"O", cells("2", "x", "kept"), b"N", cells("2", "é", ...)), relation(1, "users", ("id", 1), ("name", 0)), dml(b"I", 1, b"N", cells("3", None)),
        b"T" + struct.pack(">IBII", 2, 0, 1, 2), b"Q?", b"I\0", None, dml(b"I", 9, b"N", cells("1")), commit,
    ]
    df = spark.createDataFrame([("s", k, d) for k, d in enumerate(log)], "slot string, pos long, data binary").repartition(3)
    got = [tuple(r) for r in pgoutput.change_events(df).orderBy("seq", "table").drop("slot", "schema", "ts_s").collect()]
    assert got == [
        (2, "users", "c", None, {"id": "1", "name": "Ann", "bio": "long"}, 7, 100),
        (3, "users", "u", None, {"id": "1", "name": "Bo"}, 7, 100),
        (7, "users", "d", {"id": "1"}, None, 8, 200),
        (8, "users", "u", {"id": "2", "name": "x", "bio": "kept"}, {"id": "2", "name": "é", "bio": "kept"}, 8, 200),
        (10, "users", "c", None, {"id": "3", "name": None}, 8, 200),
        (11, "items", "t", None, None, 8, 200),
        (11, "users", "t", None, None, 8, 200),
        (15, None, "c", None, None, 8, 200),
    ]
    assert pgoutput.change_events(df).first()["ts_s"] == 946_684_801
    assert [pgoutput.parse(d).get("error") is not None for d in (b"Q?", b"I\0", None, commit)] == [True, True, True, False]


def test_table_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string")
    assert lakehouse.write(one, path, ["p"]) == 0
    assert lakehouse.write(one.selectExpr("k + 10 as k", "p"), path, ["p"]) == 1
    assert sorted(map(tuple, lakehouse.read(spark, path).select("k", "p").collect())) == [(1, "a"), (2, "b"), (11, "a"), (12, "b")]
    assert lakehouse.write(one.where("k = 2"), path, ["p"], mode="overwrite") == 2
    assert [tuple(r) for r in lakehouse.read(spark, path).select("k", "p").collect()] == [(2, "b")]
    assert lakehouse.read(spark, path, 1).count() == 4 and lakehouse.read(spark, path, 0).count() == 2
    with pytest.raises(ValueError):
        lakehouse.write(one.withColumnRenamed("k", "j"), path, ["p"])


def test_commit_conflicts(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1,)], "k long")
    lakehouse.write(one, path)
    real, taken = lakehouse._try_commit, []

    def rival(spark, path, version, actions):
        if len(taken) < 2:  # another writer is faster, twice
            taken.append(version)
            assert real(spark, path, version, [{"commitInfo": {}}])
        return real(spark, path, version, actions)

    monkeypatch.setattr(lakehouse, "_try_commit", rival)
    assert lakehouse.write(one, path) == 3 and lakehouse.read(spark, path).count() == 2
    monkeypatch.setattr(lakehouse, "_try_commit", lambda *a: False)
    with pytest.raises(lakehouse.Conflict):
        lakehouse.write(one, path, attempts=2)


def test_two_writers_of_a_topic(spark, tmp_path, monkeypatch):
    from deltaloom import changelog

    log = changelog.ChangeLog(spark, f"file://{tmp_path}/log", 2)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"), F.col("id").alias("timestamp"))
    assert log.publish("t", rows(0, 10), ["timestamp"]) == 0
    real, rival = changelog.create, []

    def slow(spark, path, text):
        if not rival:  # the other writer commits while this one is writing
            rival.append(changelog.ChangeLog(spark, log.path, 2).publish("t", rows(10, 20), ["timestamp"])) if rival.append(None) is None else None
        return real(spark, path, text)

    monkeypatch.setattr(changelog, "create", slow)
    assert log.publish("t", rows(20, 30), ["timestamp"]) == 2
    got = log.log("t").collect()
    assert len(got) == 30 and len({(r["partition"], r["offset"]) for r in got}) == 30
    assert log.topics() == ["t"]
    log.seek("g", "t", "earliest")
    assert log.poll("g", "t").count() == 30
    log.commit("g", "t", log.bounds("t").select("partition", (F.col("latest") - 1).alias("offset")))
    assert log.poll("g", "t").count() == 2
    log.delete_topic("t")
    assert log.topics() == []
