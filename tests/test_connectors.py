from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from deltaloom.changelog import ChangeLog
from deltaloom.operators import models
from deltaloom.sources import connectors, datagen


def test_datagen_source(spark):
    connectors.register(spark)
    read = lambda n: spark.read.format("deltaloom_datagen").option("rows", 50).option("partitions", n).load()
    assert sorted(read(1).collect()) == sorted(read(7).collect()) and read(3).count() == 50


def test_generated_changes_are_consistent(spark):
    live: set = set()
    for r in datagen.change_events(spark, 500, pool=20, seed=3).orderBy("seq").collect():
        key = (r["after"] or r["before"])["id"]
        assert (key in live) == (r["op"] != "c")
        (live.discard if r["op"] == "d" else live.add)(key)


def test_webhook(spark, tmp_path):
    out = str(tmp_path)

    def send(body, headers):
        with open(f"{out}/{headers['Idempotency-Key']}", "w") as f:
            json.dump([body.decode(), headers["X-Signature"]], f)

    connectors.webhook(spark.range(25).repartition(2), send, "secret", 10)
    rows = []
    for p in tmp_path.iterdir():
        body, signature = json.loads(p.read_text())
        assert signature == "sha256=" + hmac.new(b"secret", body.encode(), hashlib.sha256).hexdigest()
        assert len(json.loads(body)) <= 10
        rows += [r["id"] for r in json.loads(body)]
    assert sorted(rows) == list(range(25))


def test_models(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "fail"), (3, None)], "id long, text string")
    got = {r["id"]: r for r in models.chat(df, F.concat(F.lit("say "), "text"), "answer", models.FakeProvider).collect()}
    assert got[1]["answer"].startswith("echo ") and got[2]["model_error"] == "no answer" and got[3]["answer"] is got[3]["model_error"] is None
    vec = models.embedding(df, F.col("text"), "vec", models.FakeProvider).where("id = 1").first()["vec"]
    assert len(vec) == 8
    ids = connectors.vector_rows(df.withColumn("v", F.array(F.lit(1.0))), "v").collect()
    assert len({r["id"] for r in ids}) == 3


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", 2)
    batch = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"), F.col("id").alias("timestamp"))
    log.publish("t", batch(0, 30), ["timestamp"])
    log.publish("t", batch(30, 50), ["timestamp"])
    rows = log.log("t").collect()
    for p in (0, 1):
        own = sorted((r["offset"], r["timestamp"]) for r in rows if r["partition"] == p)
        assert [o for o, _ in own] == list(range(len(own))) and own == sorted(own, key=lambda x: x[1])
    assert log.consume("t", 0, 3, 4).count() == 4 and sum(r["latest"] for r in log.bounds("t").collect()) == 50
