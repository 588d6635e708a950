"""Scans, sinks and formats."""

import tempfile
import uuid

from pyspark.sql import functions as F

from deltaloom.envelope import events_log, log_table, micros, table
from deltaloom.functions import predicates as P
from deltaloom.operators import offsets as O
from deltaloom.registry import query
from deltaloom.sources import datagen, formats, poll


def _folder(spark) -> str:
    """A new folder where all machines see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    return f"{base.rstrip('/')}/deltaloom/{uuid.uuid4().hex}"


for _kind in datagen.PATTERNS:
    query(name=f"s01_datagen_{_kind}")(lambda spark, sf_dir, kind=_kind: datagen.generate(spark, kind, 1000, seed=7))


@query()
def s02_datagen_cdc(spark, sf_dir):
    return datagen.change_events(spark, 1000, pool=50, seed=7)


@query("""select o_orderkey, o_totalprice from orders where o_orderstatus = 'O'""")
def s10_poll_bulk(spark, sf_dir):
    return poll.bulk(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], "o_orderstatus = 'O'")


@query("""select o_orderkey, o_custkey from orders where o_orderkey > 40 order by o_orderkey limit 300""")
def s11_poll_incrementing(spark, sf_dir):
    return poll.incrementing(table(spark, sf_dir, "orders"), "o_orderkey", 40, 300).select("o_orderkey", "o_custkey")


@query("""with m as (select max(ts) as m, min(ts) as a from events) select event_id from events, m where epoch_us(ts) > epoch_us(a) + 60000000 and epoch_us(ts) < epoch_us(m) - 3600000000 order by ts, event_id limit 500""")
def s12_poll_timestamp_delay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", micros("ts").alias("ts"))
    m = e.agg(F.min("ts").alias("a"), F.max("ts").alias("m")).first()
    return poll.timestamp(e, "ts", m["a"] + 60_000_000, 500, m["m"] - 3_600_000_000, ["event_id"]).select("event_id")


@query("""select o_orderkey, epoch_us(o_orderdate) as o_orderdate from orders where epoch_us(o_orderdate) > 820454400000000 or (epoch_us(o_orderdate) = 820454400000000 and o_orderkey > 30) order by o_orderdate, o_orderkey limit 400""")
def s13_poll_timestamp_incrementing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", micros("o_orderdate").alias("o_orderdate"))
    return poll.timestamp_incrementing(o, "o_orderdate", "o_orderkey", 820454400000000, 30, 400)


@query("""select o_orderstatus, count(*) as n from orders group by 1""")
def s14_poll_custom_query(spark, sf_dir):
    return poll.custom(spark, "select o_orderstatus, count(*) as n from {orders} group by 1", orders=table(spark, sf_dir, "orders"))


@query("""with {LOG} select "offset", event_id from lg where partition = 1 and "offset" >= 17 order by "offset" limit 250""")
def s17_partition_scan(spark, sf_dir):
    return O.read_from(log_table(spark, sf_dir), 1, 17, 250).select("offset", "event_id")


@query("""with {LOG} select partition, min("offset") as earliest, max("offset") + 1 as latest from lg group by 1""")
def s18_offset_bounds(spark, sf_dir):
    return O.bounds(log_table(spark, sf_dir))


@query("""with {LOG}, m as (select min(timestamp) + (max(timestamp) - min(timestamp)) // 2 as m from lg) select partition, min("offset") as "offset" from lg, m where timestamp >= m group by 1""")
def s19_offset_for_timestamp(spark, sf_dir):
    log = log_table(spark, sf_dir)
    m = log.agg((F.min("timestamp") + F.floor((F.max("timestamp") - F.min("timestamp")) / 2)).alias("m")).first()["m"]
    return O.offset_for_time(log, F.lit(m))


@query("""with n as (select 'snapshot' as phase, count(*) as n from customer union all select 'stream', count(*) from events),
m as (select * from (values ('always', true, true, true), ('initial', false, true, true), ('initial', true, false, true), ('initial_only', false, true, false), ('schema_only', false, false, true), ('when_needed', true, false, true), ('recovery', true, false, true), ('configuration_based', false, true, false)) t(mode, stored, reads, streams))
select mode, stored, phase, n from m, n where (phase = 'snapshot' and reads) or (phase = 'stream' and streams)""")
def s20_initial_snapshot(spark, sf_dir):
    """What each mode emits, at a first start and where a position is stored."""
    from deltaloom.envelope import customer_snapshot
    from deltaloom.operators.snapshot import start

    snap = customer_snapshot(spark, sf_dir).select(F.lit("snapshot").alias("phase"))
    stream, out = events_log(spark, sf_dir).select(F.lit("stream").alias("phase")), None
    for mode, stored in (("always", True), ("initial", False), ("initial", True), ("initial_only", False), ("schema_only", False), ("when_needed", True), ("recovery", True), ("configuration_based", False)):
        flags = {"start_stream": False} if mode == "configuration_based" else {}
        one = start(snap, stream, mode, stored, **flags).groupBy("phase").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), F.lit(stored).alias("stored"), "phase", "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("""select event_id, case when event_id % 4 <> 0 then 'delivered' when event_id % 3 = 0 then 'failed' else 'pending' end as status, case when event_id % 3 = 0 then 3 else 1 end as attempts from events""")
def s23_outbox_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, 2).otherwise(0).alias("attempts"))
    return poll.outbox_step(e, F.col("event_id") % 4 != 0, max_retries=3).select("event_id", "status", "attempts")


@query("""with e as (select event_id, epoch_us(ts) // 1000000 as s, event_id % 3 as attempts, case event_id % 5 when 0 then 'delivered' when 1 then 'processing' when 2 then 'processing' else 'pending' end as status, case when event_id % 5 = 1 then 0 else 1000 end as claimed_s from events),
c as (select * from e where status = 'pending' or (status = 'processing' and claimed_s + 60 <= 1000) order by s, event_id limit 500),
t as (select e.*, e.event_id in (select event_id from c) as mine from e), r as (select event_id, s, attempts + case when status = 'processing' or mine then 1 else 0 end as attempts,
  case when status = 'processing' or mine then case when event_id % 2 = 0 then 'delivered' when attempts + 1 < 3 then 'pending' else 'failed' end else status end as status, status = 'processing' or mine as tried from t), m as (select max(s) as m from e)
select 'table' as what, event_id, status, attempts from r, m where status <> 'delivered' or s + 86400 > m union all select 'dead', event_id, status, attempts from r where tried and status = 'failed'""")
def s23_outbox_round(spark, sf_dir):
    """Claims, one delivery, dead letters, and what is cleaned up after a day."""
    n = F.col("event_id") % 5
    e = table(spark, sf_dir, "events").select("event_id", F.floor(micros("ts") / 1_000_000).alias("created_s"), (F.col("event_id") % 3).alias("attempts"), F.when(n == 0, "delivered").when(n < 3, "processing").otherwise("pending").alias("status"), F.when(n == 1, 0).otherwise(1000).cast("long").alias("claimed_s"))
    claimed = poll.outbox_claim(e, 500, 1000, "w1").select("event_id", F.lit(True).alias("mine"))
    now = e.agg(F.max("created_s")).first()[0]
    held = e.join(claimed, "event_id", "left").withColumn("status", F.when(F.col("mine"), "processing").otherwise(F.col("status")))
    left, dead = poll.outbox_round(held, F.col("event_id") % 2 == 0, 3, now, 86_400)
    return left.select(F.lit("table").alias("what"), "event_id", "status", "attempts").unionAll(dead.select(F.lit("dead"), "event_id", "status", "attempts"))


@query("""with {EV} select event_id, op, ts_s // 86400 as day from ev""")
def k05_object_layout(spark, sf_dir):
    rows = events_log(spark, sf_dir).select(P.field("event_id").alias("event_id"), "op", "ts_s")
    path = _folder(spark)
    formats.write_objects(rows, path, "ts_s", by="day")
    return spark.read.parquet(path).select("event_id", "op", F.floor(F.col("ts_s") / 86400).alias("day"))


@query("""with {EV}, last as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from ev) select user_id, event_id from last where n = 1 and op <> 'd'
union all select c_custkey, cast(-1 as bigint) from customer where c_custkey not in (select user_id from ev)""")
def k10_merge_sink(spark, sf_dir):
    """All customers as the target: those with events are updated or deleted, the others stay, new users come."""
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("event_id"))
    return formats.merge(target, events_log(spark, sf_dir), "user_id", ["ts_s", "seq"])


@query("""select partition, "offset", event_id from (select user_id % 4 as partition, row_number() over (partition by user_id % 4 order by event_id) - 1 + 5 as "offset", event_id from events)""")
def k11_publish_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("partition"))
    ends = spark.createDataFrame([(p, 5) for p in range(4)], "partition long, latest long")
    return formats.publish(e, ends, ["event_id"]).select("partition", "offset", "event_id")


@query("""select c_custkey as k, case when c_custkey % 3 = 0 then 2 else 1 end as v from customer""")
def k12_sync_append_dedup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    old, new = c.withColumn("v", F.lit(1)).withColumn("at", F.lit(0)), c.where("k % 3 = 0").withColumn("v", F.lit(2)).withColumn("at", F.lit(1))
    return formats.sync(old, new, "append_dedup", ["k"], "at").select("k", "v")


@query("""select r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' as line from region""")
def fmt1_json_lines(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("line"))


@query("""select n_name, n_nationkey, n_regionkey from nation""")
def fmt2_csv_round_trip(spark, sf_dir):
    path = _folder(spark)
    formats.write_csv(table(spark, sf_dir, "nation"), path)
    return spark.read.csv(path, header=True, schema="n_name string, n_nationkey int, n_regionkey int", escape='"', multiLine=True)


@query("""select count(*) as n, round(sum(l_quantity), 2) as q from lineitem""")
def fmt4_parquet_round_trip(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "lineitem").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("""select r_regionkey, '000000002A' as head, r_name as payload from region""")
def fmt6_wire_format(spark, sf_dir):
    framed = table(spark, sf_dir, "region").select("r_regionkey", formats.schema_frame(F.col("r_name"), 42).alias("b"))
    back = formats.unframe(F.col("b"))
    return framed.select("r_regionkey", F.hex(F.substring("b", 1, 5)).alias("head"), back["payload"].cast("string").alias("payload"))
