"""Extensions beyond the change-event operators: joins and event-time windows."""

from pyspark.sql import functions as F

from deltaloom.envelope import micros, table
from deltaloom.operators import joins
from deltaloom.registry import query


@query("""with c as (select user_id, epoch_us(ts) as t, event_id from events where event_type = 'purchase'), v as (select user_id, epoch_us(ts) as vt, event_id as view_id from events where event_type = 'view')
select c.event_id, v.view_id from c asof left join v on c.user_id = v.user_id and c.t >= v.vt""")
def e01_asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", micros("ts").alias("t"), "event_id")
    right = e.where("event_type = 'view'").select("user_id", micros("ts").alias("vt"), F.col("event_id").alias("view_id"))
    return joins.asof_join(left, right, "user_id", "t", "vt", ["view_id"]).select("event_id", "view_id")


@query("""select a.event_id, b.event_id as next_id from events a join events b on a.user_id = b.user_id and b.event_type = 'purchase' and a.event_type = 'click' and epoch_us(b.ts) between epoch_us(a.ts) and epoch_us(a.ts) + 3600000000""")
def e02_interval_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("t"), "event_id", "event_type")
    a = e.where("event_type = 'click'").drop("event_type")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("bt"), F.col("event_id").alias("next_id"))
    return joins.interval_join(a, b, "user_id", "t", "bt", 3_600_000_000).select("event_id", "next_id")


@query("""with e as (select epoch_us(ts) // 1000000 as s, event_type from events), w as (select s // 900 * 900 - k * 900 as start_s, event_type from e, range(4) r(k)) select start_s, event_type, count(*) as n from w group by 1, 2""")
def e03_sliding_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    return e.groupBy(F.window("at", "1 hour", "15 minutes"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n")


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as q, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)""")
def e04_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
