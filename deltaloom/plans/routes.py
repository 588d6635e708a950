"""Routing, partitioning and naming."""

from pyspark.sql import functions as F

from deltaloom.envelope import events_log, log_table, table
from deltaloom.functions import predicates as P
from deltaloom.functions import scalar as S
from deltaloom.operators import routing as R
from deltaloom.registry import query


@query("""with {EV}, d as (select event_id, op, list_sort(list_distinct(list_concat(list_concat(case when op = 'd' then ['deletes', 'audit'] else cast([] as varchar[]) end, case when user_id % 2 = 0 then ['even'] else cast([] as varchar[]) end), case when user_id % 2 = 1 and event_type = 'click' then ['clicks'] else cast([] as varchar[]) end))) as l from ev)
select event_id, unnest(case when len(l) > 0 then l else ['dlq'] end) as destination from d""")
def r01_event_router(spark, sf_dir):
    rules = [
        R.Route(P.equals(F.col("op"), "d"), ["deletes", "audit"], 10, go_on=True),
        R.Route(P.field("user_id") % 2 == 0, ["even"], 5),
        R.Route(P.equals(P.field("event_type"), "click"), ["clicks"], 1),
    ]
    return R.route(events_log(spark, sf_dir), rules, dead_letter="dlq").select(P.field("event_id").alias("event_id"), F.explode("destinations").alias("destination"))


@query("""with {EV} select event_id, case when op <> 'd' then 'all-events' end as topic from ev""")
def r02_regex_router(spark, sf_dir):
    return R.regex_route(events_log(spark, sf_dir), [("(", "bad"), (r"^sales\.", "sales"), (r"events$", "all-events")], "other").select(P.field("event_id").alias("event_id"), F.col("__topic").alias("topic"))


@query("""with {EV} select event_id, case when event_type = 'click' then 'clicks' when regexp_matches(props, '[789]}') then 'late' when event_type in ('purchase', 'signup') then 'money' else 'rest' end as topic from ev where op <> 'd'""")
def r03_content_router(spark, sf_dir):
    rules = [(P.equals(P.field("event_type"), "click"), "clicks"), (P.matches(P.field("props"), "[789]}"), "late"), (P.one_of(P.field("event_type"), ["purchase", "signup"]), "money")]
    return R.content_route(events_log(spark, sf_dir), rules, "rest").where("after is not null").select("after.event_id", F.col("__routing_topic").alias("topic"))


@query("""select n_nationkey, 'cdc.' || lower(regexp_replace(n_name, '[^A-Za-z0-9._\\-]', '_', 'g')) as topic from nation""")
def r04_topic_resolver(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.concat(F.lit("cdc."), S.topic_name(S.normalize_identifier(F.col("n_name"), case="lower"))).alias("topic"))


@query("""with t as (select event_id, row_number() over (order by event_id) - 1 as n from events) select event_id, cast(n % 6 as integer) as rr, cast(n // 1000 % 6 as integer) as sticky from t""")
def r05_partition_strategies(spark, sf_dir):
    # event_id is dense from 0, so it is the arrival position: no window over the whole table
    e = table(spark, sf_dir, "events").select("event_id")
    first = F.col("event_id") - F.lit(e.agg(F.min("event_id")).first()[0])
    return e.select("event_id", R.round_robin(first, 6).alias("rr"), R.sticky(first, 6, 1000).alias("sticky"))


@query()
def r06_broker_partitioner(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keyed = S.murmur2_partition(F.col("user_id").cast("string"), 12)
    return e.groupBy(F.when(F.col("user_id") % 10 == 0, R.sticky(F.col("event_id"), 12)).otherwise(keyed).alias("partition")).agg(F.count("*").alias("n"))


@query("""select user_id % 4 as partition, count(*) as n, min(event_id) as first, max(event_id) as last from events group by 1""")
def r07_batch_partitioner(spark, sf_dir):
    return R.batch_groups(table(spark, sf_dir, "events"), F.col("user_id") % 4, F.col("event_id"))


@query("""with {LOG} select distinct 'log-' || partition || '-value' as topic, 'com.acme.Event' as record, 'log-' || partition || '-com.acme.Event' as topic_record from lg""")
def r08_subject_naming(spark, sf_dir):
    from deltaloom.sources.registry import subject

    t = F.concat(F.lit("log-"), F.col("partition").cast("string"))
    return log_table(spark, sf_dir).select("partition").distinct().select(subject("topic", t).alias("topic"), subject("record", t, F.lit("com.acme.Event")).alias("record"), subject("topic_record", t, F.lit("com.acme.Event")).alias("topic_record"))
