"""Filters and predicates."""

from pyspark.sql import functions as F

from deltaloom.envelope import events_log, log_table, orders_log, table
from deltaloom.functions import predicates as P
from deltaloom.operators import compaction as C
from deltaloom.operators import transforms as X
from deltaloom.registry import query


@query("""with {EV} select event_id, op from ev where event_type in ('click', 'error') and not (user_id = 7)""")
def f01_filter_keep_drop(spark, sf_dir):
    keep = P.one_of(P.field("event_type"), ["click", "error"])
    drop = P.equals(P.field("user_id"), 7)
    return events_log(spark, sf_dir).where(keep).where(P.negate(drop)).select(P.field("event_id").alias("event_id"), "op")


@query("""with {EV} select event_id, coalesce(event_type = 'view', false) as eq, coalesce(event_type <> 'view', true) as ne, event_type is null as nul, event_type is not null as has, regexp_matches(props, '[0-4]}$') as fits, event_type in ('view', 'click') as member from ev""")
def f02_f05_comparisons(spark, sf_dir):
    e, p = P.field("event_type"), P.field("props")
    return events_log(spark, sf_dir).select(P.field("event_id").alias("event_id"), P.equals(e, "view").alias("eq"), P.not_equals(e, "view").alias("ne"), P.is_null(e).alias("nul"), P.is_not_null(e).alias("has"), P.matches(p, "[0-4]}$").alias("fits"), P.one_of(e, ["view", "click"]).alias("member"))


@query("""with t as (select l_orderkey, case when l_discount > 0.05 then l_returnflag end as flag from lineitem)
select count(*) filter (where coalesce(flag = 'R', false)) as eq, count(*) filter (where coalesce(flag <> 'R', true)) as ne, count(*) filter (where flag is null) as nul, count(*) filter (where not coalesce(flag in ('A', 'N'), false)) as not_in from t""")
def f02_missing_fields_are_two_valued(spark, sf_dir):
    flag = F.when(F.col("l_discount") > 0.05, F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(flag.alias("flag")).agg(F.count_if(P.equals(F.col("flag"), "R")).alias("eq"), F.count_if(P.not_equals(F.col("flag"), "R")).alias("ne"), F.count_if(P.is_null(F.col("flag"))).alias("nul"), F.count_if(P.negate(P.one_of(F.col("flag"), ["A", "N"]))).alias("not_in"))


@query("""with {EV} select event_id from ev where (event_type = 'click' or value > 50) and not (user_id % 2 = 0)""")
def f06_and_or_not(spark, sf_dir):
    p = P.all_of(P.any_of(P.equals(P.field("event_type"), "click"), P.field("value") > 50), P.negate(P.field("user_id") % 2 == 0))
    return events_log(spark, sf_dir).where(p).select(P.field("event_id").alias("event_id"))


@query("""with {EV} select event_id from ev where event_type in ('click', 'view') and cast(user_id as varchar) <> '3' and regexp_matches(props, '5')""")
def f07_text_grammar(spark, sf_dir):
    out = events_log(spark, sf_dir)
    for text in ("event_type in [click, view]", "user_id != 3", "props matches 5", "value is_not_null"):
        out = out.where(P.parse(text))
    return out.select(P.field("event_id").alias("event_id"))


@query("""with {EV} select event_id, case when op in ('c', 'u') and user_id % 2 = 1 then upper(event_type) else event_type end as event_type from ev where op <> 'd'""")
def f08_conditional_transform(spark, sf_dir):
    condition = P.all_of(P.when_event(table="^ev", ops=["c", "u"], field_exists="user_id"), P.field("user_id") % 2 == 1)
    step = X.apply_when(condition, lambda c, k: c | {"event_type": F.upper(c["event_type"])})
    return step(events_log(spark, sf_dir)).where("after is not null").select("after.event_id", "after.event_type")


@query("""with {EV} select event_id from ev where not (op = 'u' and event_type = 'click')""")
def f09_predicate_config(spark, sf_dir):
    return events_log(spark, sf_dir).where(P.when_event(schema="public", ops=["u"], field_equals=("event_type", "click"), negated=True)).select(P.field("event_id").alias("event_id"))


@query("""select c_custkey, lower(c_mktsegment) like 'b%' as starts, lower(c_mktsegment) like '%i_g' as one, lower('sales.' || c_mktsegment) like 'sales.a%' as qualified from customer""")
def f10_globs(spark, sf_dir):
    c = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", P.glob_match(c, "b*").alias("starts"), P.glob_match(c, "*i?g").alias("one"), P.table_match(["sales.A*"], F.lit("sales"), c).alias("qualified"))


@query("""with {ORD} select o_orderkey, true as always, true as pre, false as suf, op in ('c', 'd') as ops, coalesce(o_orderpriority = '1-URGENT', false) as eq from od""")
def f11_route_conditions(spark, sf_dir):
    return orders_log(spark, sf_dir).select(P.field("o_orderkey").alias("o_orderkey"), F.lit(True).alias("always"), P.affix_match(F.col("table"), "ord*").alias("pre"), P.affix_match(F.col("table"), "*items").alias("suf"), P.one_of(F.col("op"), ["c", "d"]).alias("ops"), P.equals(P.field("o_orderpriority"), "1-URGENT").alias("eq"))


@query("""select p_partkey, contains(p_type, 'A') as has, starts_with(p_name, 'p') as pre, ends_with(p_brand, '1') as suf from part""")
def f12_connector_predicates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.contains(F.col("p_type"), "A").alias("has"), P.starts_with(F.col("p_name"), "p").alias("pre"), P.ends_with(F.col("p_brand"), "1").alias("suf"))


@query("""with {LOG} select partition, "offset" from lg where "offset" >= 10 * partition""")
def f14_truncate_before(spark, sf_dir):
    from deltaloom.operators.offsets import truncate_before

    marks = spark.createDataFrame([(p, 10 * p) for p in range(4)], "partition int, low_watermark long")
    return truncate_before(log_table(spark, sf_dir), marks).select("partition", "offset")


@query("""with {LOG}, t as (select *, sum(strlen(value)) over (partition by partition order by "offset" desc) as run from lg) select partition, "offset" from t where run <= 5000""")
def f15_retention(spark, sf_dir):
    return C.retain(log_table(spark, sf_dir), bytes_kept=5000).select("partition", "offset")


@query("""with {EV} select count(*) as n, count(*) filter (where op in ('u', 'd')) as needs_before from ev""")
def f16_replica_identity(spark, sf_dir):
    from deltaloom.sources.replica import check

    out = check(events_log(spark, sf_dir), {"events": "d"}, minimum="full", mode="warn")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("identity_warning") & F.col("op").isin("u", "d")).alias("needs_before"))


# joins


@query("""with {EV}, stream as (select user_id, op, ts_s from ev), w as (select min(ts_s) + (max(ts_s) - min(ts_s)) * 9 // 10 as m from ev)
select c_custkey from customer where not exists (select 1 from stream, w where stream.user_id = c_custkey and (op = 'd' or ts_s >= m))""")
def j01_snapshot_reconcile(spark, sf_dir):
    from deltaloom.operators.snapshot import reconcile

    log = events_log(spark, sf_dir)
    w = log.agg((F.min("ts_s") + F.floor((F.max("ts_s") - F.min("ts_s")) * 9 / 10)).alias("m")).first()["m"]
    stream = log.select(P.field("user_id").alias("c_custkey"), "op", F.col("ts_s").alias("event_ts"))
    return reconcile(table(spark, sf_dir, "customer").select("c_custkey"), stream, "c_custkey", w)


@query("""with {LOG} select partition, "offset" from lg where not (producer_id = 1 and "offset" between 10 and 20) and not (producer_id = 3 and "offset" between 100 and 400)""")
def j02_aborted_ranges(spark, sf_dir):
    from deltaloom.operators.txn import committed_only

    aborted = spark.createDataFrame([(1, 10, 20), (3, 100, 400)], "producer_id long, first long, last long")
    return committed_only(log_table(spark, sf_dir), aborted).select("partition", "offset")


@query("""select c_custkey, case when max(event_id) is not null then 'event' else 'snapshot' end as choice, max(event_id) as xid from customer left join events on user_id = c_custkey and event_id between 100 and 400 group by c_custkey""")
def j03_read_only_window(spark, sf_dir):
    from deltaloom.operators.snapshot import read_only_choice

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("xid"))
    return read_only_choice(events, table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100, 400).select("c_custkey", "choice", "xid")


@query("""with {EV}, last as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from ev)
select 'public:events:' || user_id as k, event_id from last where n = 1 and op <> 'd' and starts_with('public:events:' || user_id, 'public:events:1')""")
def j04_lookup_by_prefix(spark, sf_dir):
    key = C.key_of(["user_id"])
    return C.latest(events_log(spark, sf_dir), key, ["ts_s", "seq"]).where(F.col("_key").startswith("public:events:1")).select(F.col("_key").alias("k"), P.field("event_id").alias("event_id"))


@query("""with v as (select n_nationkey as id, n_regionkey as ref from nation), r as (select r_regionkey as id from region) select r.id as referenced, count(v.id) as referencing from r left join v on v.ref = r.id group by r.id""")
def j05_reference_resolution(spark, sf_dir):
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("vid"), F.col("n_regionkey").alias("referenced"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("referenced"))
    return r.join(v, "referenced", "left").groupBy("referenced").agg(F.count("vid").alias("referencing"))
