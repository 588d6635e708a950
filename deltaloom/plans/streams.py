"""Stateful and transactional operators."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.envelope import customer_snapshot, events_log, log_table, orders_log, table
from deltaloom.functions import predicates as P
from deltaloom.operators import batching as B
from deltaloom.operators import compaction as C
from deltaloom.operators import dedup as D
from deltaloom.operators import offsets as O
from deltaloom.operators import routing as R
from deltaloom.operators import snapshot as N
from deltaloom.operators import stats as A
from deltaloom.operators import transforms as X
from deltaloom.operators import txn as T
from deltaloom.registry import query


@query("""with recursive e as (select user_id, event_type, epoch_us(ts) // 1000000 as s, min(event_id) as event_id from events group by 1, 2, 3),
o as (select *, row_number() over (partition by user_id, event_type order by s) as n from e),
k as (select user_id, event_type, s, event_id, n, s as head from o where n = 1
  union all select o.user_id, o.event_type, o.s, o.event_id, o.n, case when o.s - k.head >= 36000 then o.s else k.head end from k join o on o.user_id = k.user_id and o.event_type = k.event_type and o.n = k.n + 1)
select event_id from k where s = head""")
def t01_deduplicate_within_ttl(spark, sf_dir):
    key = F.concat_ws(":", P.field("user_id"), P.field("event_type"))
    return D.first_within(events_log(spark, sf_dir), key, "ts_s", ["seq"], 36_000).select(P.field("event_id").alias("event_id"))


@query("""with {EV} select event_id, 'public:events:' || case when op = 'd' then '' else cast(user_id as varchar) end || ':' || op as faithful, 'public:events:' || user_id || ':' || op || ':' || event_id as safe, 'driver:events:' || ts_s as by_time from ev""")
def t02_dedup_keys(spark, sf_dir):
    return events_log(spark, sf_dir).select(P.field("event_id").alias("event_id"), D.event_key("faithful", pk="user_id").alias("faithful"), D.event_key("safe", pk="user_id").alias("safe"), D.event_key("table_time").alias("by_time"))


@query("""with {EV} select event_id, op, false as tombstone from ev union all select event_id, op, true from ev where op = 'd'""")
def t03_tombstones(spark, sf_dir):
    return C.emit_tombstones(events_log(spark, sf_dir), exclude=["sales.*"]).select(F.col("seq").alias("event_id"), "op", "tombstone")


@query("""select cast(event_id // 10 as varchar) as txn_id, count(*) as n_events, count(*) filter (where event_id % 10 = 9) > 0 as complete, min(event_id) as first_seq, max(event_id) as last_seq from events group by 1""")
def t04_transaction_grouper(spark, sf_dir):
    return T.group_transactions(events_log(spark, sf_dir, txn=True)).select("txn_id", "n_events", "complete", F.col("events")[0]["seq"].alias("first_seq"), F.element_at("events", -1)["seq"].alias("last_seq"))


@query("""with recursive e as (select event_id // 10 as t, event_id, row_number() over (partition by event_id // 10 order by event_id) as n, strlen(props) as size, event_id % 10 = 9 as is_last, epoch_us(ts) // 1000000 as s from events),
b as (select t, n, event_id, is_last, size as held, 1 as c, s as began, cast(0 as bigint) as part, case when size >= 100 then 'bytes' else 'end' end as why from e where n = 1
  union all select e.t, e.n, e.event_id, e.is_last, case when x.fresh then e.size else b.held + e.size end, case when x.fresh then 1 else b.c + 1 end, case when x.fresh then e.s else b.began end, case when x.fresh then b.part + 1 else b.part end,
    case when (case when x.fresh then 1 else b.c + 1 end) >= 4 then 'events' when (case when x.fresh then e.size else b.held + e.size end) >= 100 then 'bytes' else 'end' end
  from b join e on e.t = b.t and e.n = b.n + 1, lateral (select b.why <> 'end' or e.s - b.began >= 3600 as fresh) x),
p as (select t, part, count(*) as n_events, min(event_id) as first_seq, max(event_id) as last_seq, bool_or(is_last) as complete, arg_max(why, n) as why, max(n) as last_n from b group by 1, 2)
select cast(p.t as varchar) as txn_id, part, n_events, first_seq, last_seq, complete, case when complete then null when why <> 'end' then why when last_n < (select max(n) from e where e.t = p.t) then 'time' end as forced_by from p""")
def t04_forced_parts(spark, sf_dir):
    """Parts of at most 4 events, 100 bytes of props, or an hour."""
    log = events_log(spark, sf_dir, txn=True).withColumn("size", F.octet_length(P.field("props")))
    return B.forced_parts(log, max_events=4, max_bytes=100, size="size", timeout_s=3600)


@query("""with {EV}, t as (select event_id // 10 || ':' || upper(lpad(to_hex(event_id // 10), 8, '0')) as id, count(*) as n, min(ts_s) as a, max(ts_s) as b from ev group by event_id // 10)
select 'BEGIN' as status, id, a as ts_s, cast(null as bigint) as event_count, cast(null as varchar) as collections from t union all select 'END', id, b, n, '[{"collection":"public.events","n":' || n || '}]' from t""")
def t05_transaction_boundaries(spark, sf_dir):
    return T.boundaries(events_log(spark, sf_dir, txn=True))


@query("""with {LOG} select partition, "offset" from lg where not (producer_id = 2 and partition = 1 and "offset" between 5 and 900) and not (partition = 3 and "offset" >= 700)""")
def t06_read_committed(spark, sf_dir):
    aborted = spark.createDataFrame([(2, 1, 5, 900)], "producer_id long, partition int, first long, last long")
    still = spark.createDataFrame([(3, 700)], "partition int, first_open long")
    return T.committed_only(log_table(spark, sf_dir), aborted, still).select("partition", "offset")


@query("""with m as (select event_id // 3 as txn_id, event_id as seq, case event_id % 3 when 0 then 'begin' when 1 then case when event_id // 3 % 4 = 0 then 'prepare_abort' else 'prepare_commit' end else case when event_id // 3 % 4 = 0 then 'abort' else 'commit' end end as marker,
  case when event_id // 3 % 5 = 0 and event_id % 3 = 2 then 0 else 1 end as epoch from events), k as (select *, max(epoch) over (partition by txn_id order by seq rows between unbounded preceding and 1 preceding) as top from m),
l as (select txn_id, arg_max(marker, seq) as marker from k where top is null or epoch >= top group by 1)
select txn_id, case marker when 'commit' then 'complete_commit' when 'abort' then 'complete_abort' when 'begin' then 'ongoing' else marker end as state from l""")
def t07_transaction_outcomes(spark, sf_dir):
    """Every fifth transaction's end comes from a producer that has been fenced: it stays prepared."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("txn_id"), F.col("event_id").alias("seq"))
    end = F.when(F.col("txn_id") % 4 == 0, "abort").otherwise("commit")
    marker = F.when(F.col("seq") % 3 == 0, "begin").when(F.col("seq") % 3 == 1, F.concat(F.lit("prepare_"), end)).otherwise(end)
    epoch = F.when((F.col("txn_id") % 5 == 0) & (F.col("seq") % 3 == 2), 0).otherwise(1)
    return T.outcomes(e.withColumns({"marker": marker, "epoch": epoch}))


@query("""with {LOG}, r as (select producer_id, partition, "offset", "offset" // 300 - case when "offset" % 97 = 5 then 1 else 0 end as epoch, case when "offset" % 53 = 7 then "offset" % 300 - 1 when "offset" % 71 = 9 then "offset" % 300 + 5 else row_number() over (partition by producer_id, partition, "offset" // 300 order by "offset") - 1 end as sequence from lg),
k as (select *, max(struct_pack(e := epoch, s := sequence)) over (partition by producer_id, partition order by "offset" rows between unbounded preceding and 1 preceding) as l from r),
s as (select *, case when l is null then case when sequence = 0 then 'valid' else 'out_of_order' end when epoch < l.e then 'fenced' when epoch > l.e then case when sequence = 0 then 'reset' else 'out_of_order' end when sequence <= l.s then 'duplicate' when sequence = l.s + 1 then 'valid' else 'out_of_order' end as status from k)
select partition, "offset", status from s""")
def t08_idempotent_producer(spark, sf_dir):
    """Numbered records per producer, with epochs, repeats, gaps and stale epochs among them."""
    log, o = log_table(spark, sf_dir), F.col("offset")
    own = F.row_number().over(W.partitionBy("producer_id", "partition", F.floor(o / 300)).orderBy("offset")) - 1
    log = log.withColumns({"epoch": F.floor(o / 300) - F.when(o % 97 == 5, 1).otherwise(0), "sequence": F.when(o % 53 == 7, o % 300 - 1).when(o % 71 == 9, o % 300 + 5).otherwise(own)})
    return T.check_sequences(log).select("partition", "offset", "status")


@query("""with c as (select c_custkey, case when c_custkey <= 300 then 0 when c_custkey <= 900 then 1 when c_custkey <= 1200 then 2 else 3 end as chunk from customer), m as (select max(event_id) as m from events),
w as (select chunk, m * chunk // 4 as low, m * (chunk + 1) // 4 as high from m, (values (0), (1), (2), (3)) t(chunk))
select 'snapshot' as origin, c_custkey as k, high as position from c join w using (chunk) where not exists (select 1 from events where user_id = c_custkey and event_id between low and high)
union all select 'stream', event_id, event_id from events""")
def t09_incremental_snapshot(spark, sf_dir):
    """All of customer in four chunks, each read within a window of the stream; what the stream changed meanwhile goes."""
    log = events_log(spark, sf_dir)
    m = log.agg(F.max("seq")).first()[0]
    windows = spark.createDataFrame([(k, m * k // 4, m * (k + 1) // 4) for k in range(4)], "chunk int, low long, high long")
    stream = log.select(P.field("user_id").alias("c_custkey"), F.col("seq").alias("position"))
    kept = N.in_windows(table(spark, sf_dir, "customer").select("c_custkey"), stream, "c_custkey", N.chunk_of(F.col("c_custkey"), [300, 900, 1200]), windows)
    return kept.select(F.lit("snapshot").alias("origin"), F.col("c_custkey").alias("k"), "position").unionAll(log.select(F.lit("stream"), F.col("seq"), F.col("seq")))


@query("""select o_orderkey, case when o_orderkey <= 100 then 0 when o_orderkey <= 5000 then 1 when o_orderkey <= 9000 then 2 else 3 end as chunk from orders""")
def t09_chunk_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.chunk_of(F.col("o_orderkey"), [100, 5000, 9000]).alias("chunk"))


@query("""with recursive {LOG}, e as (select partition, "offset", "offset" + 1 as n, strlen(value) as size, timestamp // 1000 as ms, event_id // 10 as txn from lg),
b as (select partition, n, "offset", ms as began, size as held, 1 as c, txn, cast(0 as bigint) as batch, case when size >= 300 then 'bytes' else '' end as why from e where n = 1
  union all select e.partition, e.n, e."offset", case when x.fresh then e.ms else b.began end, case when x.fresh then e.size else b.held + e.size end, case when x.fresh then 1 else b.c + 1 end, e.txn, case when x.fresh then b.batch + 1 else b.batch end,
    case when (case when x.fresh then 1 else b.c + 1 end) >= 20 then 'events' when (case when x.fresh then e.size else b.held + e.size end) >= 300 then 'bytes' else '' end
  from b join e on e.partition = b.partition and e.n = b.n + 1, lateral (select b.why <> '' or (e.ms - b.began >= 7200000 and e.txn <> b.txn) as fresh) x)
select partition, batch, count(*) as n, min("offset") as first, max("offset") as last, case when arg_max(why, n) <> '' then arg_max(why, n) when max(n) = (select max(n) from e where e.partition = b.partition) then 'end' else 'time' end as flushed_by from b group by partition, batch""")
def t11_micro_batches(spark, sf_dir):
    """Batches of each partition: 20 events, 300 bytes, or two hours, but never by time within a transaction."""
    log = log_table(spark, sf_dir).withColumns({"size": F.octet_length("value"), "ms": F.floor(F.col("timestamp") / 1000), "txn": F.floor(F.col("event_id") / 10)})
    out = B.batches(log, ["partition"], ["offset"], 20, 300, 7_200_000, "size", "ms", "txn")
    return out.groupBy("partition", "batch").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.first("flushed_by").alias("flushed_by"))


@query("""with {EV} select ts_s // 3600 * 3600 as start_s, event_type, count(*) as n from ev group by 1, 2""")
def t14_tumbling_windows(spark, sf_dir):
    e = events_log(spark, sf_dir).select(F.timestamp_seconds("ts_s").alias("at"), P.field("event_type").alias("event_type"))
    return e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n")


@query("""with e as (select user_id, epoch_us(ts) as t, event_id from events), f as (select *, case when t - lag(t) over (partition by user_id order by t, event_id) < 1800000000 then 0 else 1 end as new from e),
s as (select *, sum(new) over (partition by user_id order by t, event_id rows unbounded preceding) as sid from f) select user_id, min(t) as start_us, count(*) as n from s group by user_id, sid""")
def t14_session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return e.groupBy("user_id", F.session_window("at", "30 minutes")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("""with s as (select n_nationkey, lower(n_name) as t, case n_nationkey % 4 when 0 then 'CREATE TABLE ' || n_name || ' (x int)' when 1 then 'ALTER TABLE ' || n_name || ' ADD y int' when 2 then 'DROP TABLE ' || n_name else 'TRUNCATE ' || n_name end as sql from nation)
select t as "table", sql, case n_nationkey % 4 when 0 then 'create' when 1 then 'alter' else 'drop' end as kind, 'db.schema_changes' as topic from s where n_nationkey % 4 <> 3 and not starts_with(t, 'i')""")
def t16_schema_changes(spark, sf_dir):
    from deltaloom.operators import schemas

    n = table(spark, sf_dir, "nation")
    shapes = F.array(*map(F.lit, ["CREATE TABLE {} (x int)", "ALTER TABLE {} ADD y int", "DROP TABLE {}", "TRUNCATE {}"]))
    sql = F.replace(F.element_at(shapes, (F.col("n_nationkey") % 4 + 1).cast("int")), F.lit("{}"), F.col("n_name"))
    changes = schemas.from_statements(n.select(F.lit("public").alias("schema"), F.lower("n_name").alias("table"), sql.alias("sql")))
    return schemas.published(changes, "db", exclude_tables=["public.i*"], exclude_kinds=["truncate"]).drop("schema")


COMMITS = """c as (select user_id % 3 as grp, user_id % 4 as partition, max(event_id) as committed from events group by 1, 2)"""


def _commits(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("string").alias("group_id"), F.lit("t").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("event_id").alias("seq"))


@query("with " + COMMITS + " select * from c")
def t19_committed_offsets(spark, sf_dir):
    return O.committed(_commits(spark, sf_dir)).select(F.col("group_id").cast("long").alias("grp"), F.col("partition").cast("long").alias("partition"), "committed")


@query("with {LOG}, b as (select partition, max(\"offset\") + 1 as latest from lg group by 1), " + COMMITS + """ select 'list' as what, cast(grp as varchar) as grp, cast(null as bigint) as partition, count(*) as n from c group by grp
union all select 'lag', '1', partition, latest - committed from c join b using (partition) where grp = 1
union all select 'left', cast(grp as varchar), partition, committed from c where grp <> 2
union all select 'reset', '0', partition, case partition when 0 then least(latest, 50) when 1 then least(latest, 50) else least(latest, 50) end from c join b using (partition) where grp = 0""")
def t19_group_administration(spark, sf_dir):
    """Groups listed; one described; one deleted; one reset to offset 50 or what is nearest to it."""
    commits, ends = _commits(spark, sf_dir), O.bounds(log_table(spark, sf_dir))
    p = F.col("partition").cast("long").alias("partition")
    out = O.list_groups(commits).select(F.lit("list").alias("what"), F.col("group_id").alias("grp"), F.lit(None).cast("long").alias("partition"), F.col("partitions").alias("n"))
    out = out.unionAll(O.describe_group(commits, ends, "1").select(F.lit("lag"), F.lit("1"), p, "lag"))
    out = out.unionAll(O.committed(O.delete_group(commits, "2")).select(F.lit("left"), "group_id", p, "committed"))
    return out.unionAll(O.committed(O.reset_group(commits, ends, "0", 50)).where("group_id = '0'").select(F.lit("reset"), "group_id", p, "committed"))


@query("""select p as partition, case when p < 4 then 'm0' when p < 7 then 'm1' else 'm2' end as by_range, 'm' || p % 3 as by_turn from range(10) t(p)""")
def t20_group_assignment(spark, sf_dir):
    a = spark.createDataFrame(O.assign_range(["m1", "m0", "m2"], {"t": 10}), "by_range string, topic string, partition long")
    b = spark.createDataFrame(O.assign_round_robin(["m1", "m0", "m2"], {"t": 10}), "by_turn string, topic string, partition long")
    return a.join(b, ["topic", "partition"]).select("partition", "by_range", "by_turn")


@query("""select event_id, 'bad value' as error from events where value < 1""")
def t23_dead_letters(spark, sf_dir):
    from deltaloom.sources.formats import dead_letters

    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 1, "bad value").alias("error"))
    return dead_letters(e)[1]


@query("""with e as (select event_id, props, event_id % 5 as failures, epoch_us(ts) // 1000000 as s, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as t_at from events)
select event_id, cast(least(failures + 1, 3) as integer) as tries, cast(case failures when 0 then 0 when 1 then 100 when 2 then 300 else 700 end as bigint) as waited_ms, failures >= 3 as dead,
  case when failures >= 3 then '{"original_topic":"events","connector_name":"driver","payload_b64":"' || to_base64(encode(props)) || '","error":"refused","retry_count":3,"timestamp":"' || t_at || '"}' end as envelope from e""")
def t23_retry_and_envelope(spark, sf_dir):
    """Three attempts, waits that double, and the dead-letter record of what failed each time."""
    from deltaloom.sources.formats import dead_letter_envelope, retried

    e = retried(table(spark, sf_dir, "events"), F.col("event_id") % 5)
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    envelope = dead_letter_envelope(F.lit("events"), "driver", F.col("props"), F.lit("refused"), F.col("tries"), at)
    return e.select("event_id", "tries", "waited_ms", "dead", F.when(F.col("dead"), envelope).alias("envelope"))


@query("""with {EV} select event_id, upper(event_type) as event_type, case when user_id % 2 = 0 then 'even' else 'odd' end as destination from ev where op <> 'd' and event_type <> 'view'""")
def t24_pipeline(spark, sf_dir):
    step = X.chain(lambda df: df.where(P.not_equals(P.field("event_type"), "view")), X.only_ops(["c", "u"]), X.compute(event_type=lambda c: F.upper(c["event_type"])))
    out = R.route(step(events_log(spark, sf_dir)), [R.Route(P.field("user_id") % 2 == 0, ["even"])], default="odd")
    return out.select("after.event_id", "after.event_type", F.element_at("destinations", 1).alias("destination"))


@query("""with {EV}, d as (select distinct on (user_id, op, ts_s) * from ev order by user_id, op, ts_s, event_id) select user_id, op, '***REDACTED***' as event_type, 0 as tomb from d union all select user_id, op, null, 1 from d where op = 'd'""")
def t25_feature_processor(spark, sf_dir):
    """De-duplicate, filter columns, transform, then tombstones: the order of the feature processor."""
    log = events_log(spark, sf_dir)
    once = D.first_within(log, F.concat_ws(":", P.field("user_id"), "op", "ts_s"), "ts_s", ["seq"], 1)
    masked = X.table_filter(mask_columns=["event_type"], drop_columns=["props"])(once)
    user = P.field("user_id")
    out = C.emit_tombstones(masked.withColumn("who", user))
    return out.select(F.col("who").alias("user_id"), "op", P.field("event_type").alias("event_type"), F.col("tombstone").cast("int").alias("tomb"))
