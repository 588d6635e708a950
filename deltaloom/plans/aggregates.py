"""Aggregations, windows, sorts and set operations."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.envelope import customer_snapshot, events_log, log_table, micros, orders_log, table
from deltaloom.functions import predicates as P
from deltaloom.operators import compaction as C
from deltaloom.operators import offsets as O
from deltaloom.operators import routing as R
from deltaloom.operators import schemas, sketches
from deltaloom.operators import stats as A
from deltaloom.operators import txn as T
from deltaloom.registry import query

LAST = """last as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from ev)"""


@query("with {EV}, " + LAST + " select user_id, event_id, event_type from last where n = 1 and op <> 'd'")
def a01_latest_per_key(spark, sf_dir):
    return C.latest(events_log(spark, sf_dir), P.field("user_id"), ["ts_s", "seq"]).select("after.user_id", "after.event_id", "after.event_type")


@query("with {EV}, " + LAST + " select user_id, event_id, op from last where n = 1")
def a02_compactor_with_tombstones(spark, sf_dir):
    return C.latest(events_log(spark, sf_dir), P.field("user_id"), ["ts_s", "seq"], keep_deletes=True).select(P.field("user_id").alias("user_id"), P.field("event_id").alias("event_id"), "op")


@query("""with {EV}, k as (select user_id, count(*) as n from ev group by 1) select cast(sum(n) as bigint) as total, cast(sum(n - 1) as bigint) as dirty, sum(n - 1) >= 0.5 * sum(n) or sum(n) >= 1000000 as due from k""")
def a03_needs_compaction(spark, sf_dir):
    return C.needs_compaction(events_log(spark, sf_dir), P.field("user_id"))


@query("""with {EV}, m as (select max(ts_s) as m from ev) select event_id, op from ev, m where not (op = 'd' and ts_s < m - 86400)""")
def a04_tombstone_expiry(spark, sf_dir):
    log = events_log(spark, sf_dir)
    now = log.agg(F.max("ts_s").alias("m")).first()["m"]
    return C.expire_tombstones(log, now).select(P.field("event_id").alias("event_id"), "op")


@query("with {EV}, " + LAST + " select user_id, event_id from last where n = 1 and op <> 'd'")
def a05_segmented_compaction(spark, sf_dir):
    return C.segment_and_merge(events_log(spark, sf_dir), P.field("user_id"), ["ts_s", "seq"], F.floor(F.col("seq") / 2000)).select("after.user_id", "after.event_id")


@query("""with {LOG}, top as (select partition, key, max("offset") as o from lg where "offset" < 1000 group by 1, 2)
select lg.partition, lg."offset", lg.key from lg left join top on top.partition = lg.partition and top.key = lg.key and top.o = lg."offset"
where lg."offset" >= 1000 or (top.o is not null and strlen(lg.value) > 0)""")
def a06_log_compaction(spark, sf_dir):
    return C.compact_log(log_table(spark, sf_dir), 1000).select("partition", "offset", "key")


@query("""with {EV} select event_id, 'public:events:' || user_id || ':' || event_type as k from ev""")
def a07_key_strategies(spark, sf_dir):
    return events_log(spark, sf_dir).select(P.field("event_id").alias("event_id"), C.key_of(["user_id", "event_type"]).alias("k"))


@query("""with {EV} select count(*) filter (where op = 'c') as n_c, count(*) filter (where op = 'u') as n_u, count(*) filter (where op = 'd') as n_d, 0 as n_r, 0 as n_t, 0 as n_s, count(*) as total from ev""")
def a08_op_counts(spark, sf_dir):
    return A.op_counts(events_log(spark, sf_dir))


@query("""with {EV}, {ORD}, a as (select 'public' as schema, 'events' as "table", ts_s from ev union all select 'sales', 'orders', ts_s from od) select schema, "table", count(*) as n, min(ts_s) as first_s, max(ts_s) as last_s from a group by 1, 2""")
def a09_events_by_table(spark, sf_dir):
    cols = ["schema", "table", "ts_s"]
    return A.by_table(events_log(spark, sf_dir).select(cols).unionAll(orders_log(spark, sf_dir).select(cols)))


@query("""select cast(event_id // 10 as varchar) as txn_id, count(*) as event_count, 'public.events' as collection, count(*) as n from events group by 1""")
def a10_collection_counts(spark, sf_dir):
    t = events_log(spark, sf_dir, txn=True)
    per = t.groupBy(F.col("txn.id").alias("txn_id"), F.concat_ws(".", "schema", "table").alias("collection")).agg(F.count("*").alias("n"))
    return per.groupBy("txn_id").agg(F.sum("n").alias("event_count"), F.array_sort(F.collect_list(F.struct("collection", "n"))).alias("c")).select("txn_id", "event_count", F.explode("c").alias("c")).select("txn_id", "event_count", "c.*")


@query("""select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1) // 3 as chunk from conversations""")
def a11_chunks(spark, sf_dir):
    return A.chunks(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 3)


REGISTERS = """select cast('0x' || substr(md5(cast({key} as varchar)), 1, 3) as bigint) as register, max(case when x = 0 then 53 else 53 - length(bin(x)) end) as rank
  from (select *, cast('0x' || substr(md5(cast({key} as varchar)), 4, 13) as bigint) as x from lineitem) group by 1"""
ESTIMATE = """select cast(round(case when raw <= 2.5 * 4096 and n < 4096 then 4096 * ln(4096.0 / (4096 - n)) else raw end) as bigint) as estimate
  from (select count(*) as n, 0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / (sum(power(2.0, -rank)) + 4096 - count(*)) as raw from r)"""


@query("with r as (" + REGISTERS.format(key="l_orderkey") + ") select estimate, abs(estimate - n) <= 0.05 * n as close from (" + ESTIMATE + "), (select count(distinct l_orderkey) as n from lineitem)")
def a12_hyperloglog(spark, sf_dir):
    """The estimate of registers that any engine can build, and whether it lies within three standard errors of the count."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey")
    n = keys.distinct().count()
    return sketches.cardinality(sketches.registers(keys, F.col("l_orderkey"))).select("estimate", (F.abs(F.col("estimate") - n) <= 0.05 * n).alias("close"))


def _places(rows: str, bits: int, hashes: int) -> str:
    """SQL for the distinct (k, place) of rows with a text column k."""
    return f"select distinct k, (cast('0x' || substr(md5(k), 1, 15) as bigint) % {bits} + i * ((cast('0x' || substr(md5(k), 16, 15) as bigint) | 1) % {bits})) % {bits} as place from {rows}, range({hashes}) t(i)"


BLOOM = sketches.shape(200_000, 0.01)


@query(f"""with k as (select distinct cast(o_custkey as varchar) as k from orders), f as (select distinct place from ({_places("k", *BLOOM)})),
probe as (select k, true as real from k union all select 'x' || o_orderkey, false from orders),
got as (select k, bool_and(place in (select place from f)) as hit from ({_places("probe", *BLOOM)}) group by k)
select (select count(*) from f) as bits_set, count(*) filter (where real) as present, count(*) filter (where real and not hit) as lost, count(*) filter (where not real and hit) as false_positives from probe join got using (k)""")
def a13_bloom_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    bloom = sketches.bloom(orders, F.col("o_custkey"), 200_000, 0.01)
    probe = orders.select(F.col("o_custkey").cast("string").alias("k"), F.lit(True).alias("real")).distinct().unionAll(orders.select(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")), F.lit(False)))
    hit = sketches.might_contain(probe, "k", bloom)
    set_ = bloom.words.agg(F.sum(F.bit_count("bits")).alias("bits_set"))
    return hit.agg(F.count_if("real").alias("present"), F.count_if(F.col("real") & ~F.col("might_contain")).alias("lost"), F.count_if(~F.col("real") & F.col("might_contain")).alias("false_positives")).select(set_.scalar().alias("bits_set"), "*")


COUNTING, OFFSETS = sketches.shape(50_000, 0.01), sketches.shape(60_000, 0.01)


@query(f"""with s as (select cast(o_custkey as varchar) as k, case when o_orderstatus = 'F' then -1 else 1 end as s from orders),
p as ({_places("(select distinct k from s)", *COUNTING)}), n as (select place, greatest(sum(s), 0) as n from s join p using (k) group by 1),
got as (select k, bool_and(coalesce(n, 0) > 0) as held from p left join n using (place) group by k)
select count(*) as keys, count(*) filter (where held) as held, (select count(*) from n where n > 0) as places, (select cast(sum(n) as bigint) from n) as counted from got""")
def a14_counting_filter(spark, sf_dir):
    """Orders add their customer, finished ones remove one again: which customers are held after that."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("s"))
    counters = sketches.counting(o, F.col("k"), 50_000, 0.01, F.col("s"))
    held = sketches.counted(o.select("k").distinct(), "k", counters, 50_000, 0.01)
    sums = counters.agg(F.count("*").alias("places"), F.sum("n").alias("counted"))
    return held.agg(F.count("*").alias("keys"), F.count_if("might_contain").alias("held")).select("keys", "held", sums.select("places").scalar().alias("places"), sums.select("counted").scalar().alias("counted"))


@query(f"""with o as (select cast(o_orderkey as bigint) as o from orders where o_orderkey % 7 <> 0 or o_orderkey % 1000 > 500), r as (select o_orderkey as a, o_orderkey + case when o_orderkey % 2 = 0 then 3 else 2500 end as b from orders),
f as (select distinct place from ({_places("(select cast(o as varchar) as k from o)", *OFFSETS)})), g as (select distinct place from ({_places("(select distinct cast(o // 1000 as varchar) as k from o)", *sketches.shape(60, 0.01))})),
m as (select min(o) as lo, max(o) as hi from o), c as (select a, b, greatest(a, lo) as a2, least(b, hi) as b2 from r, m),
few as (select distinct a, cast(x as varchar) as k from c, unnest(range(a2, b2 + 1)) t(x) where b - a <= 10), many as (select distinct a, cast(x as varchar) as k from c, unnest(range(a2 // 1000, b2 // 1000 + 1)) t(x) where b - a > 10 and a2 <= b2),
fk as (select k, bool_and(place in (select place from f)) as hit from ({_places("(select distinct k from few)", *OFFSETS)}) group by k), gk as (select k, bool_and(place in (select place from g)) as hit from ({_places("(select distinct k from many)", *sketches.shape(60, 0.01))}) group by k),
hits as (select a, bool_or(hit) as hit from few join fk using (k) group by a union all select a, bool_or(hit) from many join gk using (k) group by a)
select a, b, coalesce(hit, false) as might_contain from r left join hits using (a)""")
def a14_offset_ranges(spark, sf_dir):
    """Which ranges of offsets may hold one that was added: short ones offset by offset, long ones by buckets of 1,000."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    sketch = sketches.offset_bloom(o.where("o_orderkey % 7 <> 0 or o_orderkey % 1000 > 500"), "o_orderkey", 60_000)
    ranges = o.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 3).otherwise(2500)).alias("b"))
    return sketches.might_hold_range(ranges, "a", "b", sketch)


@query("""with s as (select event_type, list_sort(list(value)) as v from events group by 1)
select event_type, v[least(len(v) * 50 // 100, len(v) - 1) + 1] as p50, v[least(len(v) * 95 // 100, len(v) - 1) + 1] as p95, v[least(len(v) * 99 // 100, len(v) - 1) + 1] as p99, v[len(v)] as largest from s""")
def a15_latency_percentiles(spark, sf_dir):
    return A.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("""with {EV} select ts_s // 600 * 600 as start_s, count(*) as n, count(*) / 600 as per_second from ev group by 1""")
def a16_windowed_rate(spark, sf_dir):
    return A.rate(events_log(spark, sf_dir), "ts_s", 600)


@query("""with {EV} select count(*) as processed, count(*) filter (where event_type = 'view') as filtered, count(*) filter (where value < 1) as dlq from ev""")
def a17_processing_statistics(spark, sf_dir):
    return events_log(spark, sf_dir).agg(F.count("*").alias("processed"), F.count_if(P.field("event_type") == "view").alias("filtered"), F.count_if(P.field("value") < 1).alias("dlq"))


@query("""with c as (select user_id % 8 as partition, count(*) as n from events group by 1) select partition, n, 100.0 * n / sum(n) over () as percent, stddev_pop(n) over () as deviation, max(abs(n - (select avg(n) from c))) over () <= (select avg(n) from c) * 20 / 100 as balanced from c""")
def a18_partition_distribution(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("partition"))
    return R.distribution(e, "partition", 8)


@query("""with {LOG}, b as (select partition, max("offset") + 1 as latest from lg group by 1) select partition, latest, case when partition = 3 then 0 else 100 * partition end as committed, latest - case when partition = 3 then 0 else 100 * partition end as lag from b""")
def a19_consumer_lag(spark, sf_dir):
    commits = spark.createDataFrame([("g", "t", p, o, s) for s, (p, o) in enumerate([(0, 5), (1, 7), (0, 0), (1, 100), (2, 200)])], "group_id string, topic string, partition int, offset long, seq long")
    return O.lag(O.bounds(log_table(spark, sf_dir)), O.committed(commits).select("partition", "committed"))


# windows


@query("""with {LOG} select event_id, partition, "offset" from lg""")
def w01_dense_offsets(spark, sf_dir):
    return log_table(spark, sf_dir).select("event_id", "partition", "offset")


@query("""with {EV} select event_id, row_number() over (partition by event_id // 10 order by event_id) as total_order, row_number() over (partition by event_id // 10 order by event_id) as collection_order from ev""")
def w02_transaction_orders(spark, sf_dir):
    return T.transaction_orders(events_log(spark, sf_dir, txn=True)).select(P.field("event_id").alias("event_id"), "total_order", "collection_order")


@query("""select event_id, event_id = min(event_id) over (partition by event_id // 10) as is_first, event_id % 10 = 9 as is_last, count(*) over (partition by event_id // 10) = 1 as single from events""")
def w03_first_last_of_transaction(spark, sf_dir):
    return T.first_last(events_log(spark, sf_dir, txn=True)).select(P.field("event_id").alias("event_id"), "is_first", "is_last", "single")


@query("""with {LOG}, s as (select *, case when "offset" % 7 = 3 then 5 else "offset" % 11 end as sequence, "offset" // 500 as epoch from lg),
t as (select *, lag(sequence) over (partition by producer_id, partition, epoch order by "offset") as prev from s)
select partition, producer_id, count(*) filter (where prev is null) as firsts, count(*) filter (where sequence = prev + 1) as nexts, count(*) filter (where sequence <= prev) as repeats, count(*) filter (where sequence > prev + 1) as gaps from t group by 1, 2""")
def w04_expected_sequence(spark, sf_dir):
    s = log_table(spark, sf_dir).withColumns({"sequence": F.when(F.col("offset") % 7 == 3, 5).otherwise(F.col("offset") % 11), "epoch": F.floor(F.col("offset") / 500)})
    t = T.sequence_steps(s)
    return t.groupBy("partition", "producer_id").agg(*(F.count_if(F.col("step") == k).alias(f"{k}s") for k in ("first", "next", "repeat", "gap")))


@query("""select n_name as "table", v as version, case v when 1 then 'create' else 'alter' end as kind,
  case v when 1 then ['a', 'b'] when 2 then ['c'] else cast([] as varchar[]) end as added, case v when 2 then ['b'] when 3 then ['a'] else cast([] as varchar[]) end as removed,
  case v when 2 then ['a'] when 3 then cast([] as varchar[]) when 5 then ['c'] else cast([] as varchar[]) end as modified from nation, (values (1), (2), (3), (5)) t(v)""")
def w05_column_diff(spark, sf_dir):
    """Versions of each nation's columns; the fourth is equal to the third and no change."""
    v = [(1, [("a", "int"), ("b", "text")]), (2, [("a", "long"), ("c", "text")]), (3, [("c", "text")]), (4, [("c", "text")]), (5, [("c", "int")])]
    cols = F.explode(F.array(*(F.struct(F.lit(k).alias("version"), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in c)).alias("cols")) for k, c in v)))
    versions = table(spark, sf_dir, "nation").select(F.lit("public").alias("schema"), F.col("n_name").alias("table"), cols.alias("v")).select("schema", "table", "v.*")
    return schemas.from_versions(versions).drop("schema")


# sorts and limits


@query("""select o_orderkey, o_totalprice from orders where o_orderkey > 100 order by o_orderkey limit 500""")
def l01_cursor_order_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey > 100").orderBy("o_orderkey").limit(500).select("o_orderkey", "o_totalprice")


@query("""select o_orderkey from orders order by o_orderkey limit 50 offset 70""")
def l02_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").offset(70).limit(50)


@query("""with {LOG} select "offset", event_id from lg where partition = 2 and "offset" >= 40 order by "offset" limit 10000""")
def l03_read_cap(spark, sf_dir):
    return O.read_from(log_table(spark, sf_dir), 2, 40, 1_000_000).select("offset", "event_id")


@query("""with {EV} select event_id, case when user_id % 5 = 0 then 'fifth' when event_type = 'click' then 'click' else 'rest' end as rule from ev""")
def l04_rules_by_priority(spark, sf_dir):
    rules = [R.Route(F.lit(True), ["rest"], 0), R.Route(P.equals(P.field("event_type"), "click"), ["click"], 5), R.Route(P.field("user_id") % 5 == 0, ["fifth"], 9)]
    return R.route(events_log(spark, sf_dir), rules).select(P.field("event_id").alias("event_id"), F.element_at("destinations", 1).alias("rule"))


@query("""select p_partkey from part where p_partkey >= 15 and p_partkey < 400 order by p_partkey limit 100""")
def l05_ordered_range_scan(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey >= 15 and p_partkey < 400").select("p_partkey").orderBy("p_partkey").limit(100)


@query("""select n_name, n_nationkey, n_regionkey from nation""")
def l06_sorted_fields(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(sorted(n.columns))


# set operations


@query("""with {EV} select 'r' as op, c_custkey as k from customer union all select op, event_id from ev""")
def u01_snapshot_then_stream(spark, sf_dir):
    from deltaloom.operators.snapshot import snapshot_then_stream

    snap = customer_snapshot(spark, sf_dir).select("op", P.field("c_custkey").alias("k"))
    return snapshot_then_stream(snap, events_log(spark, sf_dir).select("op", P.field("event_id").alias("k")))


@query("""with {EV}, {ORD} select 'events' as topic, event_id as k from ev union all select 'orders', o_orderkey from od""")
def u02_several_topics(spark, sf_dir):
    a = events_log(spark, sf_dir).select(F.col("table").alias("topic"), P.field("event_id").alias("k"))
    b = orders_log(spark, sf_dir).select(F.col("table").alias("topic"), P.field("o_orderkey").alias("k"))
    c = customer_snapshot(spark, sf_dir).select(F.col("table").alias("topic"), P.field("c_custkey").alias("k"))
    return a.unionByName(b).unionByName(c).where(F.col("topic").isin("events", "orders"))


@query("with r as (" + REGISTERS.format(key="l_partkey") + ") select register, rank from r")
def u03_sketch_merge(spark, sf_dir):
    """Registers of each return flag, merged: those of the whole table."""
    return sketches.merge_registers(sketches.registers(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), by=["l_returnflag"]))


@query("""select c_custkey as k, case when c_custkey % 2 = 0 then 'right' else 'left' end as v from customer union all select -1, 'right'""")
def u04_state_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    right = c.where("k % 2 = 0").unionAll(spark.range(1).select(F.lit(-1).cast("long"))).select("k", F.lit("right").alias("v"))
    return C.merge_state(c.select("k", F.lit("left").alias("v")), right, "k")


@query("""select n_name, case when n_regionkey > 1 then ['n_extra'] else cast([] as varchar[]) end as added, case when n_regionkey = 0 then ['n_name'] else cast([] as varchar[]) end as removed,
  case when n_regionkey = 0 then ['n_key'] else ['n_key', 'n_name'] end as shared from nation""")
def u05_column_sets(spark, sf_dir):
    col = lambda n: F.struct(F.lit(n).alias("name"), F.lit("text").alias("type"))
    old = F.array(col("n_key"), col("n_name"))
    new = F.when(F.col("n_regionkey") == 0, F.array(col("n_key"))).when(F.col("n_regionkey") > 1, F.array(col("n_key"), col("n_name"), col("n_extra"))).otherwise(old)
    return table(spark, sf_dir, "nation").select("n_name", schemas.column_sets(old, new).alias("d")).select("n_name", "d.added", "d.removed", "d.shared")


@query("""select event_id, case when user_id % 2 = 0 then 'a,b' else 'b' end as d from events""")
def u06_destinations(spark, sf_dir):
    d = F.array(F.lit("b"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"), F.lit("b"))
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", F.array_sort(F.array_distinct(d))).alias("d"))
