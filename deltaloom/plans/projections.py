"""Record transforms."""

from pyspark.sql import functions as F

from deltaloom.envelope import customer_snapshot, events_log, micros, orders_log, table
from deltaloom.functions import predicates as P
from deltaloom.functions import scalar as S
from deltaloom.operators import compaction as C
from deltaloom.operators import transforms as X
from deltaloom.registry import query


@query("""with {EV}, kept as (select * from ev where event_type <> 'view'),
last as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from kept)
select event_id, user_id, event_type, sha256('"' || replace(props, '"', '\\"') || '"') as props, upper(event_type) as kind_upper, round(value + user_id, 4) as score
from last where n = 1 and op <> 'd'""")
def flagship_latest_users(spark, sf_dir):
    log = events_log(spark, sf_dir).where(P.not_equals(P.field("event_type"), "view"))
    log = X.mask_fields(["props"], "hash")(log)
    log = X.compute(kind_upper=lambda c: F.upper(c["event_type"]), score=lambda c: F.round(S.total(c["value"], c["user_id"]), 4))(log)
    out = C.latest(log, P.field("user_id"), ["ts_s", "seq"])
    return out.select("after.event_id", "after.user_id", "after.event_type", "after.props", "after.kind_upper", "after.score")


@query("""with {EV} select event_id, user_id, op as __op, 'events' as __table, 'public' as __schema, ts_s * 1000 as __ts_ms, case when op = 'd' then true end as __deleted from ev""")
def p01_extract_new_state(spark, sf_dir):
    out = X.extract_new_state("rewrite", op=True, table=True, schema=True, ts=True)(events_log(spark, sf_dir))
    return out.select("after.event_id", "after.user_id", "after.__op", "after.__table", "after.__schema", "after.__ts_ms", "after.__deleted")


@query("""with {EV} select event_id, op as x_op from ev where op <> 'd'""")
def p01_extract_drop_deletes(spark, sf_dir):
    return X.extract_new_state("drop", op=True, prefix="x_")(events_log(spark, sf_dir)).select("after.event_id", "after.x_op")


@query("""with {EV} select event_id, user_id as key_user, event_type as key_type from ev where op <> 'd'""")
def p02_value_to_key(spark, sf_dir):
    out = X.value_to_key(["user_id", "event_type", "nothing"])(events_log(spark, sf_dir)).where("after is not null")
    return out.select("after.event_id", F.col("after.__key.user_id").alias("key_user"), F.col("after.__key.event_type").alias("key_type"))


@query("""with {EV} select event_id as id, user_id as who from ev""")
def p03_replace_field(spark, sf_dir):
    out = X.replace_fields({"event_id": "id", "user_id": "who", "value": "v"}, include=["id", "who", "v"], exclude=["v"])(events_log(spark, sf_dir))
    assert out.schema["after"].dataType.names == ["id", "who"]
    return out.select(P.field("id").alias("id"), P.field("who").alias("who"))


@query("""with {EV} select event_id, 'web' as channel, event_type as kind, cast(null as varchar) as lost from ev where op <> 'd'""")
def p04_insert_field(spark, sf_dir):
    out = X.insert_fields({"channel": "web"}, {"kind": "event_type", "lost": "nothing"})(events_log(spark, sf_dir)).where("after is not null")
    return out.select("after.event_id", "after.channel", "after.kind", "after.lost")


@query()
def p04_insert_now(spark, sf_dir):
    return X.insert_fields(now="at", today="day")(events_log(spark, sf_dir)).where("after is not null").select("after.event_id", "after.at", "after.day")


@query("""with {EV} select event_id, user_id as "u.id", event_type as "u.kind.name", value as plain from ev""")
def p05_flatten(spark, sf_dir):
    nested = lambda im: F.when(F.col(im).isNotNull(), F.struct(F.col(f"{im}.event_id"), F.struct(F.col(f"{im}.user_id").alias("id"), F.struct(F.col(f"{im}.event_type").alias("name")).alias("kind")).alias("u"), F.col(f"{im}.value").alias("plain")))
    out = X.flatten()(events_log(spark, sf_dir).withColumns({im: nested(im) for im in X.BOTH}))
    return out.select(F.coalesce("after", "before").alias("r")).select("r.event_id", F.col("r.`u.id`").alias("u.id"), F.col("r.`u.kind.name`").alias("u.kind.name"), "r.plain")


@query("""with {EV} select event_id, 'driver' as h_database, 'events' as h_table, op as h_op, ts_s as h_timestamp, cast(event_id // 10 as varchar) as txn from ev where op <> 'd'""")
def p06_header_to_value(spark, sf_dir):
    out = X.header_to_value({"txn": "transaction_id"}, prefix="h_")(events_log(spark, sf_dir, txn=True)).where("after is not null")
    return out.select("after.event_id", "after.h_database", "after.h_table", "after.h_op", "after.h_timestamp", "after.txn")


@query("""with {EV} select event_id, user_id, event_type from ev where op <> 'd'""")
def p07_unwrap(spark, sf_dir):
    log = events_log(spark, sf_dir)
    log = log.withColumn("after", F.when(F.col("after").isNotNull(), F.struct("after.event_id", F.struct("after.user_id", "after.event_type").alias("payload"))))
    merged = X.unwrap("payload", merge=True)(log)
    inner = X.unwrap("payload")(log)
    assert inner.schema["after"].dataType.names == ["user_id", "event_type"] and X.unwrap("a.b")(log).schema == log.schema
    return merged.where("after is not null").select("after.event_id", "after.user_id", "after.event_type")


@query("""with {EV} select event_id, case when event_type <> 'click' then event_type end as event_type, case when not regexp_matches(props, '7') then props end as props, cast(null as double) as value from ev where op <> 'd'""")
def p08_set_null(spark, sf_dir):
    step = X.chain(X.set_null(["event_type"], "equals", "click"), X.set_null(["props"], "matches", "7"), X.set_null(["value"]))
    return step(events_log(spark, sf_dir)).where("after is not null").select("after.event_id", "after.event_type", "after.props", "after.value")


@query("""select doc_id, sha256('"' || source || '"') as source, repeat('*', least(strlen(lang), 20)) as lang, '***' as fixed,
case when strlen(source) <= 4 then repeat('*', strlen(source)) else substr(source, 1, 2) || repeat('*', strlen(source) - 4) || substr(source, length(source) - 1) end as part
from documents""")
def p09_mask_field(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("lang").alias("fixed"), F.col("source").alias("part"))
    log = d.select(F.struct(*d.columns).alias("after"))
    step = X.chain(X.mask_fields(["source"], "hash", X.AFTER), X.mask_fields(["lang"], "asterisks", X.AFTER), X.mask_fields(["fixed"], "fixed", X.AFTER), X.mask_fields(["part"], "partial", X.AFTER))
    return step(log).select("after.*")


@query("""with {ORD} select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' as iso, case when epoch_us(o_orderdate) // 1000 > 1000000000000 then epoch_us(o_orderdate) // 1000000 else epoch_us(o_orderdate) // 1000 end as s, epoch_us(o_orderdate) // 1000 as ms, strftime(o_orderdate, '%Y-%m-%d') as d, strftime(o_orderdate, '%H:%M:%S') as t, 'bad' as bad from od""")
def p10_timestamp_converter(spark, sf_dir):
    ms = F.floor(micros("o_orderdate") / 1000)
    text = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("iso"), ms.alias("s"), F.floor(ms / 1000).alias("ms"), text.alias("d"), text.alias("t"), F.lit("bad").alias("bad"))
    log = o.select(F.struct(*o.columns).alias("after"), F.struct(*o.columns).alias("before"))
    step = X.chain(X.convert_times(["iso", "bad"], "iso"), X.convert_times(["s"], "epoch_s"), X.convert_times(["ms"], "epoch_ms"), X.convert_times(["d"], "date"), X.convert_times(["t"], "time"))
    return step(log).select("after.*")


@query("""with {ORD} select o_orderkey, strftime(o_orderdate + interval 9 hour, '%d.%m.%Y %H:%M') as tokyo, strftime(o_orderdate - interval 330 minute, '%Y-%m-%dT%H:%M:%S') as utc from od""")
def p11_timezone_converter(spark, sf_dir):
    text = F.date_format(F.timestamp_micros(micros("o_orderdate")), "yyyy-MM-dd HH:mm:ss")
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("tokyo"), text.alias("utc"))
    log = o.select(F.struct(*o.columns).alias("after"), F.struct(*o.columns).alias("before"))
    return X.chain(X.convert_zone(["tokyo"], "UTC", "Asia/Tokyo", "%d.%m.%Y %H:%M"), X.convert_zone(["utc"], "Asia/Kolkata", "UTC"))(log).select("after.*")


@query("""with {EV} select event_id, cast(trunc(value) as bigint) as value, cast(user_id as varchar) as user_id, false as event_type, cast(null as bigint) as props from ev""")
def p12_cast(spark, sf_dir):
    out = X.cast_fields({"value": "integer", "user_id": "string", "event_type": "boolean", "props": "integer"})(events_log(spark, sf_dir))
    return out.select(F.coalesce("after", "before").alias("r")).select("r.event_id", "r.value", "r.user_id", "r.event_type", "r.props")


@query("""with {EV} select event_id, event_type || '-' || cast(user_id as varchar) as label, upper(event_type || '-' || cast(user_id as varchar)) as loud, strlen(props) as size, substr(event_type, 2, 3) as part, replace(event_type, 'e', 'E') as repl, round(value + user_id, 4) as total, case when event_type = 'click' then 'hit' else 'other' end as cond, coalesce(cast(null as varchar), event_type) as coal
from ev where op <> 'd'""")
def p13_compute_field(spark, sf_dir):
    step = X.compute(
        label=lambda c: S.concat(c["event_type"], F.lit("-"), c["user_id"]), loud=lambda c: F.upper(c["label"]), size=lambda c: S.byte_length(c["props"]).cast("long"),
        part=lambda c: S.substring(c["event_type"], 1, 3), repl=lambda c: F.regexp_replace(c["event_type"], "e", "E"), total=lambda c: F.round(S.total(c["value"], c["user_id"]), 4),
        cond=lambda c: S.conditional(P.equals(c["event_type"], "click"), "hit", "other"), coal=lambda c: F.coalesce(F.lit(None).cast("string"), c["event_type"]),
    )
    out = step(events_log(spark, sf_dir)).where("after is not null")
    return out.select(*(f"after.{n}" for n in ("event_id", "label", "loud", "size", "part", "repl", "total", "cond", "coal")))


@query("""select doc_id, case when strlen(text) < 4096 then text end as text, case when strlen(text) >= 4096 then strlen(text) end as size, case when strlen(text) >= 4096 then 'blob://store/' || sha256(text) end as url from documents""")
def p14_externalize_blob(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = X.externalize(["text"], 4096)(d.select(F.struct("doc_id", "text").alias("after")))
    return out.select("after.doc_id", "after.text", F.col("after.text__ref.size").cast("long").alias("size"), "after.text__ref.url")


@query("""with {EV} select event_id as id, event_type, event_type as copied, 1 as added from ev where op <> 'd'""")
def p15_field_helpers(spark, sf_dir):
    step = X.chain(X.replace_fields({"event_id": "id"}, exclude=["ts"]), X.insert_fields({"added": 1}, {"copied": "event_type"}), X.replace_fields(include=["id", "event_type", "copied", "added"]))
    return step(events_log(spark, sf_dir)).where("after is not null").select("after.*")


@query("""with {EV} select case op when 'c' then 'insert' when 'd' then 'delete' else 'update' end as kind, 'public.events' as stream, 'batch' as origin, event_id as seq from ev where op = 'c'""")
def p16_source_runner_steps(spark, sf_dir):
    e = X.to_source_event(events_log(spark, sf_dir))
    steps = [("filter_type", "insert"), ("filter_stream", "public.events"), ("rename", "event_type", "kind"), ("add", "origin", "batch")]
    return X.run_steps(e, steps).select("kind", "stream", "origin", "seq")


@query("""select 'c' as op, c_custkey, '***MASKED***' as c_name, c_mktsegment as segment, 'cdc.customer' as topic from customer""")
def p17_pipeline_builtins(spark, sf_dir):
    step = X.chain(X.normalize_snapshot(), X.only_ops(["c", "u"]), X.exclude_tables(["sales.order*"]), X.mask_fields(["c_name"], "fixed", fixed=X.MASKED), X.replace_fields({"c_mktsegment": "segment"}))
    out = step(customer_snapshot(spark, sf_dir))
    return out.select("op", "after.c_custkey", "after.c_name", "after.segment", S.topic_template("cdc.{table}").alias("topic"))


@query("""with {EV} select event_id, '***REDACTED***' as user_mask, cast(null as varchar) as props from ev""")
def p18_table_column_filter(spark, sf_dir):
    log = X.replace_fields({"event_type": "user_mask"})(events_log(spark, sf_dir))
    step = X.table_filter(["PUBLIC.ev*", "sales.*"], ["*.orders"], drop_columns=["VALUE"], mask_columns=["User_Mask"], table_columns={"public.events": ["props"]})
    out = step(log).unionByName(step(log.withColumn("table", F.lit("orders"))))
    return out.select(P.field("event_id").alias("event_id"), P.field("user_mask").alias("user_mask"), P.field("props").alias("props"))


@query("""with {ORD} select o_orderkey, o_totalprice from od""")
def p19_stream_column_filter(spark, sf_dir):
    return X.replace_fields(include=["o_orderkey", "o_totalprice"])(orders_log(spark, sf_dir)).select(P.field("o_orderkey").alias("o_orderkey"), P.field("o_totalprice").alias("o_totalprice"))


@query("""with {ORD} select case op when 'c' then 'insert' when 'd' then 'delete' else 'update' end as event_type, 'sales.orders' as stream, 'sales' as namespace, ts_s as timestamp, o_orderkey as seq from od""")
def p20_cdc_to_source_event(spark, sf_dir):
    return X.to_source_event(orders_log(spark, sf_dir)).drop("data", "transaction_id")


@query("""with {ORD} select '1.0' as specversion, 'change.' || case op when 'c' then 'insert' when 'd' then 'delete' else 'update' end as type, '/driver' as source, 'sales.orders' as subject, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' as time, o_orderkey as seq from od""")
def p21_cloud_events(spark, sf_dir):
    return X.cloud_event(X.to_source_event(orders_log(spark, sf_dir)), "/driver").drop("data")


@query("""with {ORD} select o_orderkey, op = 'c' as is_insert, op = 'u' as is_update, op = 'd' as is_delete, strlen('{"k":' || o_orderkey || '}') as size from od""")
def p21_event_accessors(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    small = log.withColumns({im: F.when(F.col(im).isNotNull(), F.struct(F.col(f"{im}.o_orderkey").alias("k"))) for im in ("before", "after")})
    return X.accessors(small).select(F.col("seq").alias("o_orderkey"), "is_insert", "is_update", "is_delete", "size")


KEY = "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"


@query("""with {EV} select event_id, event_type, true as stable, true as hidden from ev""")
def p22_field_encryption(spark, sf_dir):
    log = events_log(spark, sf_dir)
    log = X.insert_fields(copies={"a": "event_type", "b": "event_type"})(log.withColumn("after", F.coalesce("after", "before")))
    sealed = X.encrypt_fields(["a", "b"], KEY, "k1", deterministic=True)(log.withColumn("before", F.col("after")))
    stable, hidden = F.col("after.a") == F.col("after.b"), F.col("after.a") != F.col("after.event_type")
    opened = X.decrypt_fields(["a"], KEY, "k1")(sealed.withColumns({"stable": stable, "hidden": hidden}))
    return opened.select("after.event_id", F.col("after.a").alias("event_type"), "stable", "hidden")


@query("""with {LOG} select partition, "offset", upper(value) as value from lg where strlen(value) > 0""")
def p23_record_batch_map_filter(spark, sf_dir):
    from deltaloom.envelope import log_table

    full = X.filter_batch(log_table(spark, sf_dir), F.octet_length("value") > 0)
    return X.map_batch(full, value=F.upper("value")).select("partition", "offset", "value")