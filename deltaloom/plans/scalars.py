"""Scalar functions."""

from pyspark.sql import functions as F

from deltaloom.envelope import events_log, table
from deltaloom.functions import predicates as P
from deltaloom.functions import scalar as S
from deltaloom.registry import query


@query("""select event_id, event_type || ':' || user_id || '' as c from events""")
def x01_concat(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.concat(F.col("event_type"), F.lit(":"), F.col("user_id"), F.lit(None)).alias("c"))


@query("""select event_id, sha256('"' || replace(props, '"', '\\"') || '"' || user_id) as h from events""")
def x02_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.json_hash([(F.col("props"), "string"), (F.col("user_id"), "bigint")]).alias("h"))


@query("""select event_id, coalesce(case when value > 50 then 'big' end, event_type) as c from events""")
def x03_coalesce(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(F.col("value") > 50, "big"), F.col("event_type")).alias("c"))


@query("""select l_orderkey, round(sum(coalesce(l_quantity, 0) + l_tax), 3) as s from lineitem group by 1""")
def x04_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(S.total(F.col("l_quantity"), F.col("l_tax"), F.lit(None))), 3).alias("s"))


@query("""select doc_id, strlen(text) as n from documents""")
def x05_byte_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.byte_length(F.col("text")).cast("long").alias("n"))


@query("""select doc_id, upper(source) as u, lower(upper(lang)) as l from documents""")
def x06_upper_lower(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.upper("source").alias("u"), F.lower(F.upper("lang")).alias("l"))


@query("""select doc_id, substr(text, 4, 10) as a, substr(text, 1 + length(text) - 2) as b from documents""")
def x07_substring(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.substring(F.col("text"), 3, 10).alias("a"), F.substr("text", F.length("text") - 1).alias("b"))


@query(r"""select p_partkey, regexp_replace(p_brand, '#(\d)', '-\1', 'g') as r from part""")
def x08_replace(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_brand", r"#(\d)", "-$1").alias("r"))


@query()
def x09_timestamp_uuid(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.current_timestamp().alias("at"), F.uuid().alias("u"))


@query("""select event_id, cast(regexp_extract(props, '"k": ?(-?[0-9]+)', 1) as bigint) as k from events""")
def x10_json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""select event_id, case when event_type = 'click' then 'a' when regexp_matches(props, '9') then 'b' else 'c' end as c from events""")
def x11_conditional(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.when(P.equals(F.col("event_type"), "click"), "a").when(P.matches(F.col("props"), "9"), "b").otherwise("c").alias("c"))


@query("""with known as (select * from (values ('', 275646681), ('hello', 2132663229), ('kafka', 3496464228)) t(s, h)) select s, h, cast(null as bigint) as n from known
union all select 'keys', null, count(distinct user_id) from events""")
def x12_murmur2(spark, sf_dir):
    """Known values, and the keys of the whole table: as many hashes as keys."""
    known = spark.createDataFrame([("",), ("hello",), ("kafka",)], "s string").select("s", S.murmur2(F.col("s")).alias("h"), F.lit(None).cast("long").alias("n"))
    keys = table(spark, sf_dir, "events").select(S.murmur2(F.col("user_id").cast("string")).alias("h")).agg(F.count_distinct("h").alias("n"))
    return known.unionByName(keys.select(F.lit("keys").alias("s"), F.lit(None).cast("long").alias("h"), "n"))


@query("""with recursive e as (select distinct user_id, cast(user_id as ubigint) as h from events),
a as (select user_id, xor(h, h >> 33) as h from e),
b as (select user_id, cast((cast(h as uhugeint) * 18397679294719823053) % 18446744073709551616 as ubigint) as h from a),
c as (select user_id, xor(h, h >> 33) as h from b),
d as (select user_id, cast((cast(h as uhugeint) * 14181476777654086739) % 18446744073709551616 as ubigint) as h from c),
f as (select user_id, xor(h, h >> 33) as h from d)
select user_id, cast(h % 8 as integer) as p8, cast(h % 97 as integer) as p97 from f""")
def x13_key_hash_partition(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select("user_id", S.finalized_partition(F.col("user_id"), 8).alias("p8"), S.finalized_partition(F.col("user_id"), 97).alias("p97"))


@query("""select count(*) as n, true as few_moved from customer""")
def x14_consistent_ring(spark, sf_dir):
    from deltaloom.operators.routing import ring_partition

    c = table(spark, sf_dir, "customer").select("c_custkey")
    both = ring_partition(ring_partition(c, F.col("c_custkey"), 8, target="a"), F.col("c_custkey"), 9, target="b")
    return both.agg(F.count("*").alias("n"), (F.count_if((F.col("a") != F.col("b")) & (F.col("b") != 8)) == 0).alias("few_moved"))


@query("""with known as (select * from (values ('', 'cbf29ce484222325'), ('a', 'af63dc4c8601ec8c'), ('foobar', '85944171f73967e8')) t(s, h)) select s, h, cast(null as bigint) as n from known
union all select 'urls', null, count(distinct url) from pages""")
def x15_fnv1a(spark, sf_dir):
    known = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select("s", S.fnv1a64(F.col("s")).alias("h"), F.lit(None).cast("long").alias("n"))
    urls = table(spark, sf_dir, "pages").agg(F.count_distinct(S.fnv1a64(F.col("url"))).alias("n"))
    return known.unionByName(urls.select(F.lit("urls").alias("s"), F.lit(None).cast("string").alias("h"), "n"))


@query("""select '123456789' as s, 3421780262 as c""")
def x16_crc32(spark, sf_dir):
    return spark.createDataFrame([("123456789",)], "s string").select("s", F.crc32("s").alias("c"))


@query("""select * from (values ('CustomerOrder', 'customer_order', 'customer-order', 'customerorder'), ('HTTPLog', 'http_log', 'http-log', 'httplog')) t(s, snake, kebab, low)""")
def x17_case_conversion(spark, sf_dir):
    s = F.col("s")
    return spark.createDataFrame([("CustomerOrder",), ("HTTPLog",)], "s string").select("s", S.convert_case(s, "snake").alias("snake"), S.convert_case(s, "kebab").alias("kebab"), S.convert_case(s, "lower").alias("low"))


@query("""select c_custkey, regexp_replace(c_name, '[^A-Za-z0-9._\\-]', '_', 'g') as plain, strlen(c_name) <= 249 as short from customer""")
def x18_identifier_normalization(spark, sf_dir):
    name = S.topic_name(S.normalize_identifier(F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("plain"), (F.octet_length(name) <= 249).alias("short"))


@query("""with {EV} select event_id, 'cdc.driver.public.events' as topic from ev""")
def x19_topic_template(spark, sf_dir):
    return events_log(spark, sf_dir).select(P.field("event_id").alias("event_id"), S.topic_template("cdc.{database}.{schema}.{table}").alias("topic"))


@query("""select event_id, 'User ' || user_id || ' did ' || event_type || '.' as prompt from events""")
def x20_prompt_template(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", S.prompt_template("User {{user_id}} did {{ event_type }}.{{nothing}}", lambda f: F.col(f) if f in e.columns else F.lit(None)).alias("prompt"))


@query("""select r_name, md5('{"name":"' || r_name || '"}') as m, sha256('{"name":"' || r_name || '"}') as s from region""")
def x21_schema_fingerprint(spark, sf_dir):
    text = F.concat(F.lit('{"name":"'), "r_name", F.lit('"}'))
    return table(spark, sf_dir, "region").select("r_name", F.md5(text).alias("m"), F.sha2(text, 256).alias("s"))


@query("""select c_custkey, c_custkey::hugeint * 4294967296 + c_custkey * 7 as pos, c_custkey // 100 * 4294967296 + c_custkey as binlog, c_custkey between 10 and 20 or c_custkey = 33 as held from customer""")
def x22_position_parse(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat_ws("/", F.hex("c_custkey"), F.hex(k * 7))
    binlog = S.binlog_position(F.concat(F.lit("mysql-bin."), F.lpad(F.floor(k / 100).cast("string"), 6, "0")), k)
    ranges = S.gtid_ranges(F.lit("3E11FA47-71CA-11E1-9E33-C80AA9429562:10-20:33, 00000000-71ca-11e1-9e33-c80aa9429562:1-99999"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.lsn(text).alias("pos"), binlog.alias("binlog"), S.gtid_holds(ranges, F.lit("3e11fa47-71ca-11e1-9e33-c80aa9429562"), k).alias("held"))


@query("""with s as (select n_nationkey, case n_nationkey % 12 when 0 then 'CREATE TABLE ' || n_name || ' (a int)' when 1 then '  alter table ' || n_name || ' add b int' when 2 then 'truncate ' || n_name when 3 then 'select 1'
  when 4 then 'Create unique index i on ' || n_name when 5 then '/* x */ CREATE TABLE ' || n_name when 6 then 'begin; drop table ' || n_name when 7 then 'rename table a to b' when 8 then 'exec RENAME TO ' || n_name
  when 9 then 'ALTER TABLE a RENAME TO b' when 10 then 'drop index i' else 'create database d' end as sql from nation)
select n_nationkey, sql, case n_nationkey % 12 when 0 then 'create' when 1 then 'alter' when 2 then 'truncate' when 3 then 'other' when 4 then 'create_index' when 5 then 'create' when 6 then 'drop' when 7 then 'rename' when 8 then 'rename'
  when 9 then 'alter' when 10 then 'drop_index' else 'other' end as kind from s""")
def x23_ddl_classifier(spark, sf_dir):
    shapes = ["CREATE TABLE {} (a int)", "  alter table {} add b int", "truncate {}", "select 1", "Create unique index i on {}", "/* x */ CREATE TABLE {}", "begin; drop table {}", "rename table a to b", "exec RENAME TO {}", "ALTER TABLE a RENAME TO b", "drop index i", "create database d"]
    n = table(spark, sf_dir, "nation")
    sql = F.replace(F.element_at(F.array(*map(F.lit, shapes)), (F.col("n_nationkey") % 12 + 1).cast("int")), F.lit("{}"), F.col("n_name"))
    return n.select("n_nationkey", sql.alias("sql"), S.ddl_kind(sql).alias("kind"))


@query("""select p_partkey, cast(trunc(p_retailprice) as bigint) as i, p_retailprice <> 0 as b, cast(p_size as double) as f, cast(p_size as varchar) as s from part""")
def x24_value_coercions(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", S.to_integer(c("p_retailprice"), "double").alias("i"), S.to_boolean(c("p_retailprice"), "double").alias("b"), S.to_float(c("p_size"), "int").alias("f"), c("p_size").cast("string").alias("s"))
