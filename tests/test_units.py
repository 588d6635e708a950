"""Fixed vectors and invariants."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import predicates as P
from deltaloom.functions import scalar as S
from deltaloom.operators import compaction, dedup, offsets, sketches, transforms
from deltaloom.sources import registry as G


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_casts(spark):
    lit = F.lit
    r = one(spark, a=S.to_integer(lit("3.7"), "string"), b=S.to_integer(lit(3.7), "double"), c=S.to_integer(lit(True), "boolean"), d=S.to_boolean(lit("yes"), "string"), e=S.to_boolean(lit(None).cast("string"), "string"), f=S.to_float(lit(True), "boolean"), g=S.to_integer(lit(-3.7), "double"))
    assert tuple(r) == (None, 3, 1, True, False, None, -3)


def test_masks(spark):
    rows = [("", "", ""), ("abcde", "*****", "ab*de"), ("x" * 25, "*" * 20, "xx" + "*" * 21 + "xx"), ("abcd", "****", "****"), ("é€", "*****", "é€")]
    df = spark.createDataFrame([(a,) for a, *_ in rows], "s string")
    got = df.select("s", transforms.mask_value(F.col("s"), "string", "asterisks").alias("a"), transforms.mask_value(F.col("s"), "string", "partial").alias("p")).collect()
    assert [r["a"] for r in got] == [r[1] for r in rows]
    assert [r["p"] for r in got][:4] == [r[2] for r in rows][:4]


def test_times(spark):
    f = lambda v, k: S.epoch_millis(v, k)
    r = one(spark, a=f(F.lit(1705314600), "bigint"), b=f(F.lit(1705314600000), "bigint"), c=f(F.lit("2024-01-15T10:30:00Z"), "string"), d=f(F.lit("2024-01-15 10:30:00"), "string"), e=f(F.lit("bad"), "string"))
    assert tuple(r) == (1705314600000,) * 4 + (None,)


def test_zone_gap_and_overlap(spark):
    to = lambda s: S.to_zone(F.lit(s), "America/New_York", "UTC")
    r = one(spark, ok=to("2024-01-15 10:30:00"), gap=to("2024-03-10 02:30:00"), twice=to("2024-11-03 01:30:00"), bad=to("nothing"))
    assert tuple(r) == ("2024-01-15T15:30:00", "2024-03-10 02:30:00", "2024-11-03 01:30:00", "nothing")
    with pytest.raises(ValueError):
        S.java_pattern("%Q")


def test_predicates_are_two_valued(spark):
    for v, want in ((None, (False, True, True, False, False)), ("1", (True, False, False, True, True))):
        c = F.lit(v).cast("string")
        r = one(spark, eq=P.equals(c, "1"), ne=P.not_equals(c, "1"), nul=P.is_null(c), fits=P.matches(c, "^1$"), member=P.one_of(c, ["1"]))
        assert tuple(r) == want
    assert tuple(one(spark, a=P.matches(F.lit("x"), "("), b=P.matches(F.lit("x"), "(?=x)"))) == (False, False)
    for bad in ("x", "x >", "x > 3"):
        with pytest.raises(ValueError):
            P.parse(bad, F.col)


def test_topic_names(spark):
    long = "a" * 300
    name = one(spark, n=S.topic_name(F.lit(long)))["n"]
    h = 0
    for b in long.encode():
        h = (h * 31 + b) & 0xFFFFFFFF
    assert name == "a" * 240 + f"_{h:08x}" and len(name) == 249
    assert one(spark, n=S.normalize_identifier(F.lit("dbo.9-Lives_v1"), strip_prefixes=["dbo."], strip_suffixes=["_v1"], avro=True))["n"] == "_9_Lives"
    with pytest.raises(ValueError):
        S.topic_template("{nothing}")


def test_murmur2_vectors(spark):
    def plain(data: bytes) -> int:
        m, mask, n = 0x5BD1E995, 0xFFFFFFFF, len(data)
        h = 0x9747B28C ^ n
        for k in range(0, n - n % 4, 4):
            x = int.from_bytes(data[k : k + 4], "little") * m & mask
            h = (h * m & mask) ^ ((x ^ x >> 24) * m & mask)
        if n % 4:
            h = (h ^ int.from_bytes(data[n - n % 4 :], "little")) * m & mask
        h = (h ^ h >> 13) * m & mask
        return h ^ h >> 15

    words = ["", "a", "ab", "abc", "abcd", "hello", "kafka", "é€", "x" * 33]
    got = spark.createDataFrame([(w,) for w in words], "s string").select("s", S.murmur2(F.col("s")).alias("h")).collect()
    assert [(r["s"], r["h"]) for r in got] == [(w, plain(w.encode())) for w in words]


def test_compaction_is_idempotent(spark):
    rows = [(k % 5, k, "d" if k % 7 == 0 else "u") for k in range(100)]
    log = spark.createDataFrame(rows, "k long, seq long, op string")
    once = compaction.latest(log, F.col("k"), ["seq"]).drop("_key")
    assert sorted(once.collect()) == sorted(compaction.latest(once, F.col("k"), ["seq"]).drop("_key").collect())


def test_first_within_counts_from_the_kept_event(spark):
    rows = [("a", s, s) for s in (0, 5, 9, 10, 15, 19, 21)] + [("b", 3, 100), ("b", 3, 101)]
    df = spark.createDataFrame(rows, "k string, t long, seq long")
    got = dedup.first_within(df, F.col("k"), "t", ["seq"], 10).collect()
    assert sorted((r["k"], r["t"], r["seq"]) for r in got) == [("a", 0, 0), ("a", 10, 10), ("a", 21, 21), ("b", 3, 100)]


def test_assignments():
    assert [len([x for x in offsets.assign_range(["a", "b", "c"], {"t": 10}) if x[0] == m]) for m in "abc"] == [4, 3, 3]
    before = offsets.assign_sticky(["a", "b"], {"t": 6})
    after = offsets.assign_sticky(["a", "b", "c"], {"t": 6}, before)
    assert sorted(len([x for x in after if x[0] == m]) for m in "abc") == [2, 2, 2]
    assert len(set(before) & set(after)) == 4
    assert offsets.assign_range([], {"t": 3}) == [] == offsets.assign_sticky([], {"t": 3})


def test_counting_filter_forgets(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", -1)], "k string, s int")
    left = sketches.counting(df, F.col("k"), 100, 0.01, F.col("s"))
    only = sketches.counting(df.where("k = 'a'"), F.col("k"), 100, 0.01, F.col("s"))
    assert sorted(left.collect()) == sorted(only.collect())
    a = sketches.bloom(df.where("k = 'a'"), F.col("k"), 100, 0.01)
    b = sketches.bloom(df.where("k = 'b'"), F.col("k"), 100, 0.01)
    both = sketches.might_contain(df.select("k").distinct(), "k", sketches.merge(a, b))
    assert both.where("might_contain").count() == 2 and 0 < a.fill_ratio() < 0.05


V1 = json.dumps({"type": "record", "name": "User", "fields": [{"name": "id", "type": "string"}, {"name": "n", "type": "int"}]})
V2 = json.dumps({"type": "record", "name": "User", "fields": [{"name": "id", "type": "string"}, {"name": "n", "type": "long"}, {"name": "email", "type": ["null", "string"], "default": None}]})
V3 = json.dumps({"type": "record", "name": "User", "fields": [{"name": "id", "type": "string"}, {"name": "age", "type": "int"}]})


def test_avro_compatibility():
    assert G.compatible("BACKWARD", "avro", V2, [V1]) == []
    assert G.compatible("FORWARD", "avro", V2, [V1]) != []
    assert G.compatible("BACKWARD", "avro", V3, [V1]) != []
    assert G.compatible("NONE", "avro", V3, [V1]) == []
    assert G.avro_reads("string", ["null", "string"]) == [] and G.avro_reads(["null", "string"], "int") != []
    enum = lambda *s: {"type": "enum", "name": "E", "symbols": list(s)}
    assert G.avro_reads(enum("a", "b"), enum("a")) == [] and G.avro_reads(enum("a"), enum("a", "b")) != []


def test_json_and_proto_compatibility():
    a = {"type": "object", "properties": {"x": {"type": "string"}}}
    b = {"type": "object", "properties": {"x": {"type": "string"}, "y": {"type": "integer"}}, "required": ["y"]}
    assert G.compatible("BACKWARD", "json", json.dumps(b), [json.dumps(a)]) != []
    assert G.compatible("FORWARD", "json", json.dumps(a), [json.dumps(b)]) != []
    assert G.compatible("BACKWARD", "json", json.dumps(a), [json.dumps(a)]) == []
    old = "message M { required string a = 1; int32 b = 2; reserved 9; enum E { X = 0; Y = 1; } }"
    assert G.compatible("FULL", "protobuf", "message M { required string a = 1; int32 b = 2; string c = 3; enum E { X = 0; Y = 1; } }", [old]) == []
    for new in ("message M { int32 b = 2; }", "message M { required string a = 1; int64 b = 2; }", "message M { required string a = 1; int32 z = 9; }", "message M { required string a = 1; enum E { X = 0; } }"):
        assert G.compatible("FULL", "protobuf", new, [old]) != []


def test_registry_life():
    r = G.Registry(rules=list(G.PRODUCTION))
    a = r.register("users-value", V1)
    assert r.register("users-value", json.dumps(json.loads(V1), indent=2)) == a
    b = r.register("users-value", V2, references=[("base", 1)])
    assert (r.versions("users-value"), r.get("users-value").id, r.by_id(a).version) == ([1, 2], b, 1)
    with pytest.raises(ValueError):
        r.register("users-value", V3)
    assert r.referencing("base", 1) == [("users-value", 2)]
    r.delete("users-value", 2)
    assert r.versions("users-value") == [1]
    r.undelete("users-value")
    r.set_state("users-value", 2, "deprecated")
    assert r.get("users-value", 2).state == "deprecated" and r.names() == ["users-value"]
    r.delete("users-value", permanent=True)
    assert r.names() == []


def test_rules_and_inference():
    assert G.validate([G.Rule("big", "max_size", 5), G.Rule("name", "naming", "[A-Z].*"), G.Rule("no x", "forbid", "email", "warning")], V2) == [("error", "big"), ("warning", "no x")]
    s = G.infer([{"a": 1, "b": "x"}, {"a": 2.5}, {"a": None, "c": [1, 2]}])
    assert s["properties"]["a"]["type"] == ["null", "number"] and s["required"] == [] and s["properties"]["c"]["items"] == {"type": "integer"}
