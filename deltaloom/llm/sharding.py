"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the method: the multiplier of its linear congruential generator, as two 32-bit halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64 on 32-bit halves; no product leaves 49 bits, so ANSI arithmetic never overflows."""

    def low32(x: Column, m: int) -> Column:
        return (x.bitwiseAND(0xFFFF) * F.lit(m) + F.shiftleft((F.shiftright(x, 16) * F.lit(m & 0xFFFF)).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)

    p0, p1 = lo.bitwiseAND(0xFFFF) * F.lit(LOW), F.shiftright(lo, 16) * F.lit(LOW)
    low = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + F.lit(1)
    high = F.shiftright(p1, 16) + F.shiftright(low, 32) + low32(hi, LOW) + low32(lo, HIGH)
    return high.bitwiseAND(MASK), low.bitwiseAND(MASK)


def jump_hash(key: Column, shards: int) -> tuple[Column, Column]:
    """(shard among `shards`, shard among `shards` + 1) of a long key, from one run of the jump sequence.

    The sequence of jumps does not depend on the shard count; a count only says where it stops. So the last jump target
    below the count is the shard, and appending a shard moves a key only into the new one. Targets rise by one at
    least, so `shards` + 1 steps always suffice.
    """
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(MASK).alias("lo"), F.lit(0).cast("long").alias("j"),
        F.lit(-1).cast("long").alias("b"), F.lit(-1).cast("long").alias("g"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next_key(s["hi"], s["lo"])
        at = s["j"]
        jump = F.floor((at + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(
            hi.alias("hi"), lo.alias("lo"), jump.cast("long").alias("j"),
            F.when(at < shards, at).otherwise(s["b"]).alias("b"), at.alias("g"),
        )
        return F.when(at <= shards, moved).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(s["b"], s["g"]))
    return end["b"].cast("int"), end["g"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, blocks: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs, under the law `key`.

    doc_id and the shard count alone decide the shard; grown_shard is the one with a shard more. size: UTF-8 bytes and 8.
    slot numbers a shard's rows from 0 without a gap: each shard is dealt over `blocks` groups by a hash of the row and its split, a
    group numbers its own rows, and prefix sums over the groups' row counts (shards x blocks numbers, whatever the
    input) give each group its first slot. So no task needs a whole shard, and rows that repeat very often are in as many groups as they are in splits. blocks: default the shuffle partitions.

    A null text has size 8 and checksum 0. A null doc_id takes the key 0. Repeated rows get slots of their own. An empty
    table gives no rows. Other columns are ignored.
    """
    blocks = blocks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    shard, grown = jump_hash(F.coalesce("doc_id", F.lit(0).cast("long")), shards)
    rows = rows.withColumn("both", F.struct(shard.alias("s"), grown.alias("g")))
    rows = rows.select("*", F.col("both.s").alias("shard"), F.col("both.g").alias("grown_shard"), F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.spark_partition_id()), F.lit(blocks)).cast("int").alias("block")).drop("both")
    from pyspark.sql import Window as W

    count = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    # shards x blocks rows at most
    first = count.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("first"))
    own = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("own", own).join(F.broadcast(first), ["shard", "block"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("own") - 1).cast("long").alias("slot"), "grown_shard",
    )
