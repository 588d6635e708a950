"""Sketches as tables: Bloom, counting and offset filters, and HyperLogLog registers. All of them merge by one aggregate.

Hashes are the hexadecimal digits of a key's MD5, so any other engine can build and probe the same sketch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A filter of up to so many words (8 bytes each) goes to its probes as one array; a larger one is joined.
ARRAY_WORDS = 1 << 20
#: Offsets that a range probe tests one by one; a longer range is tested by its buckets.
FEW_OFFSETS = 10


@dataclass
class Bloom:
    words: DataFrame
    bits: int
    hashes: int

    def fill_ratio(self) -> float:
        return (self.words.agg(F.sum(F.bit_count("bits"))).first()[0] or 0) / self.bits

    def false_positive_rate(self) -> float:
        return self.fill_ratio() ** self.hashes


def shape(items: int, rate: float) -> tuple[int, int]:
    """Bits, rounded up to 64, and hashes, 1 to 16, for so many items at a false-positive rate."""
    m = -(-max(1, math.ceil(-items * math.log(rate) / math.log(2) ** 2)) // 64) * 64
    return m, min(16, max(1, round(m / max(items, 1) * math.log(2))))


def digits(key: Column, first: int, count: int) -> Column:
    """Hexadecimal digits of the MD5 of the key's text, as a long; count: 15 at most."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), first, count), 16, 10).cast("long")


def places(key: Column, bits: int, hashes: int) -> Column:
    """The distinct places of a key: (a + k * b) modulo bits, a and b from the first two 15-digit parts of its MD5."""
    a, b = digits(key, 1, 15) % bits, digits(key, 16, 15).bitwiseOR(1) % bits
    return F.array_distinct(F.array(*((a + k * b) % bits for k in range(hashes))))


def bloom(df: DataFrame, key: Column, items: int, rate: float) -> Bloom:
    """Words are or-ed before and after the shuffle: a task sends each word once at most, whatever its rows."""
    bits, hashes = shape(items, rate)
    at = df.select(F.explode(places(key, bits, hashes)).alias("p"))
    mask = F.expr("shiftleft(1L, cast(p % 64 as int))")
    return Bloom(at.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(mask).alias("bits")), bits, hashes)


def merge(a: Bloom, b: Bloom) -> Bloom:
    if (a.bits, a.hashes) != (b.bits, b.hashes):
        raise ValueError("filters of different shapes")
    return Bloom(a.words.unionAll(b.words).groupBy("word").agg(F.bit_or("bits").alias("bits")), a.bits, a.hashes)


def as_array(sketch: Bloom) -> Column:
    """All words of a filter of bounded size as one array, in a scalar subquery."""
    of = sketch.words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("w"))
    each = lambda k: F.coalesce(F.col("w")[k.cast("long")], F.lit(0).cast("long"))
    return of.select(F.transform(F.sequence(F.lit(0), F.lit(sketch.bits // 64 - 1)), each)).scalar()


def _held(at: Column, words: Column) -> Column:
    return F.forall(at, lambda p: F.coalesce(F.get(words, F.floor(p / 64).cast("int")), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0)


def might_contain(df: DataFrame, key: str, sketch: Bloom) -> DataFrame:
    """df with might_contain. A filter of bounded size is an array that each row tests; a larger one is joined word by word."""
    if sketch.bits // 64 <= ARRAY_WORDS:
        return df.withColumn("_w", as_array(sketch)).withColumn("might_contain", _held(places(F.col(key), sketch.bits, sketch.hashes), F.col("_w"))).drop("_w")
    p = df.select(key).distinct().select(key, F.explode(places(F.col(key), sketch.bits, sketch.hashes)).alias("p"))
    p = p.select(key, F.floor(F.col("p") / 64).alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("mask"))
    got = p.join(sketch.words, "word", "left").groupBy(key).agg(F.bool_and(F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) != 0, F.lit(False))).alias("might_contain"))
    return df.join(got, key, "left")


def counting(df: DataFrame, key: Column, items: int, rate: float, sign: Column | None = None) -> DataFrame:
    """(place, n): a counting filter; sign -1 removes. A key is held while all its places count above 0."""
    bits, hashes = shape(items, rate)
    at = df.select(F.explode(places(key, bits, hashes)).alias("place"), (F.lit(1) if sign is None else sign).alias("s"))
    return at.groupBy("place").agg(F.greatest(F.sum("s"), F.lit(0)).alias("n")).where("n > 0")


def counted(df: DataFrame, key: str, counters: DataFrame, items: int, rate: float) -> DataFrame:
    """df with might_contain against a counting filter of that shape."""
    p = df.select(key).distinct().select(key, F.explode(places(F.col(key), *shape(items, rate))).alias("place"))
    got = p.join(counters, "place", "left").groupBy(key).agg(F.bool_and(F.coalesce(F.col("n") > 0, F.lit(False))).alias("might_contain"))
    return df.join(got, key, "left")


@dataclass
class OffsetBloom:
    """A Bloom filter of offsets with their least and greatest, and one of their buckets for ranges."""

    offsets: Bloom
    buckets: Bloom
    least: int
    most: int
    bucket_size: int


def offset_bloom(df: DataFrame, offset: str, items: int, bucket_size: int = 1000, rate: float = 0.01) -> OffsetBloom:
    ends = df.agg(F.min(offset).alias("a"), F.max(offset).alias("b")).first()
    buckets = df.select(F.floor(F.col(offset) / bucket_size).alias("b")).distinct()
    return OffsetBloom(bloom(df, F.col(offset), items, rate), bloom(buckets, F.col("b"), max(1, items // bucket_size), rate), ends["a"], ends["b"], bucket_size)


def might_hold_range(ranges: DataFrame, start: str, end: str, sketch: OffsetBloom) -> DataFrame:
    """ranges with might_contain: whether an offset of start..end, ends included, may be among those added.

    Outside the least and greatest offset nothing is. A range of FEW_OFFSETS more at most is tested offset by offset, a
    longer one bucket by bucket.
    """
    lo, hi = F.greatest(F.col(start), F.lit(sketch.least)), F.least(F.col(end), F.lit(sketch.most))
    each = lambda a, b, f, w: F.exists(F.sequence(a.cast("long"), b.cast("long")), lambda x: _held(places(x, f.bits, f.hashes), F.col(w)))
    size = sketch.bucket_size
    few = F.col(end) - F.col(start) <= FEW_OFFSETS
    held = F.when(lo > hi, False).when(few, each(lo, hi, sketch.offsets, "_w")).otherwise(each(F.floor(lo / size), F.floor(hi / size), sketch.buckets, "_b"))
    return ranges.withColumns({"_w": as_array(sketch.offsets), "_b": as_array(sketch.buckets)}).withColumn("might_contain", held).drop("_w", "_b")


def registers(df: DataFrame, key: Column, precision: int = 12, by: list[str] = ()) -> DataFrame:
    """HyperLogLog: (by..., register, rank), at most 2^precision rows a group. precision: a multiple of 4, 16 at most.

    The first digits of the key's MD5 are the register, the next 13 (52 bits) give the rank: leading zeros and one.
    """
    at = df.where(key.isNotNull()).select(*by, digits(key, 1, precision // 4).alias("register"), digits(key, 1 + precision // 4, 13).alias("_x"))
    rank = F.when(F.col("_x") > 0, 53 - F.length(F.bin("_x"))).otherwise(53)
    return at.groupBy(*by, "register").agg(F.max(rank).alias("rank"))


def merge_registers(regs: DataFrame) -> DataFrame:
    return regs.groupBy("register").agg(F.max("rank").alias("rank"))


def cardinality(regs: DataFrame, precision: int = 12) -> DataFrame:
    """(estimate): the harmonic mean of the registers; few distinct keys are counted by the empty registers instead."""
    m = 1 << precision
    got = regs.agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("n"))
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.coalesce("s", F.lit(0.0)) + (m - F.col("n")))
    few = F.lit(float(m)) * F.log(F.lit(float(m)) / (m - F.col("n")))
    return got.select(F.round(F.when((raw <= 2.5 * m) & (F.col("n") < m), few).otherwise(raw)).cast("long").alias("estimate"))
