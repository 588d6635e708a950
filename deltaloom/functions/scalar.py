"""Scalar functions of computed fields, naming and positions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def concat(*parts: Column) -> Column:
    """Nulls count as empty strings."""
    return F.concat(*(text(p) for p in parts))


def json_text(c: Column, kind: str) -> Column:
    """A scalar as JSON text: strings in quotes with escapes, numbers and booleans bare; null for null."""
    if kind == "string":
        return F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{("v":)?', ""), r"\}$", "")
    return c.cast("string")


def json_hash(fields: list[tuple[Column, str]]) -> Column:
    """SHA-256 over the JSON texts of the fields that are present, in order."""
    return F.sha2(F.concat(*(F.coalesce(json_text(c, k), F.lit("")) for c, k in fields)), 256)


def total(*cs: Column) -> Column:
    """Sum as a double; null counts as 0."""
    out = F.lit(0.0)
    for c in cs:
        out = out + F.coalesce(c.cast("double"), F.lit(0.0))
    return out


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """0-based characters, cut off at the end."""
    return F.substring(c, start + 1, 2_147_483_647 if length is None else length)


def conditional(when: Column, then, otherwise) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(then)).otherwise(F.lit(otherwise))


def to_integer(c: Column, kind: str) -> Column:
    """Floats are cut, booleans 0 or 1, strings whole numbers or null."""
    if kind == "string":
        return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("long"))
    if kind in ("float", "double"):
        return F.when(~F.isnan(c), F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("long"))
    return c.cast("int").cast("long") if kind == "boolean" else c.cast("long")


def to_float(c: Column, kind: str) -> Column:
    return F.lit(None).cast("double") if kind == "boolean" else c.try_cast("double")


def to_boolean(c: Column, kind: str) -> Column:
    """Never null: numbers are true unless 0, strings if true, 1 or yes, and null is false."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(F.lower(c).isin("true", "1", "yes"), F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def let(value: Column, use) -> Column:
    """use(value) with value computed once per row, however often use names it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bytes_of(data: Column) -> Column:
    """The bytes of a string (UTF-8) or binary as an array of longs, in linear time."""
    chars = F.split(F.decode(data.cast("binary"), "ISO-8859-1"), "")
    return F.when(F.octet_length(data) > 0, F.transform(chars, lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<long>"))


def _mul32(x: Column, k: int) -> Column:
    """x * k modulo 2^32 on longs; the product goes in two halves, so ANSI arithmetic never overflows."""
    return (x.bitwiseAND(0xFFFF) * F.lit(k) + F.shiftleft((F.shiftright(x, 16) * F.lit(k & 0xFFFF)).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def _mul64(hi: Column, lo: Column, k: int) -> tuple[Column, Column]:
    """(hi, lo) * k modulo 2^64, on 32-bit halves."""
    kh, kl = k >> 32, k & 0xFFFFFFFF
    p0, p1 = lo.bitwiseAND(0xFFFF) * F.lit(kl), F.shiftright(lo, 16) * F.lit(kl)
    low = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16)
    high = F.shiftright(p1, 16) + F.shiftright(low, 32) + _mul32(hi, kl) + _mul32(lo, kh)
    return high.bitwiseAND(0xFFFFFFFF), low.bitwiseAND(0xFFFFFFFF)


# Fixed values of the finalizer: its two multipliers.
FINAL_1, FINAL_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def finalize64(key: Column) -> Column:
    """The 64-bit murmur3 finalizer of a long, as a struct of 32-bit halves hi and lo."""

    def halves(hi: Column, lo: Column) -> Column:
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    def step(h: Column, k: int | None) -> Column:
        lo = h["lo"].bitwiseXOR(F.shiftright(h["hi"], 1))  # h ^ (h >>> 33)
        return halves(h["hi"], lo) if k is None else let(halves(h["hi"], lo), lambda x: halves(*_mul64(x["hi"], x["lo"], k)))

    start = halves(F.shiftrightunsigned(key.cast("long"), 32), key.cast("long").bitwiseAND(0xFFFFFFFF))
    return let(start, lambda a: let(step(a, FINAL_1), lambda b: let(step(b, FINAL_2), lambda c: step(c, None))))


def finalized_partition(key: Column, n: int) -> Column:
    """The finalized key, unsigned, modulo n."""
    return let(finalize64(key), lambda h: (h["hi"] % n * ((1 << 32) % n) + h["lo"] % n) % n).cast("int")


def murmur2(data: Column) -> Column:
    """Unsigned 32-bit murmur2 of a string's UTF-8 bytes or of a binary, as the common log clients use it; a long.

    Built from column functions: the words of 4 bytes are folded by aggregate(), with 32-bit products in two halves.
    """
    m = 0x5BD1E995
    n = F.octet_length(data).cast("long")

    def of(b: Column) -> Column:
        byte = lambda i: F.get(b, i.cast("int"))

        def fold(acc: Column, i: Column) -> Column:
            word = byte(i * 4).bitwiseOR(F.shiftleft(byte(i * 4 + 1), 8)).bitwiseOR(F.shiftleft(byte(i * 4 + 2), 16)).bitwiseOR(F.shiftleft(byte(i * 4 + 3), 24))
            k = let(_mul32(word, m), lambda k: _mul32(k.bitwiseXOR(F.shiftright(k, 24)), m))
            return _mul32(acc, m).bitwiseXOR(k)

        words = F.floor(n / 4).cast("int")
        at = F.when(words > 0, F.sequence(F.lit(0), words - 1)).otherwise(F.array().cast("array<int>"))
        rest, base, zero = n % 4, words * 4, F.lit(0).cast("long")

        def end(h: Column) -> Column:
            tail = F.when(rest >= 3, F.shiftleft(byte(base + 2), 16)).otherwise(zero)
            tail = tail.bitwiseXOR(F.when(rest >= 2, F.shiftleft(byte(base + 1), 8)).otherwise(zero)).bitwiseXOR(F.when(rest >= 1, byte(base)).otherwise(zero))
            h = F.when(rest > 0, _mul32(h.bitwiseXOR(tail), m)).otherwise(h)
            h = let(h, lambda x: _mul32(x.bitwiseXOR(F.shiftright(x, 13)), m))
            return let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 15)))

        return let(F.aggregate(at, F.lit(0x9747B28C).cast("long").bitwiseXOR(n), fold), end)

    return let(bytes_of(data), of)


def murmur2_partition(key: Column, partitions: int) -> Column:
    return (murmur2(key).bitwiseAND(0x7FFFFFFF) % partitions).cast("int")


def fnv1a64(data: Column) -> Column:
    """FNV-1a of a string's bytes, as 16 hex digits: the bytes are folded on 32-bit halves."""
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def fold(h: Column, byte: Column) -> Column:
        # the multiplier is 2^40 + 0x1B3
        low = h["lo"].bitwiseXOR(byte)
        part = low * F.lit(0x1B3)
        high = h["hi"] * F.lit(0x1B3) + F.shiftright(part, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(0xFFFFFFFF).alias("hi"), part.bitwiseAND(0xFFFFFFFF).alias("lo"))

    digits = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.when(data.isNotNull(), F.aggregate(bytes_of(data), start, fold, lambda h: F.concat(digits(h["hi"]), digits(h["lo"]))))


def convert_case(c: Column, how: str) -> Column:
    """none, lower, upper, snake or kebab."""
    if how in ("snake", "kebab"):
        sep = "_" if how == "snake" else "-"
        parted = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", f"$1{sep}$2"), r"([A-Z]+)([A-Z][a-z])", f"$1{sep}$2")
        return F.lower(F.regexp_replace(parted, r"[\s_\-]+", sep))
    return {"lower": F.lower, "upper": F.upper}.get(how, lambda x: x)(c)


TOPIC_BYTES = 249


def normalize_identifier(c: Column, case: str = "none", replacement: str = "_", strip_prefixes=(), strip_suffixes=(), avro: bool = False) -> Column:
    """Strip affixes, convert case, replace what topic names can't hold; Avro names also never start with a digit."""
    for p in strip_prefixes:
        c = F.when(c.startswith(p), F.substring(c, len(p) + 1, 2_147_483_647)).otherwise(c)
    for s in strip_suffixes:
        c = F.when(c.endswith(s), F.substr(c, F.lit(1), F.length(c) - F.lit(len(s)))).otherwise(c)
    c = convert_case(c, case)
    c = F.regexp_replace(c, r"[^A-Za-z0-9_]" if avro else r"[^A-Za-z0-9._\-]", replacement)
    return F.when(c.rlike(r"^\d"), F.concat(F.lit("_"), c)).otherwise(c) if avro else c


def byte_hash31(c: Column) -> Column:
    """h = 31 h + byte, modulo 2^32, over a string's bytes; a long."""
    return F.when(c.isNotNull(), F.aggregate(bytes_of(c), F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(0xFFFFFFFF)))


def topic_name(c: Column) -> Column:
    """A name over 249 bytes keeps its first 240 and ends in _ and 8 hex digits of the whole name's hash."""
    short = F.concat(F.substring(c, 1, TOPIC_BYTES - 9), F.lit("_"), F.lower(F.lpad(F.hex(byte_hash31(c)), 8, "0")))
    return F.when(F.octet_length(c) > TOPIC_BYTES, short).otherwise(c)


PLACEHOLDERS = ("database", "schema", "table")


def topic_template(pattern: str) -> Column:
    """`{database}`, `{schema}` and `{table}` of the event; another placeholder is an error."""
    out = []
    for literal, name in re.findall(r"([^{}]*)(?:\{([^{}]*)\})?", pattern):
        if literal:
            out.append(F.lit(literal))
        if name:
            if name not in PLACEHOLDERS:
                raise ValueError(f"unknown placeholder {name!r}")
            out.append(text(F.col(name)))
    if pattern.count("{") != pattern.count("}") or not out:
        raise ValueError(f"bad pattern {pattern!r}")
    return F.concat(*out)


def prompt_template(template: str, at) -> Column:
    """`{{a.b}}` fields; what does not exist stays empty."""
    parts = re.split(r"\{\{\s*([^{}]+?)\s*\}\}", template)
    return F.concat(*(text(at(p)) if k % 2 else F.lit(p) for k, p in enumerate(parts) if p))


def lsn(c: Column) -> Column:
    """`hi/lo`, both hexadecimal, as one number (decimal, as it may need 64 bits unsigned)."""
    half = lambda k: F.conv(F.element_at(F.split(c, "/"), k), 16, 10).cast("decimal(20,0)")
    return (half(1) * F.lit(4294967296).cast("decimal(20,0)") + half(2)).cast("decimal(20,0)")


def binlog_position(file: Column, position: Column) -> Column:
    """A binlog file's number and the position in it as one number that grows along the log; null without a number."""
    return F.when(file.rlike(r"\.\d+$"), F.shiftleft(F.regexp_extract(file, r"\.(\d+)$", 1).cast("long"), 32) + position.cast("long"))


def gtid_ranges(c: Column) -> Column:
    """`uuid:1-5:9,uuid:3` as an array of (source, first, last)."""
    sets = F.filter(F.split(F.regexp_replace(c, r"\s", ""), ","), lambda x: x != "")
    one = lambda s, r: F.struct(F.lower(F.element_at(F.split(s, ":"), 1)).alias("source"), F.element_at(F.split(r, "-"), 1).cast("long").alias("first"), F.element_at(F.split(r, "-"), -1).cast("long").alias("last"))
    return F.flatten(F.transform(sets, lambda s: F.transform(F.slice(F.split(s, ":"), 2, 1 << 30), lambda r: one(s, r))))


def gtid_holds(ranges: Column, source: Column, number: Column) -> Column:
    return F.exists(ranges, lambda r: (r["source"] == F.lower(source)) & (number >= r["first"]) & (number <= r["last"]))


# Statements and their kinds, in the order in which they are tried. The first ones count at the statement's
# start or after a blank within it, "inside" only within it, "start" only at its start.
DDL_KINDS = (
    ("CREATE TABLE", "create", "both"),
    ("ALTER TABLE", "alter", "both"),
    ("DROP TABLE", "drop", "both"),
    ("TRUNCATE", "truncate", "both"),
    ("RENAME TABLE", "rename", "both"),
    ("RENAME TO", "rename", "inside"),
    ("CREATE INDEX", "create_index", "both"),
    ("CREATE UNIQUE INDEX", "create_index", "start"),
    ("DROP INDEX", "drop_index", "both"),
)


def ddl_kind(c: Column) -> Column:
    """create, alter, drop, truncate, rename, create_index, drop_index, or other."""
    s, out = F.upper(F.trim(c)), F
    for words, kind, where in DDL_KINDS:
        test = s.startswith(words) if where != "inside" else F.lit(False)
        out = out.when(test if where == "start" else test | s.contains(f" {words}"), kind)
    return out.otherwise("other")


def epoch_millis(c: Column, kind: str) -> Column:
    """RFC 3339, `Y-m-d H:M:S`, `Y-m-dTH:M:S`, or a number (over 1e12: milliseconds, else seconds); else null."""
    if kind != "string":
        return F.when(c.cast("long") > 1_000_000_000_000, c.cast("long")).otherwise(c.cast("long") * 1000)
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
    return F.when(c.rlike(shape), F.unix_millis(F.try_to_timestamp(c)))


def format_time(ms: Column, how: str) -> Column:
    """iso, epoch_s, epoch_ms, epoch_us, date or time, in UTC."""
    at = F.timestamp_millis(ms)
    return {
        "iso": lambda: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "epoch_s": lambda: F.floor(ms / 1000),
        "epoch_ms": lambda: ms,
        "epoch_us": lambda: ms * 1000,
        "date": lambda: F.date_format(at, "yyyy-MM-dd"),
        "time": lambda: F.date_format(at, "HH:mm:ss"),
    }[how]()


# Strftime fields and the Java patterns for them.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%Z": "zzz", "%z": "xx", "%%": "'%'"}


def java_pattern(fmt: str) -> str:
    out = []
    for part in re.findall(r"%.|[^%]+", fmt):
        if part[0] == "%":
            if part not in STRFTIME:
                raise ValueError(f"unknown time field {part!r}")
            out.append(STRFTIME[part])
        else:
            out.append("".join(f"'{x}'" if x.isalpha() else x.replace("'", "''") for x in part))
    return "".join(out)


def to_zone(local: Column, source: str, target: str, fmt: str | None = None) -> Column:
    """A naive local time string in `source` as text in `target`; a time that the clock skips or repeats stays as it is."""
    utc = F.to_utc_timestamp(F.try_to_timestamp(local), source)
    naive = F.try_to_timestamp(local)
    skipped = F.from_utc_timestamp(utc, source) != naive
    repeated = any_shift_equal(utc, source, naive)
    out = F.date_format(F.from_utc_timestamp(utc, target), java_pattern(fmt) if fmt else "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(naive.isNull() | skipped | repeated, local).otherwise(out)


def any_shift_equal(utc: Column, zone: str, naive: Column) -> Column:
    """Whether another moment an hour off has the same local time."""
    hour = F.expr("interval 1 hour")
    return (F.from_utc_timestamp(utc + hour, zone) == naive) | (F.from_utc_timestamp(utc - hour, zone) == naive)
