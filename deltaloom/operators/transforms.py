"""Record transforms: functions from change events to change events. Each builds one struct per image, however many fields change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions import predicates as P
from deltaloom.functions import scalar as S

Transform = Callable[[DataFrame], DataFrame]
Fields = dict[str, Column]
BOTH, AFTER = ("before", "after"), ("after",)


def fields_of(df: DataFrame, image: str) -> Fields:
    return {f.name: F.col(f"{image}.`{f.name}`") for f in df.schema[image].dataType}


def kinds_of(df: DataFrame, image: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema[image].dataType}


def rewrite(df: DataFrame, fn: Callable[[Fields, dict[str, str]], Fields], images=AFTER) -> DataFrame:
    """Replace the fields of the images by what fn makes of them; an absent image stays absent."""
    new = {}
    for im in images:
        made = fn(fields_of(df, im), kinds_of(df, im))
        new[im] = F.when(F.col(im).isNotNull(), F.struct(*(c.alias(n) for n, c in made.items())))
    return df.withColumns(new)


def chain(*steps: Transform) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def apply_when(condition: Column, fn: Callable[[Fields, dict[str, str]], Fields], images=AFTER, unless: bool = False) -> Transform:
    """A field transform that keeps the set of fields, where the condition holds (or does not)."""

    def run(df: DataFrame) -> DataFrame:
        hold = P.negate(condition) if unless else F.coalesce(condition, F.lit(False))
        marked = df.withColumn("_hold", hold)

        def pick(c: Fields, k: dict[str, str]) -> Fields:
            made = fn(dict(c), k)
            return {n: F.when(F.col("_hold"), made[n]).otherwise(c[n]) for n in c if n in made} | {n: F.when(F.col("_hold"), v) for n, v in made.items() if n not in c}

        return rewrite(marked, pick, images).drop("_hold")

    return run


def drop_when(condition: Column, drops: Column) -> Transform:
    """A transform that drops events, applied conditionally."""
    return lambda df: df.where(~(F.coalesce(condition, F.lit(False)) & F.coalesce(drops, F.lit(False))))


def extract_new_state(deletes: str = "none", drop_tombstones: bool = False, op=False, table=False, schema=False, ts=False, prefix: str = "__") -> Transform:
    """deletes: none, drop or rewrite (before becomes after, with __deleted = true). Envelope fields go into after."""

    def run(df: DataFrame) -> DataFrame:
        if drop_tombstones or deletes == "drop":
            df = df.where("op <> 'd'")
        image = F.col("after")
        flag: Fields = {}
        if deletes == "rewrite" and not drop_tombstones:
            image = F.when(F.col("op") == "d", F.coalesce("before", "after")).otherwise(F.col("after"))
            flag = {"__deleted": F.when((F.col("op") == "d") & F.col("before").isNotNull(), True)}
        extra = dict(flag)
        for on, name, c in ((op, "op", "op"), (table, "table", "table"), (schema, "schema", "schema")):
            if on:
                extra[prefix + name] = F.col(c)
        if ts:
            extra[prefix + "ts_ms"] = F.col("ts_s") * 1000
        df = df.withColumn("after", image)
        return rewrite(df, lambda c, k: c | extra)

    return run


def value_to_key(keys: list[str]) -> Transform:
    """__key in after: the named fields that exist; nothing where none does."""

    def run(df: DataFrame) -> DataFrame:
        have = [k for k in keys if k in fields_of(df, "after")]
        return rewrite(df, lambda c, k: c | {"__key": F.struct(*(c[n].alias(n) for n in have))}) if have else df

    return run


def replace_fields(renames: dict[str, str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> Transform:
    """Renames first, then include, then exclude; both lists refer to new names."""

    def fn(c: Fields, _) -> Fields:
        named = {(renames or {}).get(n, n): v for n, v in c.items()}
        if include:
            named = {n: v for n, v in named.items() if n in include}
        return {n: v for n, v in named.items() if n not in (exclude or ())}

    return lambda df: rewrite(df, fn, BOTH)


def insert_fields(static: dict | None = None, copies: dict[str, str] | None = None, now: str | None = None, today: str | None = None) -> Transform:
    """Copies read the record before anything is inserted; a missing source gives null."""

    def fn(c: Fields, _) -> Fields:
        new: Fields = {n: F.lit(v) for n, v in (static or {}).items()}
        if now:
            new[now] = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
        if today:
            new[today] = F.date_format(F.current_date(), "yyyy-MM-dd")
        for n, source in (copies or {}).items():
            new[n] = c.get(source, F.lit(None).cast("string"))
        return c | new

    return lambda df: rewrite(df, fn)


def flatten(delimiter: str = ".", max_depth: int = 0) -> Transform:
    """Nested structs to dotted names; arrays and maps stay; an empty struct vanishes."""

    def walk(kind: T.StructType, at: Column, prefix: str, depth: int) -> Fields:
        out: Fields = {}
        for f in kind:
            name, c = prefix + f.name, at.getField(f.name)
            if isinstance(f.dataType, T.StructType) and (max_depth == 0 or depth < max_depth):
                out |= walk(f.dataType, c, name + delimiter, depth + 1)
            else:
                out[name] = c
        return out

    def run(df: DataFrame) -> DataFrame:
        return df.withColumns({im: F.when(F.col(im).isNotNull(), F.struct(*(c.alias(n) for n, c in walk(df.schema[im].dataType, F.col(im), "", 1).items()))) for im in BOTH})

    return run


HEADERS = {"source_type": "source_type", "database": "database", "schema": "schema", "table": "table", "op": "op", "timestamp": "ts_s", "transaction_id": "txn.id"}


def header_to_value(targets: dict[str, str] | None = None, prefix: str | None = None) -> Transform:
    """target field -> header name; prefix: all headers. Headers are always copied."""
    wanted = dict(targets or {}) | ({prefix + h: h for h in HEADERS} if prefix is not None else {})
    return lambda df: rewrite(df, lambda c, k: c | {n: F.col(HEADERS[h]) for n, h in wanted.items()})


def unwrap(path: str, merge: bool = False) -> Transform:
    """Replace after by the struct at a dotted path, or merge its fields into after. A path that does not exist changes nothing."""

    def run(df: DataFrame) -> DataFrame:
        kind, at = df.schema["after"].dataType, F.col("after")
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return df
            kind, at = kind[part].dataType, at.getField(part)
        if not isinstance(kind, T.StructType):
            return df
        inner = {f.name: at.getField(f.name) for f in kind}
        if merge:
            return rewrite(df, lambda c, k: {n: v for n, v in c.items() if n != path} | inner)
        return df.withColumn("after", F.when(F.col("after").isNotNull(), F.struct(*(c.alias(n) for n, c in inner.items()))))

    return run


def set_null(names: list[str], when: str = "always", value=None) -> Transform:
    """when: always, empty, equals or matches."""

    def fn(c: Fields, _) -> Fields:
        def test(x: Column) -> Column:
            return {"always": lambda: F.lit(True), "empty": lambda: P.equals(x.cast("string"), ""), "equals": lambda: P.equals(x, value), "matches": lambda: P.matches(x, value)}[when]()

        return {n: F.when(~test(v), v) if n in names else v for n, v in c.items()}

    return lambda df: rewrite(df, fn)


# Fixed values of masking.
STARS = 20
REDACTED, MASKED = "***REDACTED***", "***MASKED***"


def mask_value(c: Column, kind: str, how: str, fixed: str = "***", first: int = 2, last: int = 2) -> Column:
    """fixed, asterisks (as many as bytes, 20 at most), hash (SHA-256 of the JSON text), partial or null."""
    if how == "null":
        return F.lit(None).cast(kind)
    if how == "fixed":
        return F.when(c.isNotNull(), F.lit(fixed))
    if how == "asterisks":
        return F.when(c.isNotNull(), F.expr(f"repeat('*', {STARS})").substr(F.lit(1), F.least(F.octet_length(c), F.lit(STARS))) if kind == "string" else F.lit("****"))
    if how == "hash":
        return F.when(c.isNotNull(), F.sha2(S.json_text(c, kind), 256))
    if how == "partial":
        if kind != "string":
            return F.when(c.isNotNull(), F.lit("****"))
        n, chars = F.octet_length(c), F.char_length(c)
        stars = F.rpad(F.lit(""), n - (first + last), "*")
        whole = F.rpad(F.lit(""), n, "*")
        return F.when(n <= first + last, whole).otherwise(F.concat(F.substring(c, 1, first), stars, F.substr(c, F.greatest(chars - last + 1, F.lit(1)))))
    raise ValueError(how)


def mask_fields(names: list[str], how: str = "fixed", images=BOTH, **args) -> Transform:
    """redact removes the fields; else see mask_value."""

    def fn(c: Fields, kinds) -> Fields:
        if how == "redact":
            return {n: v for n, v in c.items() if n not in names}
        return {n: mask_value(v, kinds[n], how, **args) if n in names else v for n, v in c.items()}

    return lambda df: rewrite(df, fn, images)


def convert_times(names: list[str], how: str) -> Transform:
    """Times to iso, epoch_s, epoch_ms, epoch_us, date or time; what can't be read stays (as text where the type changes)."""

    def fn(c: Fields, kinds) -> Fields:
        def one(v: Column, kind: str) -> Column:
            ms = S.epoch_millis(v, kind)
            out = S.format_time(ms, how)
            number = how.startswith("epoch")
            if number == (kind != "string"):
                return F.coalesce(out, v)
            return F.coalesce(out.cast("string"), v.cast("string"))

        return {n: one(v, kinds[n]) if n in names else v for n, v in c.items()}

    return lambda df: rewrite(df, fn, BOTH)


def convert_zone(names: list[str], source: str, target: str, fmt: str | None = None) -> Transform:
    return lambda df: rewrite(df, lambda c, k: {n: S.to_zone(v, source, target, fmt) if n in names else v for n, v in c.items()}, BOTH)


def cast_fields(to: dict[str, str]) -> Transform:
    """string, integer, float, boolean or json."""

    def one(v: Column, kind: str, how: str) -> Column:
        if how == "string":
            return v.cast("string") if not kind.startswith(("struct", "array", "map")) else F.to_json(v)
        if how == "json":
            return F.try_parse_json(v) if kind == "string" else v
        return {"integer": S.to_integer, "float": S.to_float, "boolean": S.to_boolean}[how](v, kind)

    return lambda df: rewrite(df, lambda c, k: {n: one(v, k[n], to[n]) if n in to else v for n, v in c.items()}, BOTH)


def compute(**targets) -> Transform:
    """New fields of after, in order; each is a function of the fields so far, so later ones see earlier ones."""

    def fn(c: Fields, _) -> Fields:
        out = dict(c)
        for n, make in targets.items():
            out[n] = make(out)
        return out

    return lambda df: rewrite(df, fn)


def externalize(names: list[str] | None, threshold: int = 10 * 1024, scheme: str = "blob://store") -> Transform:
    """Strings of `threshold` bytes or more become (externalized, url, size, sha256) beside the shortened field.

    The url holds the content's hash, so writing the blob twice writes the same object. See blobs() for what to write.
    """

    def fn(c: Fields, kinds) -> Fields:
        out: Fields = {}
        for n, v in c.items():
            if kinds[n] == "string" and (not names or n in names):
                big = F.coalesce(F.octet_length(v) >= threshold, F.lit(False))
                digest = F.sha2(v, 256)
                out[n] = F.when(~big, v)
                out[f"{n}__ref"] = F.when(big, F.struct(F.lit(True).alias("externalized"), F.concat(F.lit(f"{scheme}/"), digest).alias("url"), F.octet_length(v).alias("size"), F.lit("text/plain").alias("content_type"), digest.alias("sha256")))
            else:
                out[n] = v
        return out

    return lambda df: rewrite(df, fn)


def blobs(df: DataFrame, name: str, threshold: int = 10 * 1024) -> DataFrame:
    """(sha256, content) of the values that externalize() takes out of a field."""
    v = F.col(f"after.{name}")
    return df.where(F.octet_length(v) >= threshold).select(F.sha2(v, 256).alias("sha256"), v.alias("content")).dropDuplicates(["sha256"])


def normalize_snapshot() -> Transform:
    return lambda df: df.withColumn("op", F.when(F.col("op") == "r", "c").otherwise(F.col("op")))


def only_ops(ops: list[str]) -> Transform:
    return lambda df: df.where(P.one_of(F.col("op"), ops))


def exclude_tables(patterns: list[str]) -> Transform:
    return lambda df: df.where(P.negate(P.table_match(patterns)))


def table_filter(include=None, exclude=None, drop_columns=(), mask_columns=(), table_columns: dict | None = None, only: dict | None = None) -> Transform:
    """Tables by globs (exclude wins), then columns: dropped or masked everywhere, then per table; names ignore case."""
    drops, masks = {c.lower() for c in drop_columns}, {c.lower() for c in mask_columns}

    def run(df: DataFrame) -> DataFrame:
        if include:
            df = df.where(P.table_match(include))
        if exclude:
            df = df.where(P.negate(P.table_match(exclude)))

        def fn(c: Fields, kinds) -> Fields:
            out: Fields = {}
            for n, v in c.items():
                low = n.lower()
                if low in drops:
                    continue
                if low in masks:
                    out[n] = F.when(v.isNotNull(), F.lit(REDACTED))
                    continue
                for t, cols in (table_columns or {}).items():
                    if low in {x.lower() for x in cols}:
                        v = F.when(~P.table_match([t]), v)
                for t, cols in (only or {}).items():
                    if low not in {x.lower() for x in cols}:
                        v = F.when(~P.table_match([t]), v)
                out[n] = v
            return out

        return rewrite(df, fn, BOTH)

    return run


def to_source_event(df: DataFrame) -> DataFrame:
    """Connector events: insert (also snapshots), update, delete; truncates and schema changes go."""
    kind = F.when(F.col("op").isin("c", "r"), "insert").when(F.col("op") == "u", "update").when(F.col("op") == "d", "delete")
    out = df.select(kind.alias("event_type"), F.concat_ws(".", "schema", "table").alias("stream"), F.col("schema").alias("namespace"), F.col("ts_s").alias("timestamp"), F.struct("before", "after").alias("data"), "seq", F.col("txn.id").alias("transaction_id"))
    return out.where("event_type is not null")


def runner_step(kind: str, *args) -> Callable[[DataFrame], DataFrame]:
    """A source runner's step over connector events: filter_type keeps kinds, filter_stream keeps streams, rename renames a
    column, add adds a constant. An unknown name is an error."""
    steps = {
        "filter_type": lambda df: df.where(F.col("event_type").isin(list(args))),
        "filter_stream": lambda df: df.where(F.col("stream").isin(list(args))),
        "rename": lambda df: df.withColumnRenamed(*args),
        "add": lambda df: df.withColumn(args[0], F.lit(args[1])),
    }
    if kind not in steps:
        raise ValueError(f"unknown step {kind!r}")
    return steps[kind]


def run_steps(df: DataFrame, steps: list[tuple]) -> DataFrame:
    for step in steps:
        df = runner_step(*step)(df)
    return df


def map_batch(df: DataFrame, **columns: Column) -> DataFrame:
    """Records with columns computed anew; a record batch's map."""
    return df.withColumns(columns)


def filter_batch(df: DataFrame, keep: Column) -> DataFrame:
    """Records that a test holds for; null counts as no."""
    return df.where(F.coalesce(keep, F.lit(False)))


def accessors(df: DataFrame) -> DataFrame:
    """df with is_insert, is_update, is_delete, is_snapshot, is_data, is_tombstone, and size: bytes of the images as JSON."""
    op = F.col("op")
    images = F.coalesce(F.octet_length(F.to_json("before")), F.lit(0)) + F.coalesce(F.octet_length(F.to_json("after")), F.lit(0))
    return df.withColumns({"is_insert": op == "c", "is_update": op == "u", "is_delete": op == "d", "is_snapshot": op == "r", "is_data": op.isin("c", "u", "d", "r"), "is_tombstone": F.col("before").isNull() & F.col("after").isNull(), "size": images})


def cloud_event(events: DataFrame, source: str) -> DataFrame:
    return events.select(F.lit("1.0").alias("specversion"), F.concat(F.lit("change."), F.col("event_type")).alias("type"), F.lit(source).alias("source"), F.col("stream").alias("subject"), F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.to_json("data").alias("data"), "seq")


def encrypt_fields(names: list[str], key: str, key_id: str, deterministic: bool = False) -> Transform:
    """AES-256-GCM, base64 of nonce, ciphertext and tag. Deterministic: the nonce comes from a keyed hash of the value."""

    def fn(c: Fields, _) -> Fields:
        aad = F.lit(f"field:{key_id}")

        def one(v: Column) -> Column:
            v = v.cast("string")
            if not deterministic:
                return F.base64(F.aes_encrypt(v, F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), aad))
            nonce = F.substring(F.unhex(hmac_sha256(key, v)), 1, 12)
            return F.base64(F.aes_encrypt(v, F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), nonce, aad))

        return {n: one(v) if n in names else v for n, v in c.items()}

    return lambda df: rewrite(df, fn, BOTH)


def decrypt_fields(names: list[str], key: str, key_id: str) -> Transform:
    aad = F.lit(f"field:{key_id}")
    return lambda df: rewrite(df, lambda c, k: {n: F.aes_decrypt(F.unbase64(v), F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string") if n in names else v for n, v in c.items()}, BOTH)


def hmac_sha256(key: str, v: Column) -> Column:
    """Hexadecimal HMAC-SHA256 under a key of up to 64 bytes given in hexadecimal."""
    raw = bytes.fromhex(key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), v.cast("binary")), 256))), 256)
