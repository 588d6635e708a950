"""Two-valued predicates over the row image: a missing or null field is false (true for "not equal"), never unknown."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the regular-expression dialects of the change-event tools lack, and Java has.
_FOREIGN = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+")


def field(name: str) -> Column:
    """The field of after, or of before where there is no after (not field by field)."""
    return F.when(F.col("after").isNotNull(), F.col(f"after.{name}")).otherwise(F.col(f"before.{name}"))


def equals(c: Column, value) -> Column:
    return c.eqNullSafe(F.lit(value))


def not_equals(c: Column, value) -> Column:
    return ~c.eqNullSafe(F.lit(value))


def is_null(c: Column) -> Column:
    return c.isNull()


def is_not_null(c: Column) -> Column:
    return c.isNotNull()


def portable(pattern: str) -> str | None:
    """The pattern, or None where it is broken or uses look-around, back-references or possessive repeats."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    return None if _FOREIGN.search(pattern) else pattern


def matches(c: Column, pattern: str) -> Column:
    """Unanchored; a bad pattern is false."""
    ok = portable(pattern)
    return F.lit(False) if ok is None else F.coalesce(c.cast("string").rlike(ok), F.lit(False))


def one_of(c: Column, values) -> Column:
    values = list(values)
    return F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(False)


def all_of(*p: Column) -> Column:
    out = F.lit(True)
    for x in p:
        out = out & F.coalesce(x, F.lit(False))
    return out


def any_of(*p: Column) -> Column:
    out = F.lit(False)
    for x in p:
        out = out | F.coalesce(x, F.lit(False))
    return out


def negate(p: Column) -> Column:
    return ~F.coalesce(p, F.lit(False))


def contains(c: Column, s: str) -> Column:
    return F.coalesce(c.contains(s), F.lit(False))


def starts_with(c: Column, s: str) -> Column:
    return F.coalesce(c.startswith(s), F.lit(False))


def ends_with(c: Column, s: str) -> Column:
    return F.coalesce(c.endswith(s), F.lit(False))


def parse(text: str, at=field) -> Column:
    """`field op value`: = == != <> matches in is_null is_not_null; the null checks may do without a value."""
    parts = text.split(None, 2)
    if len(parts) < 2 or (len(parts) == 2 and parts[1].lower() not in ("is_null", "is_not_null")):
        raise ValueError(f"no condition: {text!r}")
    c, op, value = at(parts[0]), parts[1].lower(), (parts[2] if len(parts) > 2 else "").strip().strip("'\"")
    if op in ("=", "=="):
        return equals(c.cast("string"), value)
    if op in ("!=", "<>"):
        return not_equals(c.cast("string"), value)
    if op == "matches":
        return matches(c, value)
    if op == "in":
        return one_of(c.cast("string"), [v.strip().strip("'\"") for v in value.strip("[]()").split(",")])
    if op in ("is_null", "is_not_null"):
        return is_null(c) if op == "is_null" else is_not_null(c)
    raise ValueError(f"unknown operator {op!r}")


def glob(pattern: str, ignore_case: bool = True) -> str:
    """`*` and `?` as a whole-string regular expression."""
    body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return f"{'(?is)' if ignore_case else '(?s)'}\\A{body}\\z"


def glob_match(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.coalesce(c.rlike(glob(pattern, ignore_case)), F.lit(False))


def table_match(patterns, schema: Column | None = None, name: Column | None = None) -> Column:
    """Any pattern fits `schema.table`, or, where it has no dot, the bare table."""
    schema, name = F.col("schema") if schema is None else schema, F.col("table") if name is None else name
    full = F.concat_ws(".", schema, name)
    return any_of(*(any_of(glob_match(full, p), glob_match(name, p)) if "." not in p else glob_match(full, p) for p in patterns))


def affix_match(c: Column, pattern: str) -> Column:
    """A router's table pattern: `prefix*`, `*suffix`, or the whole name."""
    if pattern.endswith("*"):
        return starts_with(c, pattern[:-1])
    return ends_with(c, pattern[1:]) if pattern.startswith("*") else equals(c, pattern)


def when_event(*, table: str | None = None, schema: str | None = None, ops=None, field_equals=None, field_exists: str | None = None, negated: bool = False) -> Column:
    """A condition on the event for conditional transforms; what is not given does not restrict."""
    p = []
    if table is not None:
        p.append(matches(F.col("table"), table))
    if schema is not None:
        p.append(matches(F.col("schema"), schema))
    if ops is not None:
        p.append(one_of(F.col("op"), ops))
    if field_equals is not None:
        p.append(equals(field(field_equals[0]), field_equals[1]))
    if field_exists is not None:
        p.append(is_not_null(field(field_exists)))
    return negate(all_of(*p)) if negated else all_of(*p)
