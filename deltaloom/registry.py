"""The table of queries and their SQL, filled by the modules in plans/."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Change events over the driver's events, as the first part of a WITH.
EV = """ev as (
  select event_id, epoch_us(ts) as ts, user_id, event_type, value, props, epoch_us(ts) // 1000000 as ts_s,
    case event_type when 'signup' then 'c' when 'error' then 'd' else 'u' end as op
  from events)"""
LOG = """lg as (
  select event_id, epoch_us(ts) as timestamp, user_id as key, cast(user_id % 4 as integer) as partition,
    case when event_type = 'error' then '' else props end as value, user_id % 5 as producer_id,
    row_number() over (partition by user_id % 4 order by ts, event_id) - 1 as offset
  from events)"""
ORD = """od as (
  select *, case o_orderstatus when 'O' then 'c' when 'F' then 'd' else 'u' end as op, epoch_us(o_orderdate) // 1000000 as ts_s
  from orders)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql.replace("{EV}", EV).replace("{LOG}", LOG).replace("{ORD}", ORD)
        return f

    return add
