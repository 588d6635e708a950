"""Enforcement of how much of a row's old image a source must send."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Identity letters, weakest first.
IDENTITIES = {"n": "nothing", "d": "default", "i": "index", "f": "full"}
RANK = {"nothing": 0, "default": 1, "index": 2, "full": 3}


def check(df: DataFrame, tables: dict[str, str], minimum: str = "full", mode: str = "warn") -> DataFrame:
    """mode: warn (marks events), skip (drops those of weak tables), fail (raises if there are any), disabled."""
    if mode == "disabled":
        return df.withColumn("identity_warning", F.lit(False))
    weak = sorted(t for t, i in tables.items() if RANK[IDENTITIES.get(i, i)] < RANK[minimum])
    hit = F.col("table").isin(weak) if weak else F.lit(False)
    if mode == "fail" and not df.where(hit).isEmpty():
        raise ValueError(f"replica identity below {minimum}: {', '.join(weak)}")
    return df.where(~hit).withColumn("identity_warning", F.lit(False)) if mode == "skip" else df.withColumn("identity_warning", hit)
