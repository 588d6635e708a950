"""Blocks of dense offsets: plans of a new session, and the blocks themselves."""

from __future__ import annotations

import bisect
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

FIRST = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["r08_subject_naming"](s, "/root/testdata/sf0.01").count())
"""


def test_subject_naming_as_first_query_of_a_session():
    run = subprocess.run([sys.executable, "-c", FIRST], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=300)
    assert "ROWS 4" in run.stdout, run.stderr[-2000:]


def test_bounds_below(spark):
    from deltaloom.operators.offsets import bounds_below

    bounds, rows = [-5, 0, 1, 7, 7_000_000_000], [None, -6, -5, -4, 0, 1, 2, 7, 8, 7_000_000_000, 7_000_000_001]
    for n in range(len(bounds) + 1):
        got = spark.createDataFrame([(x,) for x in rows], "x long").select("x", bounds_below(F.col("x"), bounds[:n]).alias("b")).collect()
        assert [r["b"] for r in got] == [0 if x is None else bisect.bisect_left(bounds[:n], x) for x in rows]
