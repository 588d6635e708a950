"""Small files and folders in whatever store Spark's paths name."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no folder; checksum files are left out."""
    fs, p = _at(spark, path)
    return [n for n in (f.getPath().getName() for f in fs.listStatus(p)) if not n.endswith(".crc")] if fs.exists(p) else []


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False where there is one already."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def content(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def rename(spark: SparkSession, old: str, new: str) -> bool:
    fs, p = _at(spark, old)
    return fs.rename(p, _at(spark, new)[1])


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
