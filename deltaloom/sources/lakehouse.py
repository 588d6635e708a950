"""Tables of Parquet files under a transaction log in the open Delta format: append, overwrite, read a version."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.sources.files import create, names

LOG = "_delta_log"
ACTION = "add struct<path: string, size: long, partitionValues: map<string, string>>, remove struct<path: string>, metaData struct<id: string, schemaString: string, partitionColumns: array<string>>"


class Conflict(Exception):
    """Another writer has committed the version first, every time."""


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names(spark, f"{path}/{LOG}") if n.endswith(".json") and n[:-5].isdigit())


def _try_commit(spark: SparkSession, path: str, version: int, actions: list[dict]) -> bool:
    """Create the version's log file unless there is one: whoever creates it has the version."""
    return create(spark, f"{path}/{LOG}/{version:020d}.json", "".join(json.dumps(a) + "\n" for a in actions))


def actions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The log's actions up to a version, with the version that each is of."""
    have = [v for v in versions(spark, path) if version is None or v <= version]
    if not have:
        raise FileNotFoundError(f"no table at {path}")
    rows = spark.read.schema(ACTION).json([f"{path}/{LOG}/{v:020d}.json" for v in have])
    return rows.withColumn("version", F.regexp_extract(F.input_file_name(), r"(\d{20})\.json", 1).cast("long"))


def files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Paths of the files that make up a version: added, and not removed after that."""
    a = actions(spark, path, version)
    both = a.where("add is not null").select("add.path", "version", F.lit(True).alias("live")).unionAll(a.where("remove is not null").select("remove.path", "version", F.lit(False)))
    return both.groupBy("path").agg(F.max_by("live", F.struct("version", "live")).alias("live")).where("live").select("path")


def write(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "append", attempts: int = 5) -> int:
    """Write df as new files and commit them; returns the version. append adds files, overwrite also removes those there are.

    The files lie in a folder of their own before the commit, so a lost attempt leaves no rows. Where another writer takes a
    version first, an append goes on with the next one, waiting twice as long each time; an overwrite looks at the
    files anew. The table's columns have to be those of the first write.
    """
    spark, folder = df.sparkSession, f"part-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{folder}")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path}/{folder}").select("path", "length", "modificationTime").collect()
    adds = []
    for r in rows:  # one entry per file
        inner = r["path"][r["path"].rindex(folder) :]
        values = dict(x.split("=", 1) for x in inner.split("/")[1:-1])
        adds.append({"add": {"path": inner, "partitionValues": values, "size": r["length"], "modificationTime": int(r["modificationTime"].timestamp() * 1000), "dataChange": True}})
    for k in range(attempts):
        have = versions(spark, path)
        now, version = int(time.time() * 1000), (have[-1] + 1 if have else 0)
        head = [{"commitInfo": {"timestamp": now, "operation": "WRITE", "operationParameters": {"mode": mode}}}]
        if not have:
            meta = {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": df.schema.json(), "partitionColumns": list(partition_by), "configuration": {}, "createdTime": now}
            head += [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": meta}]
        elif table_schema(spark, path) != json.loads(df.schema.json()):
            raise ValueError("columns differ from the table's")
        gone = [{"remove": {"path": r["path"], "deletionTimestamp": now, "dataChange": True}} for r in files(spark, path).collect()] if have and mode == "overwrite" else []
        if _try_commit(spark, path, version, head + gone + adds):
            return version
        time.sleep(0.05 * 2**k)
    raise Conflict(path)


def table_schema(spark: SparkSession, path: str) -> dict:
    return json.loads(actions(spark, path).where("metaData is not null").orderBy(F.desc("version")).select("metaData.schemaString").first()[0])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (default: the last). Partition columns come from the files' folders, as Spark reads them."""
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(table_schema(spark, path))
    paths = [f"{path}/{r['path']}" for r in files(spark, path, version).collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    folders: dict[str, list[str]] = {}
    for p in paths:
        base = p[: p.index("/part-") + 38]
        folders.setdefault(base, []).append(p)
    out = None
    for base, ps in sorted(folders.items()):
        one = spark.read.schema(schema).option("basePath", base).parquet(*ps)
        out = one if out is None else out.unionByName(one)
    return out
