"""What the corpus operators share: reading tables, shared scratch tables, shipping the code to executors."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most: rows here hold whole texts, and a batch is in memory on both sides of the pipe.
ARROW_ROWS = 1024

_shipped: set[str] = set()
_holders: dict[str, Callable[[], None]] = {}
_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hold(name: str, drop: Callable[[], None] = lambda: None) -> None:
    """In a worker: what other operators have cached there goes, as workers outlive operators; drop frees what name caches."""
    for other in [k for k in _holders if k != name]:
        import pyarrow as pa

        _holders.pop(other)()
        pa.default_memory_pool().release_unused()
    _holders[name] = drop


def slices(batch, bytes_each: int = 4 << 20):
    """Slices of an Arrow batch whose column `text` holds about so many bytes each; a longer text stands alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > bytes_each:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt out to all cores where fewer tasks than cores would have rows (one row group is one task); else as they are.

    docs: a table, as its partitions are counted first. No text is shuffled if the table has splits enough.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    busy = docs.select(F.spark_partition_id().alias("p")).distinct().count()
    return docs.repartition(4 * cores) if busy < cores else docs


def whole_keys(batches, rows: int = 20_000):
    """Tables of whole keys from batches that come sorted by column `key`: about so many rows each, or one larger key."""
    import numpy as np
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        if n >= rows and held[-1].column("key")[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        cut = np.flatnonzero(key[1:] != key[:-1])
        if n + len(key) > rows and len(cut):
            at = int(cut[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held, n, batch = [], 0, batch.slice(at)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def dealt(spark: SparkSession, rows: DataFrame, bucket: list[str], by: str, block: int) -> DataFrame:
    """rows with `mine`, `lo`, `hi` and `key`: what is to be compared within a bucket meets under one key.

    A bucket of up to `block` rows is one key. A larger one is cut into blocks by a hash of column `by`, and each pair of
    blocks is a key (lo, hi; mine: the row's own block), so no task holds more than two blocks. The list of large buckets is
    a written table: Spark broadcasts it if it is small enough, and joins it otherwise.
    """
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot, _ = keep(spark, rows.groupBy(*bucket).agg(F.count("*").alias("n__")).where(F.col("n__") > block).select(*bucket, F.ceil(F.col("n__") / block).alias("blocks__")), "hot")
    out = rows.join(hot, bucket, "left").withColumn("blocks__", F.coalesce("blocks__", F.lit(1).cast("long")))
    out = out.withColumn("mine", F.pmod(F.xxhash64(F.col(by), F.lit(17)), F.col("blocks__"))).withColumn("other__", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks__") - 1)))
    out = out.select(*rows.columns, "mine", F.least("mine", "other__").alias("lo"), F.greatest("mine", "other__").alias("hi"))
    return out.withColumn("key", F.xxhash64(*bucket, "lo", "hi")).repartition(n, "key").sortWithinPartitions("key")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it anywhere; keep Arrow batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = Path(tempfile.mkdtemp()) / f"{root.name}-code.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Only where it is unset (tests) a local one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            own = tempfile.mkdtemp(prefix="deltaloom-")
            atexit.register(shutil.rmtree, own, True)
            _own_dir[app] = f"file://{own}"
            spark.sparkContext.setCheckpointDir(_own_dir[app])
        base = _own_dir[app]
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}" if base.startswith("/") else base
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/deltaloom/{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_folder(spark, path)


def keep(spark: SparkSession, df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it again: the lineage ends here, and losing an executor loses nothing."""
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
