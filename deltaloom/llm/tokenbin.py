"""Token ids as length-delimited binary records, with an offset index beside each file.

Record: length (u64) | masked CRC-32 of those 8 bytes (u32) | payload | masked CRC-32 of the payload (u32), all
little-endian. Payload: flags (u8; 1: a doc_id follows), bytes per id (u8), doc_id (i64), ids. A mask rotates the
checksum by 15 bits and adds a constant, so that checksums of data that hold checksums stay apart.
Index file: per record its offset (u64), whole length (u64) and ids (u64), then a masked CRC-32 of all that.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import pieces
from deltaloom.llm.common import new_folder, ship

# Fixed value of the record format.
MASK_DELTA = 0xA282EAD8

MANIFEST = "file string, n_docs long, n_tokens long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole record; ValueError where a length or checksum is wrong."""
    n, check = struct.unpack_from("<QI", data)
    if check != masked(data[:8]) or n + 16 != len(data):
        raise ValueError("broken record length")
    payload = data[12 : 12 + n]
    if struct.unpack_from("<I", data, 12 + n)[0] != masked(payload):
        raise ValueError("broken record")
    return payload


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> list[dict]:
    """Write all documents in ascending doc_id order; returns one entry per file, in that order.

    Each task writes a data file and an index file under names of its own and then moves them into place, so a task that
    runs again leaves the same files. Files follow doc_id ranges. A null doc_id comes first; equal doc_ids are ordered by
    their texts' MD5, and may be in several files.
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        enc, kind = pieces.ids(vocabulary), np.dtype(pieces.id_kind(vocabulary))
        end, width = np.array([end_id], kind).tobytes(), kind.itemsize
        name, own = f"part-{TaskContext.get().partitionId():08d}", uuid.uuid4().hex
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        index, at, tokens = [], 0, 0
        with fs.open_output_stream(f"{root}/.{name}.{own}") as out:
            for batch in batches:
                for part in pieces.slices(batch):
                    texts = pc.fill_null(part.column("text"), "").to_pylist()
                    for doc, got in zip(part.column("doc_id").to_pylist(), enc.values(texts)):
                        data = got + end
                        record = frame(struct.pack("<BBq", doc is not None, width, doc or 0) + data)
                        out.write(record)
                        index.append((at, len(record), len(data) // width))
                        at += len(record)
                        tokens += len(data) // width
        data = np.array(index, "<u8").tobytes()
        with fs.open_output_stream(f"{root}/.{name}.idx.{own}") as out:
            out.write(data + struct.pack("<I", masked(data)))
        fs.move(f"{root}/.{name}.{own}", f"{root}/{name}.rec")
        fs.move(f"{root}/.{name}.idx.{own}", f"{root}/{name}.idx")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)]), pa.array([tokens])], ["file", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("by"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), "by", "row"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return sorted((r.asDict() for r in rows.mapInArrow(run, MANIFEST).collect()), key=lambda r: r["file"])


def read_index(fs, path: str):
    import numpy as np

    data = fs.open_input_stream(path).read()
    if struct.unpack("<I", data[-4:])[0] != masked(data[:-4]):
        raise ValueError(f"broken index {path}")
    return np.frombuffer(data[:-4], "<u8").reshape(-1, 3).astype(np.int64)


def read_record(file, offset: int, length: int):
    """(doc_id, ids) of the record at an index entry; entries may be taken in any order."""
    import numpy as np

    file.seek(offset)
    payload = unframe(file.read(length))
    has, width, doc = struct.unpack_from("<BBq", payload)
    return doc if has else None, np.frombuffer(payload, f"<u{width}", offset=10)


def read(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; one task per file, records found by the index."""
    ship(spark)
    starts, at = [], 0
    for f in files:
        starts.append((f["file"], at))
        at += f["n_tokens"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        fs, root = _open(folder)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                name, start = starts[i]
                index = read_index(fs, f"{root}/{name}.idx")
                first = start + np.cumsum(index[:, 2]) - index[:, 2]
                docs, crc = [], []
                with fs.open_input_file(f"{root}/{name}.rec") as file:
                    for offset, length, n in index.tolist():
                        doc, got = read_record(file, offset, length)
                        if len(got) != n:
                            raise ValueError("index and record differ")
                        docs.append(doc)
                        crc.append(zlib.crc32(got.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first), pa.array(index[:, 2]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(starts), 1, max(1, len(starts))).mapInArrow(run, SCHEMA)


def token_records(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Write docs to a new folder in the shared scratch folder, and read every record back.

    A null text counts as empty (the end id alone). Repeated and null doc_ids each keep a record. An empty table gives no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "records")
    return read(spark, folder, write(docs, folder, vocabulary, end_id))
