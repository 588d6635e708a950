"""Packing of documents into fixed windows: concatenate and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm import pieces
from deltaloom.llm.common import keep, ship, spread

TOKENS = "doc_id long, part int, local long, n_tokens long, ids binary"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """One row per document: its ids as bytes with the end id, and where it starts within its partition's tokens."""
    ship(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        enc, part, at = pieces.ids(vocabulary), TaskContext.get().partitionId(), 0
        kind = np.dtype(pieces.id_kind(vocabulary))
        end, width = np.array([end_id], kind).tobytes(), kind.itemsize
        for batch in batches:
            for piece in pieces.slices(batch):
                rows = [x + end for x in enc.values(pc.fill_null(piece.column("text"), "").to_pylist())]
                n = np.array([len(r) // width for r in rows], np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(local), pa.array(n), pa.array(rows, pa.binary())], ["doc_id", "part", "local", "n_tokens", "ids"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, window: int = 4096) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Pass 1 encodes each document once into a table in the shared folder; its partitions' token totals (one number per
    partition) become global offsets by a prefix sum. Pass 2 lays all documents end to end and cuts at every multiple of
    `window`: a document that crosses a boundary gives one piece per window it touches. Only the last sequence is padded.
    The written table fixes the order, so a lost executor can't change the offsets.

    A null text counts as empty (one piece, the end id alone). Null and repeated doc_ids are separate documents. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    tokens, _ = keep(spark, encode_documents(docs, vocabulary, end_id), "pack")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]] = at
        at += r["n"]

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        kind = np.dtype(pieces.id_kind(vocabulary))
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, part, local, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "local", "n_tokens", "ids"))):
                wide = np.frombuffer(ids, kind).astype("<u4").tobytes()
                g, start = base[part] + local, 0
                while start < n:
                    seq, off = divmod(g + start, window)
                    length = min(n - start, window - off)
                    for c, v in zip(out, (doc, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, seq, off)):
                        c.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.mapInArrow(cut, SCHEMA)
