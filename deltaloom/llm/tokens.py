"""Token counts of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm import pieces
from deltaloom.llm.common import ship, spread

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; other columns are ignored.

    Only lengths leave the Arrow function; nothing is shuffled, unless a table has fewer splits than there are cores. Batches are balanced by bytes, and texts are cut at safe
    boundaries (see pieces), so a very long text is encoded in parts that give the same ids. A null text counts as
    empty: 0 bytes, 0 tokens. Null or repeated doc_ids are kept, one row each. An empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        enc = pieces.counter(vocabulary)
        for batch in batches:
            for part in pieces.slices(batch):
                text = pc.fill_null(part.column("text"), "")
                n = pa.array(enc.values(text.to_pylist()), pa.int64())
                size = pc.cast(pc.binary_length(text), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, SCHEMA)
