"""A corpus pipeline of five operators; each stage's rows are written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import decontam, nearsets, packing, sufdedup, toxicity
from deltaloom.llm.common import keep, table

#: Words of a passage that suffix_dedup cuts at least: over 50.
PASSAGE = 51
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject, as they are: rows with a null text, without words or without a
    doc_id, and every one of equal rows. The chain is fitted on the labelled ones among docs; without any, nothing is rejected
    that its bias does not reject. An empty table gives no rows. Columns beside those of documents go, here and in all stages.
    """
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).where("not rejected").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more), the row with the smallest doc_id; every row is judged.

    SimHash fingerprints and the trie join find the pairs, whole sets of shingles decide them. Rows without a doc_id come
    last in their group; equal rows are one; all texts without words, null ones too, are one group.
    """
    return nearsets.one_of_each(docs.select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur elsewhere, in another row or the same text.

    Every row stays, with n_chars of what is left; a text that is all repeats becomes empty, and so does a null one. A
    doc_id that is null or repeats changes nothing.
    """
    out = sufdedup.remove_repeats(docs.select(COLUMNS), decode=True, words=PASSAGE)
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as they are: null and empty texts hold none, equal rows all stay or all go."""
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces; a null or empty text is its end id alone, null and repeated doc_ids are documents of their own."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: A classifier, a tokenizer and fingerprints of hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows, _ = keep(spark, stage(spark, rows, sf_dir), name)
    return rows
