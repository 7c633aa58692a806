"""A corpus pipeline: toxic documents out, repeated lines out, one of each near-duplicate group, sources mixed, packed.

Each stage reads what the one before it wrote. The first three filter; mixing repeats documents; packing returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import line_dedup, minhash, mixing, packing, toxicity
from lumenframe.llm.common import Scratch, table
from lumenframe.llm.queries import tokenizer_paths

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents not predicted toxic, by a classifier learnt from those of ``docs`` that ``labels`` names.

    A null or empty text is scored by the bias alone; very long texts are scored whole; rows that repeat are scored each,
    alike. An empty table, or one without labels of both classes, is scored by lexicons. Columns other than those of
    ``documents`` are left out here and in the stages below.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier line repeats; n_chars is counted anew where a line went.

    Earlier is by doc_id, then text. A document that loses all its lines goes; null, empty and blank texts stay as they
    are; rows that repeat both doc_id and text get the same decisions; an empty table stays empty.
    """
    kept = line_dedup.dedup_lines(docs.withColumn("before", F.xxhash64("text")))
    changed = F.xxhash64("text") != F.col("before")
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Texts without words, and rows without a doc_id, stay; rows that repeat both doc_id and text stay or go together; an
    empty table stays empty.
    """
    return minhash.drop_near_duplicates(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its doc_id's hash say, in pseudo-random order.

    A null source is a source of its own; null and empty texts are repeated like the rest of their source. Copies keep
    their doc_id, as a stage returns the columns of ``documents`` only; the next stage packs each for itself.
    """
    return mixing.mix_sources(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens. A null or empty text is its end id alone; an empty table packs nothing."""
    return packing.pack_documents(docs, *tokenizer_paths())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The label model, the classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet in the shared folder and read again.

    A stage's table goes when the next one is written; the last stage has written its own pieces down when it returns.
    """
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES):
            before, docs = docs, stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = scratch.cut(docs)
                if k:
                    scratch.drop(before)
    return docs
