"""Documents to packed training sequences: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs.

Odd rows: a null, empty or blank text has no words, so the quality rules reject it. Rows of equal or null doc_id are documents
of their own; one of each group of near copies stays. Texts are read whole, however long. Columns besides those of documents
are carried along, whatever their names, up to the last stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import mixing, packing, quality, secrets, simhash
from tallywork.llm.common import stored, table
from tallywork.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id."""
    return simhash.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, n_chars follows."""
    return secrets.redacted(docs, chars="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and pass of the mix, with the words in the blocks that the pass takes; n_chars follows."""
    return mixing.resampled(docs, chars="n_chars")


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a document that the mix repeats is packed as often."""
    pieces = packing.packed(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_duplicates), ("secret scans", secret_scans), ("source mixing", source_mixing), ("token packing", token_packing)]
ORACLE_SQL = None  # hashes, tokenizer and decoding layers have no SQL; tests hold it against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
