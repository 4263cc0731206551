"""Five stages that turn raw documents into packed training sequences.

Each stage works on all rows that the one before kept.  All but the last return
the columns of ``documents``; the last returns the pieces of sequences.

In every stage a null text counts as an empty one, texts are read whole whatever
their length, columns beside ``doc_id, text, source`` pass through whatever their
names, and an empty table gives no rows.  Repeated rows are judged, redacted, mixed
and packed one by one; near-duplicates keep one of them.  A row without doc_id is
known by its text and keeps its null.  Rows without words leave in mixing, where
they are in no block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import mixing, packing, pii, simhash, toxicity
from veilspark.llm.common import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier rejects go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: alike by SimHash, or by Jaccard 0.8 of 5-word shingles."""
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go with the chosen blocks, so that sources meet their target weights."""
    return mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed along the space-filling curve."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
