"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing
to target weights, BPE.

Every stage takes the documents its predecessor kept and is written as Parquet
and read again. All but the last return the columns of ``documents``; the last
returns token ids and the text they decode to, per document the mix took (as
often as it took it).

All stages take NULLs in any column, empty and very long texts, repeated rows and ids,
empty tables and extra columns of any name; what each does with them stands at its
operator. Ties go to the smallest id, then the smallest row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldsense.llm import bpe, exact_dedup, langid, mix, simhash
from fieldsense.session import ensure_checkpoint_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in them; a language that is only guessed is kept. NULL
    and empty texts go; repeated rows stay, with all their columns."""
    return langid.keep_identified(docs, langid.train(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside: the one of the
    smallest id, rows without id only where no other has the text."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, chosen like an exact copy's."""
    return simhash.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the same in every run; NULL sources
    are one source."""
    return mix.mixed_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, text``: tokens and the text they decode to; a text without tokens
    has none and decodes to the empty text."""
    return bpe.encode_decode(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("bpe", bpe_stage),
]

# the language stage's support vector machines cannot be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written under the
    shared checkpoint folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
