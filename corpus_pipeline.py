"""A corpus pipeline of five stages, each written as Parquet and read again for the next.

Each function takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of documents; the last returns the encoded texts. Columns
beside those of documents stay, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import bpe, language, mixing, secret_scan, simhash
from gleaner.llm.common import Cuts, table
from gleaner.llm.queries import TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; what has no letter or is far from all goes.

    A null or empty text has no letter. A null lang teaches nothing; without labelled texts
    all go. Equal texts are judged alike, and repeated rows stay repeated; ties between
    languages go to the first by code point. Long texts are read whole.
    """
    return language.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: similarity 0.8 of five-word shingles, or fingerprints within two bits.

    The one with the smallest doc_id stays, null last, and of repeated ids any one; rows are
    told apart by their place, so differing texts under one id, or under null, all stay.
    Texts without words are one group, but those without an id stay.
    """
    return simhash.without_copies(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret blanked.

    A null or empty text stays as it is; rows that share an id, or have none, get their own
    spans; repeated rows stay repeated. n_chars is the new length where something was blanked.
    """
    return secret_scan.without_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in the order of its schedule, one row for each pass that takes words of it.

    Texts that are null or without words are not taken; a null source is a source of its own;
    each repeated row has its own place and passes.
    """
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the digest of what they decode to; a null text is empty and has no ids."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("bpe_encoding", bpe_encoding),
]

#: Clustering and similarity search have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    cuts = Cuts(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = cuts.write(stage(spark, docs, sf_dir))
        if before is not None:
            cuts.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
