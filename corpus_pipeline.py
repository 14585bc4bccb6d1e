"""Cleaning and packing of a corpus: five stages, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.llm.bm25_packing import Packing, added_tokens, pack_documents
from tillflow.llm.common import saved, table
from tillflow.llm.disguised_pii import mask_private
from tillflow.llm.line_windows import dedup_lines
from tillflow.llm.risk_rules import keep_good
from tillflow.llm.simhash import one_of_each_group


def _documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with the length brought up to the text."""
    length = F.length("text").cast("long").alias("n_chars")
    return docs.select(*[length if c == "n_chars" else F.col(f"`{c}`") for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or a certified cutoff."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated three-line windows out of the texts; the first ones stay."""
    return _documents(dedup_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least ``doc_id`` of each group of SimHash near-duplicates, as op3 finds them."""
    return one_of_each_group(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, plain and disguised, by the name of its kind."""
    return _documents(mask_private(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the window's length, filled with lexical neighbours."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(docs, Packing(path, public_tokenizers.PATTERN, added=added))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: Fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
