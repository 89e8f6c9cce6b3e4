"""From raw documents to packed training sequences: five stages, each on all that the one before has kept.

Null and empty texts fail the quality rules, so later stages don't see them;
run on their own, these keep nulls as they are. Rows with a null doc_id are
never duplicates of others. Rows that repeat doc_id and text count once from the
second stage on. Ties in a group are decided by doc_id, then by a hash of the
text. Columns other than doc_id, text and n_chars are kept as they are, whatever
their names; the last stage gives pieces instead. An empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.llm import near_copies, packing, pii, quality_rules, substring_dedup
from facetflow.llm.common import replaced, stash, table, unstash


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema.fields[docs.columns.index("n_chars")].dataType
    return replaced(docs, "n_chars", lambda at: F.length(at("text")).cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of five-word shingles from 0.8 on) stays."""
    return near_copies.first_of_groups(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages stay in the first document that has them; elsewhere their words go."""
    return _sized(substring_dedup.clean(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to the names of their kinds."""
    return _sized(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("substring_dedup", substrings), ("pii", personal_data), ("packing", packed)]
#: SQL can express neither the forest nor the tokenizer; tests compare each stage with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        unstash(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
