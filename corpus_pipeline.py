"""Stages that turn documents into training data; each works on all that the one before kept.

Nulls: a null text has no words, so the first stage rejects it; null ids and sources go through all stages as values of their own. Rows that repeat
each other are copies, of which the second stage keeps one. Further columns of documents stay until the last stage, which adds its own; only the text changes on
the way. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyhue.llm import bpe, line_quality, minhash, mixing, repeats
from skyhue.llm.tables import staged, table

#: Bytes of a repeated passage, and of the strings that name its anchors. 51 words of the four languages' prose nearly always reach PASSAGE.
PASSAGE, PASSAGE_GRAM = 200, 48


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the depletion rule keep, without the lines that too many documents of their source share."""
    return line_quality.passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by sets of five-word shingles with a similarity of 0.8: that with the smallest id."""
    return minhash.representatives(docs, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of PASSAGE bytes."""
    columns = docs.columns
    return repeats.without_repeats(docs, add=("kept_text",), span=PASSAGE, gram=PASSAGE_GRAM).withColumnRenamed("kept_text", "text").select(*(f"`{c}`" for c in columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a part of a repetition is the document's first words."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of what decoding them gives."""
    found = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, add=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    return found


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("minhash near duplicates", near_duplicates),
    ("suffix-array repeats", repeated_passages),
    ("source mix", source_mix),
    ("byte-level BPE", token_ids),
]
#: Byte-level BPE isn't SQL, nor is a search for repeated strings at this size: run() is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written, and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
