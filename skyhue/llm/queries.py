"""Registered queries: each operator over its whole table with production parameters. SQL of those that SQL can express is in sql.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhue.llm import bpe, context_mixing, curves_ann, divergence, importance, language, line_quality, minhash, mixing, repeats, reply_trees, toxicity, warc
from skyhue.llm.sql import SQL
from skyhue.llm.tables import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether the base rules and the lines it shares with its source's others keep it."""
    found = line_quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "removed_words", "kept")


@query
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.without_repeats(docs, add=("n_bytes", "n_removed", "n_spans", "kept_sha256"), span=400)


@query
def op3_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return curves_ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return context_mixing.scored(docs, language.held_out(F.col("doc_id"), 7))


@query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes that decoding them gives, as digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, add=("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op6_minhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked documents and their components, on sets of three-word shingles."""
    found = minhash.near_copies(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op7_zstandard_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from archives of all pages."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of each document."""
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the toxicity categories of every document, and whether it is toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query
def op10_language_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by profiles of the languages of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"), 4)
    known = language.profiles(docs.where(~out), "text", "lang")
    return language.predicted(docs.select("doc_id", out.alias("held_out"), "text"), known)


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from the language's others, and the terms that set it apart from the language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every document towards the benchmark's texts, and the ranks of those drawn."""
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_reply_tree_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted, written and read back as turns and as what is learnt from."""
    control = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    messages = staged(reply_trees.chains(rows))
    chosen = reply_trees.paths(messages, branches=1, score=F.length("text"), name="conversation")
    chats = staged(reply_trees.formatted(chosen)).select("name", "segments", reply_trees.whole_text(F.col("segments")).alias("chat"))
    read = chats.select("name", "chat", reply_trees.turns(F.col("chat")).alias("turns"), F.array_join(reply_trees.learnt(F.col("segments")), "").alias("loss"))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("name").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("chat").cast("long").alias("formatted_chars"),
    )


__all__ = ["QUERIES", "SQL"]
