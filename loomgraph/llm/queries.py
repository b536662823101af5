"""The queries of this subpackage, as ``__spark_entry__`` registers them.

Each runs over its whole table and whole texts.  Null, empty and very long texts,
ties, repeated rows, null ids and empty tables have the results that the
operator's docstring states; columns that an operator doesn't name are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chat, common, context_mixing, decontaminate, mixing, near_dedup, progressive_jpeg, secrets, token_planes, toxicity, warc


#: Score from which a document counts as toxic.
TOXIC = 0.3


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: digests of its payload and media, and a feature of its RGB tensor; a null text is empty, repeated rows have equal values."""
    # The media column goes from the one operator to the other; as a table of its own it takes twice the documents' bytes.
    return progressive_jpeg.digests(progressive_jpeg.store(common.table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each (document, benchmark item) of which the one leaks the other; null and empty texts leak nothing, repeated rows count once."""
    return decontaminate.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row; learns from those that aren't held out, a null id counting as the empty text; a null text is its end alone."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.crc_of_id(F.col("doc_id"), 10) == 0
    return context_mixing.score(docs, docs.filter(~held_out)).withColumn("held_out", held_out)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation, read back from its formatted form; null turns come first, ties are ordered by role and text."""
    said = "\\### Assistant: </turn> ok"
    row = lambda turn, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
    more = spark.range(1).select(F.inline(F.array(row(0, "user"), row(1, "assistant"))))
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.parse_conversations(chat.format_conversations(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row; a null or empty text has the score of texts without terms, of repeated ids the least text is learned from."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_scores(docs, toxicity.learn(docs, toxicity_labels(spark, sf_dir)))
    return scored.select("doc_id", (common.crc_of_id(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from; a null id counts as the empty text."""
    return common.table(spark, sf_dir, "labels").filter(common.crc_of_id(F.col("doc_id"), 4) != 2)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page row, read back from the archives; null html is empty, rows of a null id come back with one."""
    folder = common.new_folder(spark, "warc")
    warc.write_archives(common.table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each use of a document; a null source is a source of its own, repeated rows are used together."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    used = mixing.schedule(docs)
    return used.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row; null and empty texts have no spans."""
    docs = common.table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.learn_formats(docs))


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row, read back from the files; null ids come first, equal ids are ordered by text, a null text is the end id alone."""
    folder = common.new_folder(spark, "planes")
    token_planes.write_planes(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_planes.read_planes(spark, folder)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document row; null and blank texts link to nothing, rows of one id share a group."""
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), shingle=3, num=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_progressive_jpeg, op2_decontaminate, op3_context_mixing, op4_chat, op5_toxicity, op6_warc, op7_mixing, op8_secrets, op9_token_planes, op10_near_dedup)}
