"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, token storage.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of ``documents``; the last returns a row for each
stored document.  Other columns are dropped; a null text counts as empty, a text of any
length as a whole; an empty table stays empty.  Nulls, ties and repeated rows:
see each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common, decontaminate, mixing, near_dedup, token_planes, toxicity
from loomgraph.llm.queries import TOXIC, toxicity_labels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold stay: repeated rows all or none of them, rows of a null id by their text."""
    model = toxicity.learn(docs, toxicity_labels(spark, sf_dir))
    return toxicity.with_scores(docs.select(COLUMNS), model).filter(F.col("score") < TOXIC).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (five-word shingles, similarity 0.8 or more) the document of least id stays, once.

    Of rows that share the least id of their group one stays, that of the least
    text that isn't blank, ties by the other columns; rows of a null id go in favour of any
    with an id, and of such rows of one text one stays.
    """
    docs = docs.select(COLUMNS)
    groups = near_dedup.near_duplicates(docs, shingle=5, num=80)
    kept = groups.filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi")
    # Few ids are repeated, if any; only their rows are shuffled.
    repeated = common.cut(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    row, text = F.struct(*COLUMNS).alias("row"), F.coalesce("text", F.lit(""))
    one = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct((F.trim(text) == "").alias("blank"), row)).alias("m")).select("m.row.*")
    out = named.join(repeated, "doc_id", "left_anti").select(COLUMNS).unionByName(one)
    null = docs.filter("doc_id IS NULL").withColumn("digest", F.sha2(text, 256))
    if null.isEmpty():
        return out
    taken = docs.filter("doc_id IS NOT NULL").select(F.sha2(text, 256).alias("digest")).distinct()
    return out.unionByName(null.join(taken, "digest", "left_anti").groupBy("digest").agg(F.min(row).alias("row")).select("row.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go: all rows of an id of which one text does."""
    return decontaminate.without_leaks(docs.select(COLUMNS), common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's quota says, which may be never; rows repeated in full are taken or left together."""
    return mixing.schedule(docs.select(COLUMNS)).select(COLUMNS)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold: null ids first, equal ids ordered by text."""
    folder = common.new_folder(spark, "planes")
    token_planes.write_planes(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_planes.read_planes(spark, folder)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_leaks), ("mix", mix_sources), ("token_planes", store_tokens)]

#: Automata, neighbours and tokenizers aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each result being written and read again; what a stage alone needed is deleted then.

    An empty table gives no rows.
    """
    docs = common.table(spark, sf_dir, "documents")
    made = len(common.FOLDERS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = common.new_folder(spark, f"stage-{name}")
            docs = common.written(docs, folder)
            common.drop_folders(spark, [f for f in common.FOLDERS[made:] if f != folder])
    return docs
