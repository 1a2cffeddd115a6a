"""A corpus pipeline over ``documents``: five operators, each stage written as Parquet and read as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenry.llm.blocks import written
from lumenry.llm.bpe import bpe
from lumenry.llm.mixing import cut, mix_sources
from lumenry.llm.ngram_join import ngram_join
from lumenry.llm.quality_rules import keep_good
from lumenry.llm.queries import MIX_LEVELS, MIX_WEIGHTS, VOCABULARY
from lumenry.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others stay as they are."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays; so do documents without an id.

    Of rows that repeat both id and text, one stays. Rows of one id and different texts
    stay together, if any of them is its group's.
    """
    stays = ngram_join(docs).filter("component_id = doc_id").select("doc_id").distinct()
    same = Window.partitionBy("d.doc_id", F.xxhash64("d.text")).orderBy(F.length("d.text"))
    rows = docs.join(stays, "doc_id", "left_semi").select(F.struct(*[docs[c] for c in docs.columns]).alias("d"))  # no name clashes with the number of the copy
    rows = rows.select("d", F.row_number().over(same).alias("copy")).filter("copy = 1").select("d.*")
    return rows.unionByName(docs.filter("doc_id IS NULL"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows are cut out of the texts; a text that loses all its words goes, one that loses none keeps its layout."""
    out = substring_dedup(docs, carry=docs.columns).filter("n_words = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, once for each epoch; the last one of a leaf is cut at the budget."""
    out = mix_sources(docs, MIX_LEVELS, 1.0, MIX_WEIGHTS, epochs=2, carry=docs.columns)
    text = cut(F.col("row.text"), F.col("n_tokens"), F.col("n_taken"))
    new = {"text": text, "n_chars": F.when(F.col("n_taken") < F.col("n_tokens"), F.length(text)).otherwise(F.col("row.n_chars")).cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    out = bpe(docs, public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources", mixing),
    ("BPE encoding", encode),
]
#: Near copies, seeded orders and merges have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
