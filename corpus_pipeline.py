"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm import jaccard, langid, packing, quality, substrings, vocab
from tickflow.llm.frames import prepare, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language: those with a letter whose prediction is more likely right than wrong."""
    prepare(spark)
    tagged = langid.identify(docs.select(F.struct(*docs.columns).alias("doc"), "text"), langid.train(docs))
    return tagged.where(langid.accepted()).select("doc.*")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the quality rules, learned from the labels; a text that is null or empty has no words and fails them.

    Each row is judged by its text alone, repeated rows and ids alike.
    """
    prepare(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(docs.select(F.struct(*docs.columns).alias("doc"), "text"), model)
    return judged.where("kept").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: that of the smallest id (no id counts as larger than all).

    Of several rows of that id in one group, the one whose text has the
    smallest hash stays (of equal ones any).  Rows of one id that are not near-duplicates
    are groups of their own; a text without words is near nothing and stays.
    """
    prepare(spark)
    grouped = jaccard.near_duplicate_components(docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text"), group="group")
    first = grouped.where(F.col("group").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    single = first.groupBy("group").agg(F.min_by("doc", F.xxhash64("doc.text")).alias("doc"))
    return single.select("doc").union(grouped.where("group is null").select("doc")).select("doc.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of 200 bytes or more that occurs again; the text that stays may be empty.

    A null text stays null, and n_chars, where there is such a column, follows the text.
    """
    prepare(spark)
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    cut = substrings.remove_repeats(docs.select(rest.alias("doc"), "text"))
    cut = cut.withColumn("text", F.when(F.col("text").isNotNull(), substrings.as_text("kept")))
    chars = lambda f: F.coalesce(F.length("text"), F.lit(0)).cast(f.dataType) if f.name == "n_chars" else F.col("doc")[f.name]
    return cut.select(*[F.col("text") if f.name == "text" else chars(f).alias(f.name) for f in docs.schema.fields])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: one row per piece of a document, with its doc_id; no other column is carried.

    A null or empty text is its end token; repeated rows and ids are documents of their own.
    """
    prepare(spark)
    return packing.pack(docs.select("doc_id", "text"), vocab.default_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", filter_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL cannot express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
