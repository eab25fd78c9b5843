"""Registered queries of the thirteen operators and the corpus pipeline.

Each query reads its whole table, applies its operator with production
parameters and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tickflow.llm import bpe, brown, chat, decontaminate, dialogue, jaccard, langid, oracle, packing, quality, runs, sharding, substrings, vectors, vocab
from tickflow.llm.frames import prepare


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocab.default_path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.decode(ids, path).select(
        "doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder("doc_id", 4) != 2))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = brown.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 10) != 0)
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, quality.train(docs, _read(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_duplicate_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_read(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                      "law", "shard", "slot", "grown_shard")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", "kept")


#: A conversation whose texts are control strings of the template.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocab.default_path("byte_bpe_50k.tiktoken")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(CONTROL_TURNS, turns.schema))
    return chat.read_back(chat.format_turns(turns, path), path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"),
                          vocab.default_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of each document, where crc32 of the id divides by ten with its words periodic from one on.

    With g = crc32 div 10 and n words, word i >= a = g mod n becomes word a + (i - a) mod p of the original,
    p = 1 + (n - a) div (3 + g mod 8).  A null id leaves the text as it is.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(crc / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def periodic(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1),
                            lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(w, i.cast("int"))), " ")).otherwise("")

    tail = F.get(F.transform(F.array(words), periodic), F.lit(0))
    return docs.select("doc_id", F.when((crc % 10 == 0) & F.col("text").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(with_periodic_tails(_read(spark, sf_dir, "documents")))
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"),
                                                               r.period.cast("string")), F.lit("\n")))
    return out.select(
        "doc_id", "runs", F.size("runs").cast("long").alias("n_runs"), greatest.alias("g"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", (-F.col("g.start")).alias("start"), F.col("g.length").alias("length"),
             (-F.col("g.period")).alias("period"), F.expr("1000 * g.length div -g.period").alias("exponent_milli"),
             "runs_sha256", "collapsed_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversation rows after the damage that crc32 of ``conv_id:turn`` deals out.

    The remainder by 20 drops a row (0), empties its text (1), takes out its ``.!?`` (2), repeats it (3) or makes its
    role user (4).  A null reads as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (turns.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(space("role")).alias("role"),
                                       text.alias("text"), F.explode(copies).alias("copy")).drop("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = dialogue.repair(damaged(turns))
    out = turns.select(F.col("conv_id").alias("c")).distinct()
    for part in (fixed.totals, dialogue.report(fixed)):
        out = out.join(part, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("c").alias("conv_id"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_language_id": op2_language_id,
        "op3_brown_lm": op3_brown_lm,
        "op4_quality_rules": op4_quality_rules,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_sharding": op7_sharding,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_chat_format": op9_chat_format,
        "op10_packing": op10_packing,
        "op11_decontamination": op11_decontamination,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_conversation_repair": op13_conversation_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
