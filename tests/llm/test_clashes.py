"""Extra columns named like an operator's outputs or its own helpers neither break it nor change its results."""

import pytest
from pyspark.sql import functions as F
from test_operators import make_texts

from tickflow.llm import chat, jaccard, packing, quality, runs, sharding, substrings, vocab
from tickflow.llm.frames import prepare

HELPERS = ["row", "id", "t", "n", "root", "places", "cls", "block", "own", "digit", "component", "group", "words", "e"]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(i, t) for i, t in enumerate(make_texts())]
    return spark.createDataFrame([*rows, rows[12], (None, "no id")], "doc_id long, text string").repartition(3).cache()


def judged(docs):
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return lambda d: quality.judge(d, quality.train(docs, labels))


OPERATORS = {
    "quality": (judged, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    "substrings": (lambda docs: substrings.remove_repeats, ["kept", "spans"]),
    "jaccard": (lambda docs: jaccard.near_duplicate_components, ["n_shingles", "component_id"]),
    "sharding": (lambda docs: lambda d: sharding.shard(d, 5), ["size", "law", "shard", "slot", "grown_shard"]),
    "runs": (lambda docs: runs.periodic_runs, ["n_words", "runs", "collapsed"]),
    "packing": (lambda docs: lambda d: packing.pack(d, vocab.default_path("byte_bpe_50k.json"), size=64), ["start", "length", "doc_tokens"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(docs, name):
    make, outputs = OPERATORS[name]
    run = make(docs)
    extra = [c for c in [*HELPERS, *outputs]]
    wide = docs.select("*", *[F.lit("mine").alias(c) for c in extra])
    plain, clashing = run(docs), run(wide)
    rows = lambda df: sorted(map(repr, df.select("doc_id", *outputs).collect()))
    if name == "packing":  # which sequence a piece goes to depends on the tasks; the pieces' ids do not
        ends = lambda df: sorted(map(repr, df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()))
        assert ends(plain) == ends(clashing)
    else:
        assert rows(plain) == rows(clashing)
        for c in set(HELPERS) - set(outputs):
            if c in clashing.columns:
                assert clashing.where(f"`{c}` <> 'mine' or `{c}` is null").isEmpty(), c


def test_turns(spark):
    prepare(spark)
    path = vocab.default_path("byte_bpe_50k.tiktoken")
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "</s>"), (2, 1, None, None), (2, 1, None, None)],
                                  "conv_id long, turn int, role string, text string")
    wide = turns.select("*", *[F.lit("mine").alias(c) for c in [*HELPERS, "ids", "start", "length", "loss_start", "loss_from", "loss_length"]])
    rows = lambda df: sorted(map(repr, df.select("conv_id", "turn", "ids", "start", "length", "loss_start", "loss_length").collect()))
    assert rows(chat.format_turns(turns, path)) == rows(chat.format_turns(wide, path))
    assert chat.format_turns(wide, path).where("row <> 'mine' or cls <> 'mine'").isEmpty()
