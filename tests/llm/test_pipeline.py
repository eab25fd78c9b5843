"""The pipeline's stages: columns, effects, and the guard of the entry module."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_columns_and_filter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.lit(None).cast("string"))
    now = docs.union(extra)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, sf_dir).cache()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            assert after.count() <= now.count()
            assert after.select("doc_id").distinct().count() == after.count()
        if i == 0:
            assert after.where("text is null").isEmpty()  # no letter: und
            assert after.count() == docs.count()
        now = after
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(now.columns)


def test_stages_take_an_empty_table(spark, sf_dir):
    now = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        assert now.count() == 0


def test_stages_with_nulls_repeats_and_clashing_names(spark, sf_dir):
    """Columns named like the operators' outputs pass through; rows of one id are told apart; nulls stay nulls."""
    long = " ".join(f"word{i} and the rest of it," for i in range(120)) + " end."
    other = " ".join(f"another{i} thing that was said" for i in range(120)) + " here."
    edited = long.replace("word7 ", "edited ")
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, row string, t string, group string"
    rows = [(1, long), (1, other), (2, long), (3, edited), (4, None), (5, ""), (5, ""), (None, "x y"), (None, other), (6, "x y"), (1, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "sp", "r", "t", "g") for i, t in rows], schema)

    first = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert first.schema.simpleString() == docs.schema.simpleString()
    left = sorted(((r["doc_id"], r["text"]) for r in first.collect()), key=repr)
    # 1 stands for long and its copies, and, apart, for other; no words, no link
    assert left == sorted([(1, long), (1, other), (4, None), (5, ""), (5, ""), (6, "x y")], key=repr)

    cut = corpus_pipeline.cut_repeated_passages(spark, docs, sf_dir)
    assert cut.schema.simpleString() == docs.schema.simpleString()
    got = cut.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["kept"], r["spans"], r["row"], r["t"], r["group"], r["source"]) == ("k", "sp", "r", "t", "g", "s")
        assert r["n_chars"] == len(r["text"] or "")
    by_text = {t: {r["text"] for r in got if r["doc_id"] == i} for i, t in rows}
    assert by_text[None] == {None} and by_text["x y"] >= {"x y"} and by_text[""] == {""}
    assert all(r["text"] == "" for r in got if r["doc_id"] == 2)  # a whole copy goes

    packed = corpus_pipeline.pack_sequences(spark, docs, sf_dir)
    ends = packed.where("start + length = doc_tokens").groupBy("doc_id").count()
    assert {r["doc_id"]: r["count"] for r in ends.collect()} == {1: 3, 2: 1, 3: 1, 4: 1, 5: 2, None: 2, 6: 1}

    for stage in (corpus_pipeline.identify_language, corpus_pipeline.filter_quality):
        learned = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
        more = learned.unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars")).withColumn("lang_pred", F.lit("p")).withColumn("kept", F.lit("k"))
        out = stage(spark, more, sf_dir)
        assert out.schema.simpleString() == more.schema.simpleString()
        assert out.where("lang_pred <> 'p' or kept <> 'k' or text is null").isEmpty()
        assert out.where("text = ''").isEmpty()
