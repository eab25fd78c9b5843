"""Operator 11: benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

Method.  The postings (term, row, position) of the training texts are written
as an index, each task's part in the order of its terms; terms of no test item
are never looked up and not stored, and the end of a text is a posting of the
empty term, at the number of the text's words.  A test item is cut into
windows of ten words; equal windows are one.  The window's terms are taken
from the rarest in the index on: the postings of the rarest, moved back by its
place in the window, are the candidate starts; those of the second rarest are
intersected with them; the few starts that are left are intersected with the
lists of all other terms at once.  A match is a start at which every list has
its posting.  With a ``slop``, each word may stand that many words off its
place: proximity matches.

Equal terms, windows and items meet only as counted or distinct rows, and the
candidates of a hot term lie apart by row and position.  A table is broadcast
only when its measured size is within BROADCAST_BYTES; beyond it the joins
shuffle, and adaptive execution splits hot terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickflow.llm.frames import written

#: Words of a window.
WIDTH = 10
#: Largest table sent whole to every task.
BROADCAST_BYTES = 32 << 20
#: A word before A-Z are lower-cased: digits, ASCII letters, and everything from U+0080 on.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: str) -> Column:
    """The words of a text in order, not lower-cased (none of a null)."""
    return F.coalesce(F.regexp_extract_all(F.col(text).cast("string"), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def term_of(word: Column) -> Column:
    """A word with A-Z lower-cased; other letters keep their case."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def broadcast_if_small(df: DataFrame, *texts: str) -> DataFrame:
    """``df``, marked for broadcast if its rows are counted to be within BROADCAST_BYTES (``texts``: its strings)."""
    row = F.lit(64)
    for text in texts:
        row = row + F.octet_length(text)
    total = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


@dataclass
class Items:
    """Test items, cut: ``grams`` (gram, length, offset, term) are the distinct windows, a row a word.

    ``classes`` (item, ids) has one row for all items of the same words, with
    their ids as sorted strings; ``members`` (gram, item) says which have a window.
    """
    grams: DataFrame
    members: DataFrame
    classes: DataFrame


def windows_of(items: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> Items:
    """The windows of all items; one of fewer words, but not none, is one window.  A null id is the id ''."""
    said = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"),
                        F.transform(raw_words(text), term_of).alias("words")).where(F.size("words") > 0)
    classes = written(said.groupBy("words").agg(F.sort_array(F.collect_set("id")).alias("ids"))
                      .withColumn("item", F.monotonically_increasing_id()), "items")
    placed = classes.select("item", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    last = F.greatest(F.col("n") - width, F.lit(0))
    cut = (placed.select("item", "at", "term", F.explode(F.sequence(F.greatest(F.col("at") - width + 1, F.lit(0)), F.least("at", last))).alias("w"))
           .groupBy("item", "w").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("words"))
           .select("item", F.col("words.term").alias("words")))
    grams = written(cut.select("words").distinct().withColumn("gram", F.monotonically_increasing_id()), "grams")
    members = written(cut.join(grams, "words").select("gram", "item").distinct(), "members")
    return Items(grams.select("gram", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term")),
                 members, classes.select("item", "ids"))


def build_index(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Postings of the ``terms`` in ``docs``: term, row, pos; at each text's end the empty term with doc, the other columns."""
    carried = F.struct(F.lit(0).alias("end"), *[F.col(c) for c in docs.columns if c.lower() != text.lower()])
    rows = docs.select(carried.alias("doc"), F.monotonically_increasing_id().alias("row"), raw_words(text).alias("words"))
    tokens = rows.select("doc", "row", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    wanted = terms.select("term").where("term <> ''").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    wanted = broadcast_if_small(written(wanted, "terms"), "term")
    held = tokens.select("doc", "row", "pos", term_of(F.col("word")).alias("term")).join(wanted, "term")
    index = held.select("term", "row", "pos", F.when(F.col("term") == "", F.col("doc")).alias("doc"))
    return written(index.sortWithinPartitions("term", "row", "pos"), "postings")


def by_rarity(grams: DataFrame, index: DataFrame) -> DataFrame:
    """``grams`` whose every term is in the index, with rank: 1 for the window's rarest word (ties: the first)."""
    often = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("often"))
    one = Window.partitionBy("gram")
    ranked = (grams.join(often, "term", "left").withColumn("least", F.min(F.coalesce("often", F.lit(0))).over(one))
              .withColumn("rank", F.row_number().over(one.orderBy("often", "offset"))))
    return written(ranked.where("least > 0").select("gram", "length", "offset", "term", "rank"), "ranked")


def matches(index: DataFrame, grams: DataFrame, slop: int = 0) -> DataFrame:
    """Where windows occur: (gram, row, start, length), each once.

    Every word of the window has an occurrence within ``slop`` words of its
    place from ``start`` on (0: the exact phrase).  Two places may share an
    occurrence.
    """
    ranked = by_rarity(grams, index)
    lists = index.where("term <> ''").select("term", "row", "pos")

    def moved(df: DataFrame, column: str, by: Column) -> DataFrame:
        """``df`` with ``column`` plus ``by``, once for each deviation allowed."""
        if not slop:
            return df.withColumn(column, F.col(column) + by)
        off = F.explode(F.array(*[F.lit(d) for d in range(-slop, slop + 1)]))
        return df.withColumn("off", off).withColumn(column, F.col(column) + by + F.col("off")).drop("off")

    rarest = broadcast_if_small(ranked.where("rank = 1"), "term")
    starts = moved(lists.join(rarest, "term").select("gram", "row", "length", "offset", F.col("pos").alias("start")),
                   "start", -F.col("offset")).where("start >= 0").select("gram", "row", "start", "length")
    second = ranked.where("rank = 2")
    asked = moved(starts.join(broadcast_if_small(second.select("gram", "offset", "term"), "term"), "gram")
                  .withColumn("pos", F.col("start")), "pos", F.col("offset"))
    some = lists.join(broadcast_if_small(second.select("term").distinct(), "term"), "term", "left_semi")
    pairs = asked.join(some, ["row", "pos", "term"]).select("gram", "row", "start", "length")
    # a proximity match may be asked for, and a posting found, more than once
    left = written((pairs.distinct() if slop else pairs).union(starts.where("length = 1")), "starts")
    rest = broadcast_if_small(ranked.where("rank > 2").select("gram", "offset", "term"), "term")
    asked = moved(left.join(rest, "gram").withColumn("pos", F.col("start")), "pos", F.col("offset"))
    here = broadcast_if_small(left.select("row").distinct())
    found = asked.join(lists.join(here, "row", "left_semi"), ["row", "pos", "term"])
    whole = (found.groupBy("gram", "row", "start", "length")
             .agg((F.count_distinct("offset") if slop else F.count("offset")).alias("n")).where("n = length - 2"))
    out = whole.drop("n").union(left.where("length <= 2"))
    return out.distinct() if slop else out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  width: int = WIDTH) -> DataFrame:
    """The columns of ``docs`` but the text, and n_words, n_hit, item_ids and contaminated.

    A window is ``width`` words in a row of an item, or a whole item of fewer;
    a document's word is hit if an exact occurrence of a window covers it.
    ``item_ids`` are the ids, as sorted strings without repeats, of the items
    with a window in the document.  A null or empty text has no words; rows
    are judged one by one, repeated rows alike, whatever their ids.  Without
    items nothing is hit.  Columns named like an output are replaced.
    """
    cut = windows_of(items, item, item_text, width)
    index = build_index(docs, cut.grams, text)
    hits = written(matches(index, cut.grams), "matches")
    words = (hits.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
             .distinct().groupBy("row").agg(F.count("*").alias("n_hit")))
    found = (hits.select("row", "gram").distinct().join(cut.members, "gram").select("row", "item").distinct()
             .join(cut.classes, "item").groupBy("row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids")))
    out = (index.where("term = ''").select("doc", "row", F.col("pos").cast("long").alias("n_words"))
           .join(words, "row", "left").join(found, "row", "left"))
    own = {"n_words": F.col("n_words"), "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
           "item_ids": F.coalesce("item_ids", F.array().cast("array<string>")), "contaminated": F.coalesce(F.col("n_hit") > 0, F.lit(False))}
    kept = [f.name for f in out.schema["doc"].dataType.fields[1:] if f.name.lower() not in own]
    return out.select(*[F.col("doc")[c].alias(c) for c in kept], *[c.alias(name) for name, c in own.items()])
