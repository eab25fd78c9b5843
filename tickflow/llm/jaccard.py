"""Operator 6: n-gram Jaccard join as a blocked sparse product of documents by n-grams.

Method.  The incidence matrix has a row of hashed shingles per distinct text.
Its product with itself is formed only where a pair can reach the threshold:

* A pair at Jaccard ``t`` shares one of the first ``n - ceil(t n) + 1``
  shingles of both texts in any common order (the size-derived bound of
  prefix filtering).  Only these are shuffled, as (shingle, text) rows.  The
  order puts very frequent shingles last, so that passages which many
  documents share make no candidates; it decides cost, never the result.
* Columns of the product with one text are dropped.  In each other column
  every text is paired with the column's pivot (its most central text) alone;
  pairs accumulate their counts over all columns, and each text's strongest
  pair is checked first, exactly, on whole texts.  Groups of copies become
  stars: no group's pairs are listed.
* The links found give components.  Then all pairs that share a column and
  are not yet in one component are formed, dropped where sizes rule them out,
  and checked exactly.  What they link is joined to the components; a link
  inside a component changes nothing, so the components are those of all
  links.

Exact checks work on blocks of pairs: rows of the incidence matrix are made
once for each distinct text of a block, with the shingles numbered by their
words, not hashed, and overlaps are counted by merging.  Candidates come from
64-bit hashes of the words' bytes, which equal shingles share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.llm.frames import components, outputs_last, written
from tickflow.llm.text import U64, byte_hashes, give_back, shingle_hashes, sliced, texts_of, tidy, words_of

#: Words in a shingle; percent of the union that must be shared.
SHINGLE, PERCENT = 5, 80
#: Text bytes of one unit of work: its words and shingles take many times that.
BLOCK_BYTES = 4 << 20
#: Shingles counted at once in a task, on the way to the frequent ones.
COUNT_BLOCK = 4 << 20
#: A shingle this frequent goes to the end of the order; so many of them at most (8 MB), the most frequent.
FREQUENT, MOST_FREQUENT = 24, 1_000_000


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, a text without words none."""
    codes, offsets, words = words_of(texts)
    hashes = byte_hashes(words)[codes] if len(codes) else np.empty(0, U64)
    every = shingle_hashes(hashes, width)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            own = np.sort(every[a:b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(shingle_hashes(hashes[a:b], b - a) + U64(b - a))
        else:
            out.append(every[:0])
    return out


def numbered_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """As :func:`shingle_sets`, with numbers that stand for the shingles of these texts exactly."""
    codes, offsets, _ = words_of(texts)
    ids, length = codes, 1
    while length < width and len(ids) > 1:  # numbers of longer runs from those of two shorter ones
        step = length if 2 * length <= width else 1
        tail = (ids if step == length else codes)[length:][:len(codes) - length - step + 1]
        head = ids[:len(tail)]
        ids = np.unique(head * (int(tail.max(initial=0)) + 1) + tail, return_inverse=True)[1]
        length += step
    short: dict[tuple, int] = {}
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(ids[a:b - width + 1]))
        elif b > a:
            out.append(np.array([-1 - short.setdefault(tuple(codes[a:b].tolist()), len(short))]))
        else:
            out.append(codes[:0])
    return out


def prefix(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(percent n / 100) + 1 shingles, frequent ones last, else by hash."""
    n = len(shingles)
    length = n - -(-percent * n // 100) + 1 if n else 0
    if not len(frequent) or not length:
        return shingles[:length]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    late = frequent[at] == shingles
    return np.concatenate([shingles[~late], shingles[late]])[:length]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _sets(batch: pa.RecordBatch, seen: set | None, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of the batch's texts, each distinct text of a task once if ``seen`` is given."""
    rows = []
    for i, t in enumerate(batch.column("t").to_pylist()):
        if seen is None or t not in seen:
            rows.append(i)
            if seen is not None:
                seen.add(t)
    yield from zip(rows, shingle_sets(texts_of(batch, "text").take(pa.array(rows, pa.int64())), width))


def _sizes_and_counts(width: int):
    """Rows (t, n, null, null) of distinct texts, and (null, null, shingle, times) of shingles seen again."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "n", "shingle", "times"]
        seen: set = set()
        held_sets: list[np.ndarray] = []
        held = 0

        def counted():
            value, times = np.unique(np.concatenate(held_sets), return_counts=True)
            value, times = value[times > 1].view(np.int64), times[times > 1]
            null = pa.nulls(len(value), pa.int64())
            return pa.RecordBatch.from_arrays([null, null, pa.array(value), pa.array(times.astype(np.int64))], names=names)

        for batch in sliced(batches, "text", BLOCK_BYTES):
            t, rows, sizes = batch.column("t"), [], []
            for i, own in _sets(batch, seen, width):
                rows.append(i)
                sizes.append(len(own))
                held_sets.append(own)
                held += len(own)
            null = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([t.take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), null, null], names=names)
            if held >= COUNT_BLOCK:
                yield counted()
                held_sets, held = [], 0
            give_back()
        if held_sets:
            yield counted()
    return run


def _prefix_rows(frequent, width: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in sliced(batches, "text", BLOCK_BYTES):
            t, shingle, size = batch.column("t").to_numpy(), [], []
            rows = []
            for i, own in _sets(batch, seen, width):
                rows.append(i)
                shingle.append(prefix(own, frequent.value, percent))
                size.append(len(own))
            if not rows:
                continue
            lengths = [len(s) for s in shingle]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(shingle).view(np.int64)), pa.array(np.repeat(t[rows], lengths)),
                 pa.array(np.repeat(np.asarray(size, np.int32), lengths))], names=["shingle", "t", "n"])
            del shingle
            give_back()
    return run


def _reach(part: pa.RecordBatch, sets_of, percent: int) -> np.ndarray:
    """Which pairs of texts reach the threshold, by the sets that ``sets_of`` makes of the distinct texts."""
    left, right = (part.column(c).dictionary_encode() for c in ("left", "right"))
    sets = sets_of(pa.concat_arrays([left.dictionary, right.dictionary]))
    a, b = sets[:len(left.dictionary)], sets[len(left.dictionary):]
    keep = []
    for i, j in zip(left.indices.to_pylist(), right.indices.to_pylist()):
        x, y = a[i], b[j]
        least = -(-percent * max(len(x), len(y)) // 100)  # an intersection below cannot do
        common = overlap(x, y) if min(len(x), len(y)) >= max(least, 1) else 0
        keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
    return np.array(keep, bool)


def _linked(width: int, percent: int):
    """Pairs of texts to those that reach the threshold: by hashes, and those that do once more by numbered shingles."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                part = part.filter(pa.array(_reach(part, lambda texts: shingle_sets(texts, width), percent)))
                if part.num_rows:
                    part = part.filter(pa.array(_reach(part, lambda texts: numbered_sets(texts, width), percent)))
                yield part.select(["a", "b"])
    return run


def least_common(n: str, m: str, percent: int) -> Column:
    """Prefix shingles that two sets of n and m must share to reach the threshold.

    An overlap of ``percent`` of the union is at least percent (n + m) /
    (100 + percent).  Of the set whose prefix ends first in the order, the
    common shingles that are not in both prefixes lie behind its prefix.
    """
    rest = lambda c: f"((99L + {percent} * {c}) div 100 - 1)"
    return F.expr(f"greatest(1L, {_need(n, m, percent)} - greatest({rest(n)}, {rest(m)}))")


def _need(n: str, m: str, percent: int) -> str:
    """SQL of the overlap that two sets of n and m need."""
    return f"((99L + {percent} + {percent}L * ({n} + {m})) div {100 + percent})"


def _checked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b), and those of them that are linked, by the whole texts (t, text)."""
    pairs = written(pairs, "jaccard")
    if pairs.isEmpty():
        return pairs, pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
    found = written(texts.dropDuplicates(["t"]).join(ends, "t"), "jaccard")  # each needed text once
    left = found.select(F.col("t").alias("a"), F.col("text").alias("left"))
    right = found.select(F.col("t").alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return pairs, written(both.mapInArrow(tidy(_linked(width, percent)), "a long, b long"), "jaccard")


def _apart(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of texts of two components that share as many prefix shingles as their sizes ask for.

    ``placed`` has distinct rows (shingle, t, n, root).  Columns of one
    component cannot be common to such a pair: a text's row keeps the others,
    rare ones first, and its length bounds the text's overlaps.  Two lists
    with k common members share one of all but the last k - 1 members of
    both; where they do, the lists are compared.
    """
    several = (placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("texts"))
               .where("low < high").select("shingle", "texts"))
    lists = (placed.join(several, "shingle").groupBy("t", "n", "root")
             .agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("own"))  # one text's shingles at most
             .select("t", "n", "root", F.col("own.shingle").alias("own")))
    lists = written(lists, "jaccard")
    rows = lists.select("t", "n", "root", F.size("own").alias("size"), F.posexplode("own").alias("at", "shingle"))
    a, b = (rows.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("t", "n", "root", "size", "at")])
            for side in "ab")
    least = least_common("n_a", "n_b", percent)
    pairs = (a.join(b, "shingle").where("t_a < t_b and root_a <> root_b")
             .where(f"100L * least(n_a, n_b) >= {percent}L * greatest(n_a, n_b)")
             .where(F.least(F.expr("size_a - at_a"), F.expr("size_b - at_b")) >= least)
             .select(F.col("t_a").alias("a"), F.col("t_b").alias("b"), least.alias("least")).distinct())
    own_a, own_b = (lists.select(F.col("t").alias(side), F.col("own").alias(f"own_{side}")) for side in "ab")
    return (pairs.join(own_a, "a").join(own_b, "b")
            .where(F.size(F.array_intersect("own_a", "own_b")) >= F.col("least")).select("a", "b"))


def near_duplicate_components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE,
                              percent: int = PERCENT, frequent: int = FREQUENT, group: str | None = None) -> DataFrame:
    """``docs`` plus n_shingles (size of its set) and component_id (smallest key reachable by links).

    ``group`` names one more column: a number that tells components apart
    even where their keys repeat (null for rows linked with nothing by rule).

    Words are runs of characters but ASCII white space, A-Z lower-cased.  Two
    documents are linked if 100 * intersection >= percent * union of their
    sets of ``width``-word shingles; a text of fewer words is one shingle; a
    null text, or one without words, has none and is linked with nothing.
    Rows with equal texts are linked; a null key counts as larger than all.
    Columns named like an output are replaced.
    """
    spark = docs.sparkSession
    source = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("id"),
                         F.col(text).cast("string").alias("text"))
    source = source.withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = source.where("text is not null").select("t", "text")
    base = written(texts.mapInArrow(tidy(_sizes_and_counts(width)), "t long, n long, shingle long, times long"), "jaccard")
    often = (base.where("t is null").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= frequent)
             .orderBy(F.desc("times"), "shingle").limit(MOST_FREQUENT).select("shingle").toPandas()["shingle"])
    shared = spark.sparkContext.broadcast(np.sort(often.to_numpy(np.int64).view(U64)))  # MOST_FREQUENT hashes at most
    columns = texts.mapInArrow(tidy(_prefix_rows(shared, width, percent)), "shingle long, t long, n int")
    shared_columns = columns.groupBy("shingle").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("texts"))
    product = written(columns.join(shared_columns.where("low < high").select("shingle", "texts"), "shingle"), "jaccard")
    # a column's pivot is its most central text: a text that shares more of its shingles, with more texts, is nearer to
    # the middle of its group
    central = product.groupBy("t").agg((F.sum(F.log2("texts")) / F.max("n")).alias("weight"))
    weighed = product.select("shingle", "t", "n").join(central, "t")
    pivots = weighed.groupBy("shingle").agg(F.max_by("t", "weight").alias("pivot"))
    sizes = base.where("t is not null").select("t", "n").distinct()
    pairs = (product.select("shingle", "t", "n").join(pivots, "shingle").where("t <> pivot")
             .groupBy("t", "n", "pivot").agg(F.count("*").alias("common"))
             .join(sizes.select(F.col("t").alias("pivot"), F.col("n").alias("m")), "pivot"))
    strongest = (pairs.where(F.col("common") >= least_common("n", "m", percent))
                 .groupBy("t").agg(F.max(F.struct("common", "pivot")).alias("best"))
                 .select(F.col("t").alias("a"), F.col("best.pivot").alias("b")))
    known, links = _checked(strongest, texts, width, percent)
    roots = written(components(links, spark), "jaccard")
    placed = (product.join(roots.withColumnRenamed("node", "t"), "t", "left")
              .select("shingle", "t", "n", F.coalesce("root", "t").alias("root")).distinct())
    apart = _apart(placed, percent)
    known = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    _, more = _checked(apart.join(known, ["a", "b"], "left_anti"), texts, width, percent)
    if not more.isEmpty():
        roots = components(links.union(more), spark)
    nodes = (sizes.where("n > 0").join(roots.withColumnRenamed("node", "t"), "t", "left")
             .select("t", "n", F.coalesce("root", "t").alias("root")))  # no words: linked with nothing
    second = F.xxhash64(F.lit(23), F.coalesce("text", F.lit("")))
    smallest = source.groupBy("t").agg(F.min("id").alias("id"), F.min(second).alias("h1"), F.max(second).alias("h2"))
    smallest = smallest.withColumn("id", F.when(F.col("h1") == F.col("h2"), F.col("id")).otherwise(
        F.raise_error(F.lit("two texts share a hash")).cast(source.schema["id"].dataType))).join(nodes, "t")
    names = smallest.groupBy("root").agg(F.min("id").alias("component"))
    named = nodes.join(names, "root").select("t", "n", "component", "root")
    out = (source.select("row", "id", "t").join(named, "t", "left")
           .select("row", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                   F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"), "root"))
    return outputs_last(out, "row", n_shingles="n", component_id="component", **({group: "root"} if group else {}))
