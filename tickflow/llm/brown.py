"""Operator 3: language-model scoring by Brown class-based n-grams.

Method.  Exchange clustering assigns words to classes; a text's probability
is the product over its tokens of P(class | class before) * P(word | class),
smoothed.  The clustering is distributed in the way of Uszkoreit and Brants
(2008):

1. Counts of all words of the training documents (one shuffle by word).
2. Bigram counts among the ``CLUSTERED`` most frequent words over the whole
   corpus, a table of fixed size, and exchange clustering of these words on
   it: each moves in turn to the class that raises the likelihood most.
3. All other words are exchanged in rounds over classes of their own, beside
   the frequent words'.  The counts of the classes around each word are folded
   once over the whole corpus; in each round every word moves to the class
   that raises the likelihood most given the tables of the round before, and
   the tables are summed anew, until hardly a word moves.
4. Transition counts between the classes of all training tokens, and word
   counts, give the probabilities.

Texts are worked on in blocks of some MB.  A block sends one row per distinct
word (never one per token; the frequent words' counts and classes go with the
task), gets back the word's count and class, and turns its texts into
sequences of classes, which are written once and then read for the transition
counts and for the scores.  A word has one row per block at most, and its
contexts are folded as they come, so no word is a hot key.

An unseen word gets the mass of the words seen once in a class (Witten and
Bell's share), divided by the estimated number of unseen words (Chao, 1984);
after one the average row of the rare words' classes is used.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.llm.frames import outputs_last, written
from tickflow.llm.text import pack_varints, sliced, sums, texts_of, tidy, unpack_varints, words_of

#: Frequent words that are clustered on a full bigram table, their classes (the other words have as many), and rounds of exchange.
CLUSTERED, CLASSES, ROUNDS = 2048, 64, 6
#: Rounds of exchange of the other words at most; they end when a smaller share of the tokens moves.
ALL_ROUNDS, MOVED = 4, 0.01
#: Places of a word in one row.
PLACES = 1 << 16
#: The end of a text, as a token.
END = "\n"
#: Weight of the class unigrams in the transitions (a Dirichlet prior).
PRIOR = 20.0


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, fixed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of words by exchange clustering on a table of bigram counts.

    The last ``fixed`` words keep classes of their own (from ``classes`` on).
    The likelihood is the sum of N(a,b) log N(a,b) over class pairs less the
    two class unigram terms; each word in turn moves to the best class.
    """
    n = len(bigrams) - fixed
    size = classes + fixed
    cls = np.concatenate([np.arange(n) % classes, classes + np.arange(fixed)])
    # counts with each class to the left and to the right
    before = np.stack([bigrams[cls == c].sum(axis=0) for c in range(size)], axis=1)
    after = np.stack([bigrams[:, cls == c].sum(axis=1) for c in range(size)], axis=1)
    table = np.stack([after[cls == c].sum(axis=0) for c in range(size)])
    own = np.diag(bigrams)
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            a, left, right, twice = cls[w], before[w].copy(), after[w].copy(), own[w]
            left[a] -= twice
            right[a] -= twice  # contexts without the word itself
            table[:, a] -= left
            table[a, :] -= right
            table[a, a] -= twice
            rows, cols = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]
            inside = table[:classes, :classes]
            gain = (_xlogx(table[:, :classes] + left[:, None]) - _xlogx(table[:, :classes])).sum(axis=0)
            gain += (_xlogx(table[:classes, :] + right) - _xlogx(table[:classes, :])).sum(axis=1)
            diagonal, l, r = np.diag(inside), left[:classes], right[:classes]
            gain += _xlogx(diagonal + l + r + twice) - _xlogx(diagonal + l) - _xlogx(diagonal + r) + _xlogx(diagonal)
            gain -= _xlogx(rows + right.sum() + twice) - _xlogx(rows) + _xlogx(cols + left.sum() + twice) - _xlogx(cols)
            b = int(np.argmax(gain))
            if gain[a] >= gain[b] - 1e-9:
                b = int(a)
            table[:, b] += left
            table[b, :] += right
            table[b, b] += twice
            if b != a:
                moved += 1
                cls[w] = b
                before[:, a] -= bigrams[w]  # the word stands to the left of others
                before[:, b] += bigrams[w]
                after[:, a] -= bigrams[:, w]
                after[:, b] += bigrams[:, w]
        if not moved:
            break
    return cls


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in sliced(batches, "text"):
        yield batch, *words_of(texts_of(batch, "text"))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch, codes, offsets, words in _cut(batches):
        digest = xxhash.xxh3_64(offsets.tobytes())
        digest.update(codes.tobytes())
        digest.update("\n".join(words.to_pylist()))
        yield batch, codes, offsets, words, np.uint64(digest.intdigest()).astype(np.int64)


def _tokens(codes: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens with an ``end`` after each text, and each text's offsets."""
    n = len(offsets) - 1
    out = np.full(len(codes) + n, end, np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(offsets))] = codes
    return out, offsets + np.arange(n + 1)


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, codes, _, words in _cut(batches):
        count = np.bincount(codes, minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END])]), pa.array(np.append(count, batch.num_rows))],
                                         names=["word", "n"])


def _ranks_of(words: pa.Array, frequent: pa.Array) -> np.ndarray:
    """Place of each word among the frequent ones; len(frequent) for others."""
    place = pc.fill_null(pc.index_in(words, frequent), len(frequent))
    return place.to_numpy(zero_copy_only=False).astype(np.int64)


def _bigram_counts(frequent: pa.Array):
    """Counts (pair) among frequent words, all others as one, and the end: pair = left * size + right."""
    k = len(frequent)
    size = k + 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, offsets, words in _cut(batches):
            tokens, _ = _tokens(_ranks_of(words, frequent)[codes], offsets, k + 1)
            pair = np.concatenate([[k + 1], tokens[:-1]]) * size + tokens
            value, n = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], names=["pair", "n"])
    return run


def _as_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and counts of a batch as one row of bytes."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
                                          for c in ("pair", "n")], names=["pair", "n"])


def _word_rows(frequent: pa.Array, classes: np.ndarray, size: int):
    """(block, code, word, n, around) of the words that are not frequent: training count in the block, classes around as bin, count.

    Bins: ``size`` classes to the left, then as many to the right; packed as
    varints of bin and count in turn.
    """
    k = len(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes, offsets, words, block in _blocks(batches):
            rank = _ranks_of(words, frequent)
            tokens, cut = _tokens(codes, offsets, len(words))
            kind = np.append(classes[rank], classes[k + 1])[tokens]
            train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), np.diff(cut))
            left = np.concatenate([[classes[k + 1]], kind[:-1]])
            right = np.concatenate([kind[1:], [classes[k + 1]]])
            rare = train & (tokens < len(words)) & (kind == classes[k])
            around = np.concatenate([tokens[rare] * 2 * size + left[rare], tokens[rare] * 2 * size + size + right[rare]])
            value, count = np.unique(around, return_counts=True)
            flat = np.empty(2 * len(value), np.int64)
            flat[::2], flat[1::2] = value % (2 * size), count
            where = 2 * np.searchsorted(value // (2 * size), np.arange(len(words) + 1))
            n = np.bincount(tokens[rare], minlength=len(words))
            packed = pa.array(pack_varints(flat, where), pa.binary())
            own = np.flatnonzero(rank == k)
            for at in range(0, len(own), 1 << 16):
                some = own[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), block)), pa.array(some.astype(np.int32)), words.take(pa.array(some)),
                     pa.array(n[some].astype(np.int64)), packed.take(pa.array(some))],
                    names=["block", "code", "word", "n", "around"])
    return run


def _fold(size: int):
    """Rows sorted by word to a row per word: n, the bins and counts around it, and where it stands (blocks, codes).

    A word's contexts are added up as its rows come; one of more than PLACES
    places has several rows, of which one is ``first``.
    """
    bins = 2 * size

    def rows(n, first, owner, place, count, blocks, codes, cut) -> pa.RecordBatch:
        where = np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)
        listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
        return pa.RecordBatch.from_arrays(
            [pa.array(n.astype(np.int64)), pa.array(first), listed(where, place.astype(np.int32)),
             listed(where, count.astype(np.int64)), listed(cut.astype(np.int32), blocks), listed(cut.astype(np.int32), codes)],
            names=["n", "first", "bins", "counts", "blocks", "codes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # the word that may go on: itself, n, its contexts, its places

        def closed() -> Iterator[pa.RecordBatch]:
            _, n, seen, places = open_
            blocks, codes = (np.concatenate([p[k] for p in places]) for k in (0, 1))
            place = np.flatnonzero(seen)
            for at in range(0, len(blocks), PLACES):
                part = slice(at, at + PLACES)
                yield rows(np.array([n]), np.array([at == 0]), np.zeros(len(place), np.int64), place, seen[place],
                           blocks[part], codes[part], np.array([0, len(blocks[part])]))

        for batch in batches:
            block, code = batch.column("block").to_numpy(), batch.column("code").to_numpy()
            word = batch.column("word").dictionary_encode()
            index = word.indices.to_numpy().astype(np.int64)
            names = word.dictionary
            if not len(names):
                continue
            n = np.bincount(index, batch.column("n").to_numpy(), len(names))
            flat, where = unpack_varints(batch.column("around"))
            key, of = np.unique(np.repeat(index, np.diff(where) // 2) * bins + flat[::2], return_inverse=True)
            count = np.bincount(of, flat[1::2], len(key))
            owner, place = key // bins, key % bins
            dense = lambda w: np.bincount(place[owner == w], count[owner == w], bins).astype(np.int64)
            cut = np.searchsorted(index, np.arange(len(names) + 1))
            begin, last = 0, len(names) - 1
            if open_ is not None and open_[0] == names[0].as_py():
                open_[1] += n[0]
                open_[2] += dense(0)
                open_[3].append((block[:cut[1]], code[:cut[1]]))
                begin = 1
            if begin > last:
                continue
            if open_ is not None:
                yield from closed()
            if begin < last:
                at = cut[begin:last + 1]
                low, high = np.searchsorted(owner, [begin, last])
                yield rows(n[begin:last], np.ones(last - begin, bool), owner[low:high] - begin, place[low:high], count[low:high],
                           block[at[0]:at[-1]], code[at[0]:at[-1]], at - at[0])
            open_ = [names[last].as_py(), n[last], dense(last), [(block[cut[last]:], code[cut[last]:])]]
        if open_ is not None:
            yield from closed()
    return run


#: Words whose classes are weighed at once.
WEIGHED = 1024


def _contexts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the words of a batch in their bins, the bins, and the counts."""
    bins = batch.column("bins")
    offsets = bins.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], bins.flatten().to_numpy().astype(np.int64), batch.column("counts").flatten().to_numpy()


def weights_of(tables: np.ndarray) -> np.ndarray:
    """(bins, classes): what one count around a word adds to the likelihood in each class.

    ``tables`` (classes, bins) counts what stands around each class's words.
    The likelihood's slope is the log count around, less the class's own
    term; a word has two neighbours a token, which makes both terms of it.
    """
    smooth = tables + 0.1
    return (np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True) / 2)).T.copy()


def best_class(offsets: np.ndarray, bins: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The class that each word raises the likelihood of most (0 for a word without contexts)."""
    gain = np.zeros((len(offsets) - 1, weights.shape[1]))
    real = np.flatnonzero(np.diff(offsets))
    if len(real):
        each = weights[bins]
        each *= counts[:, None]
        gain[real] = np.add.reduceat(each, offsets[real], axis=0)
    return np.argmax(gain, axis=1)


def _exchange_round(tables: np.ndarray, before: np.ndarray | None):
    """Sums (bin of all classes' tables, n) of the words in their best classes; bin -1: tokens of words that moved."""
    classes, bins = tables.shape
    now, then = weights_of(tables), None if before is None else weights_of(before)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, moved = np.zeros(classes * bins), 0
        for batch in batches:
            for at in range(0, batch.num_rows, WEIGHED):
                part = batch.slice(at, WEIGHED)
                offsets, place, count = _contexts(part)
                n = part.column("n").to_numpy()
                cls = best_class(offsets, place, count, now)
                total += np.bincount(np.repeat(cls, np.diff(offsets)) * bins + place, count, classes * bins)
                moved += int(n.sum() if then is None else n[cls != best_class(offsets, place, count, then)].sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], moved).astype(np.int64))],
                                         names=["bin", "n"])
    return run


def _exchange_all(words: DataFrame, tables: np.ndarray, rounds: int = ALL_ROUNDS) -> np.ndarray:
    """The tables (some thousand numbers) after rounds of exchange of all words, from those given."""
    some = words.where("first and n > 0").select("n", "bins", "counts")
    before, tokens = None, None
    for _ in range(rounds):
        sums_ = some.mapInArrow(tidy(_exchange_round(tables, before)), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
        if sums_.empty:
            break
        at, n = sums_["bin"].to_numpy(np.int64), sums_["n"].to_numpy(np.float64)
        moved = n[at < 0].sum()
        tokens = moved if tokens is None else tokens
        if moved <= MOVED * tokens and before is not None:
            break
        before, tables = tables, np.zeros(tables.shape)
        tables.ravel()[at[at >= 0]] = n[at >= 0]
    return tables


def _classify(tables: np.ndarray, first_class: int):
    """Rows of words to (block, code, n, cls): the word's count in the corpus, and its class (-1: not in training)."""
    weights = weights_of(tables)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, WEIGHED):
                part = batch.slice(at, WEIGHED)
                n = part.column("n").to_numpy()
                cls = np.where(n > 0, first_class + best_class(*_contexts(part), weights), -1)
                blocks, codes = part.column("blocks"), part.column("codes")
                word = np.repeat(np.arange(len(n)), np.diff(blocks.offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays(
                    [blocks.flatten(), codes.flatten(), pa.array(n[word]), pa.array(cls[word].astype(np.int32))],
                    names=["block", "code", "n", "cls"])
    return run


def _sequences(frequent: pa.Array):
    """Rows with their words as codes; the block's first row has the codes' table, and which of them are frequent words."""
    k = len(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes, offsets, words, block in _blocks(batches):
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words get short codes
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            place = _ranks_of(words, frequent)
            known = np.where(place < k, place + 1, 0)
            first = [pack_varints(x, np.array([0, len(order)]))[0] for x in (order, known)]
            table, known = ([x] + [None] * (batch.num_rows - 1) for x in first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, block)), batch.column("row"), batch.column("train"),
                 pa.array(pack_varints(rank[codes] if len(codes) else codes, offsets), pa.binary()), pa.array(table, pa.binary()),
                 pa.array(known, pa.binary())], names=["block", "row", "train", "codes", "table", "known"])
    return run


def _assemble(end_count: int, end_class: int, total: int, distinct: int, unknown: int, top_count: np.ndarray, top_class: np.ndarray):
    """Texts as classes of tokens, with the parts of their scores that need counts alone."""
    def run(key, rows: pa.Table, words: pa.Table) -> pa.Table:
        rows, words = rows.combine_chunks(), words.combine_chunks()
        code, first = np.unique(words.column("code").to_numpy(), return_index=True)  # copies of a block repeat its words
        order, known = (unpack_varints(rows.column(c).combine_chunks().drop_null().slice(0, 1))[0] for c in ("table", "known"))
        frequent = np.flatnonzero(known)
        if len(code) + len(frequent) != len(order):
            raise ValueError("word counts are missing: the input changed between its readings; write it first")
        n, cls = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        n[code], cls[code] = words.column("n").to_numpy()[first], words.column("cls").to_numpy()[first]
        n[frequent], cls[frequent] = top_count[known[frequent] - 1], top_class[known[frequent] - 1]
        n, cls = np.append(n[order], end_count), np.append(cls[order], end_class if end_count else -1)
        cls[cls < 0] = unknown
        rare = np.log10((n + 0.1) / (total + 0.1 * (distinct + 1)))
        own = np.where(n > 0, np.log10(np.maximum(n, 1)), 0.0)
        out = {c: [] for c in ("n_tokens", "n_known", "base", "own", "classes")}
        packed = rows.column("codes").combine_chunks()
        for at in range(0, len(rows), 512):
            codes, offsets = unpack_varints(packed.slice(at, 512))
            tokens, cut = _tokens(codes, offsets, len(order))
            out["n_tokens"] += np.diff(cut).tolist()
            out["n_known"] += sums((n > 0).astype(np.int64)[tokens], cut).tolist()
            out["base"] += [float(x.sum()) for x in np.split(rare[tokens], cut[1:-1])]
            out["own"] += [float(x.sum()) for x in np.split(own[tokens], cut[1:-1])]
            raw = cls[tokens].astype(np.uint8).tobytes()
            out["classes"] += [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.table([rows.column("row"), rows.column("train"), pa.array(out["n_tokens"], pa.int64()),
                         pa.array(out["n_known"], pa.int64()), pa.array(out["base"], pa.float64()),
                         pa.array(out["own"], pa.float64()), pa.array(out["classes"], pa.binary())],
                        names=["row", "train", "n_tokens", "n_known", "base", "own", "classes"])
    return run


def _class_pairs(raw: list[bytes], end_class: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before and class of all tokens, and each text's offsets."""
    cut = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    after = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    before = np.concatenate([[end_class], after[:-1]])
    before[cut[:-1]] = end_class
    return before, after, cut


def score(docs: DataFrame, train: Column, text: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES) -> DataFrame:
    """``docs`` without its text, plus n_tokens, n_known, train_tokens, base_score and score of each whole text.

    ``train`` tells the training documents, all of which are learned from.
    Tokens are the words (A-Z lower-cased) and one end; ``score`` is the
    model's log10 probability of the tokens, ``base_score`` that of smoothed
    word counts.  A null text is its end alone.  Without any training
    document both are 0 for each token.  Columns named like an output are
    replaced.
    """
    if not 0 < classes <= 120:
        raise ValueError("classes are kept in a byte: 120 at most")
    spark = docs.sparkSession
    others = [F.col(c) for c in docs.columns if c.lower() != text.lower()]
    source = docs.select(F.struct(*(others or [F.lit(None).cast("int").alias("_")])).alias("row"),
                         F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    learned = source.where("train").select("text")
    counts = written(learned.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "brown")
    total, distinct, once, both = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(clustered).toPandas()
    ends = counts.where(F.col("word") == END).select("n").collect()
    end_count = ends[0][0] if ends else 0
    frequent = pa.array(top["word"].tolist(), pa.string())
    size, k = classes + 2, len(frequent)  # classes of frequent words, of all others together, of the end
    pairs = learned.mapInArrow(_bigram_counts(frequent), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    bigrams = np.zeros((k + 2) ** 2)
    for part in written(pairs, "brown").mapInArrow(_as_bytes, "pair binary, n binary").toLocalIterator():  # (clustered + 2) squared pairs at most
        bigrams[np.frombuffer(part["pair"], np.int64)] = np.frombuffer(part["n"], np.int64)
    around = bigrams.reshape(k + 2, k + 2)
    cls = exchange(around, classes, 2)
    rows = np.stack([around[cls == c].sum(axis=0) for c in range(size)])
    table = np.stack([rows[:, cls == c].sum(axis=1) for c in range(size)], axis=1)
    del around, bigrams, rows
    unknown, end_class = size + classes, classes + 1
    near = written(source.select("text", "train").mapInArrow(
        _word_rows(frequent, cls, size), "block long, code int, word string, n long, around binary")
        .repartition("word").sortWithinPartitions("word").mapInArrow(
            tidy(_fold(size)), "n long, first boolean, bins array<int>, counts array<long>, blocks array<long>, codes array<int>"), "brown")
    # the classes of the other words begin as the frequent words' are
    tables = _exchange_all(near, np.hstack([table[:, :classes].T, table[:classes]]))
    words = near.select("n", "bins", "counts", "blocks", "codes").mapInArrow(
        tidy(_classify(tables, size)), "block long, code int, n long, cls int")
    schema = T.StructType([T.StructField("block", T.LongType()), source.schema["row"], source.schema["train"],
                           *[T.StructField(c, T.BinaryType()) for c in ("codes", "table", "known")]])
    result = T.StructType([source.schema["row"], source.schema["train"], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
                           *[T.StructField(c, T.DoubleType()) for c in ("base", "own")], T.StructField("classes", T.BinaryType())])
    assemble = _assemble(end_count, end_class, total, distinct, unknown, top["n"].to_numpy(np.int64), cls[:k])
    ready = written(source.mapInArrow(_sequences(frequent), schema).groupBy("block").cogroup(words.groupBy("block"))
                    .applyInArrow(assemble, result), "brown")
    model = _estimate(ready, size + classes + 1, end_class, unknown, size, once, both)
    shared = spark.sparkContext.broadcast(model)  # some thousand numbers

    @F.pandas_udf("double")
    def class_score(raw, own):
        import pandas as pd

        transition, emission = shared.value
        before, after, cut = _class_pairs(list(raw), end_class)
        each = transition[before, after] + emission[after]
        return pd.Series([float(x.sum()) for x in np.split(each, cut[1:-1])]) + own.to_numpy()

    ready = ready.withColumn("score", class_score("classes", "own") if total else F.col("base"))
    out = outputs_last(ready, "row", n_tokens="n_tokens", n_known="n_known", train_tokens=F.lit(total).cast("long"),
                       base_score="base", score="score")
    return out if others else out.drop("_")


def _estimate(ready: DataFrame, n: int, end_class: int, unknown: int, rare: int, once: int, twice: int):
    """log10 of the transitions, and of a class's emissions less the word's count (for unseen words, all of it)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            before, after, _ = _class_pairs(batch.column("classes").to_pylist(), end_class)
            total += np.bincount(before * n + after, minlength=n * n)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    pairs = (ready.where("train").select("classes").mapInArrow(run, "pair long, n long")
             .groupBy("pair").agg(F.sum("n").alias("n")).toPandas())  # n squared rows at most
    table = np.zeros(n * n)
    table[pairs["pair"].to_numpy(np.int64)] = pairs["n"].to_numpy()
    return probabilities(table.reshape(n, n), unknown, rare, once, twice)


def probabilities(table: np.ndarray, unknown: int, rare: int, once: int, twice: int) -> tuple[np.ndarray, np.ndarray]:
    """The model from the counts of class pairs; the classes of rare words lie from ``rare`` to ``unknown``."""
    n = len(table)
    mass = table.sum(axis=0)  # tokens of each class
    share = (mass + 0.1) / (mass + 0.1).sum()
    share[unknown] = 0.0
    share /= share.sum()
    table[unknown] = table[rare:unknown].sum(axis=0)
    transition = (table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR)
    # words seen once are rare words: their share of the rare classes' tokens is those classes' unseen mass
    unseen = np.zeros(n)
    rare_mass = mass[rare:unknown].sum()
    unseen[rare:unknown] = once / max(once + rare_mass, 1.0)
    missing = max(once * once / (2.0 * max(twice, 1)), 1.0)
    emission = np.log10(np.maximum(1 - unseen, 1e-9)) - np.log10(np.maximum(mass, 1.0))
    log = np.log10(np.maximum(transition, 1e-300))
    log[:, unknown] = np.log10(np.maximum((transition * unseen).sum(axis=1), 1e-12) / missing)
    emission[unknown] = 0.0
    return log, emission
