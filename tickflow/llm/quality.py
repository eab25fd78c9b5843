"""Operator 4: quality rules by a calibrated logistic regression on hashed n-grams.

Method.  Hashed word unigrams, word bigrams and byte n-grams of words feed an
L2 logistic regression fitted on labelled rows and calibrated on a held-out
part of them; whole texts are scored in Arrow batches without a shuffle and
kept at a fixed threshold.  Counting rules (length, repeated word windows)
come first; their counts are part of the result.

The regression is fitted on a bounded sample: ``SAMPLE`` labelled texts,
chosen by a hash of their id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.llm.features import bucket, logistic, ngram_features, platt, sigmoid, word_hashes, word_sums
from tickflow.llm.frames import outputs_last
from tickflow.llm.text import U64, give_back, sliced, sums, texts_of, tidy, words_of

#: Labelled texts in the training sample at most (twice that if hashes fall badly).
SAMPLE = 2000
#: Byte n-grams of words, and the bits of the features of n-grams, words and word pairs.
SIZES, NGRAM_BITS, WORD_BITS = range(1, 4), 12, 11
DIMENSIONS = (1 << NGRAM_BITS) + 2 * (1 << WORD_BITS)
SCALE, PENALTY = 30.0, 1e-4
#: Texts with this probability of good quality are kept.
KEEP_AT = 0.5
#: The counting rules: words a text must have, and percent of its words that may lie in repeated windows.
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3
#: Text bytes scored at once.
BLOCK = 4 << 20
_PAIR = U64(0x94D049BB133111EB)


def repeated_words(codes: np.ndarray) -> int:
    """Words of a text that lie in a window of three words found twice or more."""
    if len(codes) <= WINDOW:
        return 0
    if codes.max() >= 1 << 21:
        codes = np.unique(codes, return_inverse=True)[1]
    key = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(codes), bool)
    windows = np.concatenate([order[1:][same], order[:-1][same]])
    for i in range(WINDOW):
        covered[windows + i] = True
    return int(covered.sum())


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = pc.split_pattern(texts, "\n")
    offsets = lines.offsets.to_numpy().astype(np.int64)
    encoded = lines.flatten().dictionary_encode()
    real = pc.match_substring_regex(encoded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    code = encoded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    wanted = real[code]
    n = np.bincount(text[wanted], minlength=len(texts))
    distinct = np.unique(text[wanted] * max(len(real), 1) + code[wanted]) // max(len(real), 1)
    return n - np.bincount(distinct, minlength=len(texts))


def _parts(texts: pa.Array):
    """Words as codes, and the features of distinct words and of neighbouring pairs."""
    codes, offsets, words = words_of(texts, lower=False)
    hashes = word_hashes(words)
    single = (1 << NGRAM_BITS) + bucket(hashes, WORD_BITS)
    pair = bucket(hashes[codes[:-1]] * _PAIR + hashes[codes[1:]], WORD_BITS) if len(codes) > 1 else np.empty(0, np.int64)
    pair = pair + (1 << NGRAM_BITS) + (1 << WORD_BITS)
    return codes, offsets, words, single, pair


def _pair_offsets(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last pair of each text among all neighbouring words."""
    return offsets[:-1], np.maximum(offsets[1:] - 1, offsets[:-1])


def profiles(texts: pa.Array) -> np.ndarray:
    """Feature vectors (texts, DIMENSIONS): the shares of n-grams, of words and of pairs."""
    codes, offsets, words, single, pair = _parts(texts)
    word, ngram = ngram_features(words, SIZES, NGRAM_BITS)
    order = np.argsort(word, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])
    first, last = _pair_offsets(offsets)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i in range(len(texts)):
        own = codes[offsets[i]:offsets[i + 1]]
        row = np.zeros(DIMENSIONS)
        for w, n in zip(*np.unique(own, return_counts=True)):
            np.add.at(row, ngram[order[cut[w]:cut[w + 1]]], n)
        row *= SCALE / max(row.sum(), 1)
        np.add.at(row, single[own], SCALE / max(len(own), 1))
        np.add.at(row, pair[first[i]:last[i]], SCALE / max(last[i] - first[i], 1))
        out[i] = row
    return out


def measure(texts: pa.Array, weights: np.ndarray | None, slope: float, shift: float) -> dict[str, np.ndarray]:
    """The counts of each text and its probability of good quality (1 without a model)."""
    codes, offsets, words, single, pair = _parts(texts)
    n_words = np.diff(offsets)
    out = {"n_words": n_words,
           "word_chars": sums(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[codes], offsets),
           "n_symbols": pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64),
           "n_dup_lines": duplicate_lines(texts),
           "n_repeat_words": np.array([repeated_words(codes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())],
                                      np.int64)}
    if weights is None:
        return out | {"quality": np.ones(len(texts))}
    ngrams = weights[:1 << NGRAM_BITS]
    by_word = word_sums(words, SIZES, NGRAM_BITS, np.stack([ngrams, np.ones(len(ngrams))], axis=1))
    by_word = np.concatenate([by_word, weights[single][:, None]], axis=1)
    by_text = sums(by_word[codes], offsets)
    first, last = _pair_offsets(offsets)
    running = np.concatenate([[0.0], np.cumsum(weights[pair])])
    z = by_text[:, 0] / np.maximum(by_text[:, 1], 1) + by_text[:, 2] / np.maximum(n_words, 1) \
        + (running[last] - running[first]) / np.maximum(last - first, 1)
    margin = SCALE * z + weights[-1]
    return out | {"quality": sigmoid(slope * margin + shift)}


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, and the calibration's slope and shift from every fifth row."""
    part = np.arange(len(x)) % 5 == 0
    slope, shift = 1.0, 0.0
    if len(set(y[~part])) == 2:
        w = logistic(x[~part], y[~part], PENALTY)
        slope, shift = platt(x[part] @ w[:-1] + w[-1], np.where(y[part] > 0, 1.0, -1.0))
    return logistic(x, y, PENALTY), slope, shift


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          sample: int = SAMPLE) -> tuple[np.ndarray | None, float, float]:
    """The model learned from at most about ``sample`` labelled rows; without both labels it keeps all."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.xxhash64(F.lit(19), F.col(key)).alias("h"))
    n = known.count()
    chosen = known.where(F.pmod("h", F.lit(1 << 40)) < int(min(1.0, sample / max(n, 1)) * (1 << 40)))
    chosen = chosen.orderBy("h").limit(2 * sample)  # bounded, so it may be sent to all tasks
    rows = (docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
            .join(F.broadcast(chosen), "k").where("text is not null").select("h", "y", "text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            x = profiles(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("y"), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], names=["h", "y", "x"])

    few = rows.mapInArrow(tidy(run), "h long, y int, x binary").orderBy("h", "y").limit(2 * sample).toPandas()
    y = few["y"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return None, 1.0, 0.0
    x = np.stack([np.frombuffer(zlib.decompress(b), np.float32) for b in few["x"]])
    del few
    model = fit(x, y)
    del x
    give_back()  # the driver goes on with other steps
    return model


def judge(docs: DataFrame, model: tuple, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality and kept.

    A null text has no words and no lines; it fails the rules like any text
    of fewer than 50 words.  ``kept`` is false where the rules fail, else
    whether the calibrated probability reaches ``keep_at``.  Columns named
    like an output are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights
    source = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BLOCK):
            out = measure(texts_of(batch, "text"), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(out[c]) for c in [*counts, "quality"]]],
                                             names=["row", *counts, "quality"])
            del batch, out
            give_back()

    schema = T.StructType([source.schema["row"], *[T.StructField(c, T.LongType()) for c in counts],
                           T.StructField("quality", T.DoubleType())])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    scored = source.mapInArrow(tidy(run), schema).withColumn("base_failed", failed)
    return outputs_last(scored, "row", **{c: c for c in [*counts, "base_failed", "quality"]},
                        kept=~F.col("base_failed") & (F.col("quality") >= keep_at))
