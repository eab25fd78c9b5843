"""Operator 2: language identification by family, then one-versus-one linear SVMs.

Method.  Hierarchical discrimination on hashed byte n-grams of words: linear
SVMs between families predict the family; within it, one linear SVM for each
pair of its languages.  Margins are calibrated to probabilities on a held-out
part of the sample, coupled by their normalised product.  A score is the
family's probability times the language's within it.

The models are fitted on a bounded sample (``SAMPLE`` texts, the same number
for each language, chosen by a hash of the id) and are some hundred kB; every
whole text is scored, in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.llm.features import linear_svm, ngram_features, platt, sigmoid, word_sums
from tickflow.llm.frames import outputs_last
from tickflow.llm.text import give_back, sliced, sums, texts_of, tidy, words_of

#: Language families; a language of none of them is a family of its own.
FAMILIES = {
    "germanic": ["de", "en", "nl", "da", "sv", "no", "is"],
    "romance": ["es", "fr", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
}
#: Texts in the training sample at most (twice that if hashes fall badly).
SAMPLE = 2000
#: Byte n-grams of these sizes, hashed to 2**BITS features.
SIZES, BITS = range(1, 5), 12
#: Training rows for the SVMs have mean 1/2**BITS; this brings them to a useful size.
SCALE = 30.0
UNKNOWN = "und"
#: Text bytes scored at once.
BLOCK = 2 << 20


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def profiles(texts: pa.Array) -> np.ndarray:
    """Share of each feature among a text's n-grams: an array (texts, 2**BITS)."""
    codes, offsets, words = words_of(texts)
    word, feature = ngram_features(words, SIZES, BITS)
    order = np.argsort(word, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i in range(len(texts)):
        for w, n in zip(*np.unique(codes[offsets[i]:offsets[i + 1]], return_counts=True)):
            np.add.at(out[i], feature[order[cut[w]:cut[w + 1]]], n)
        out[i] *= SCALE / max(out[i].sum(), 1)
    return out


def _pairs(x: np.ndarray, y: np.ndarray, names: list[str], kinds: np.ndarray) -> list[tuple]:
    """(first, second, weights, slope, shift) for each pair of ``names``; every fifth row calibrates."""
    out = []
    for a, b in combinations(names, 2):
        rows = np.flatnonzero((kinds == a) | (kinds == b))
        sign = np.where(kinds[rows] == a, 1.0, -1.0)
        part = np.arange(len(rows)) % 5 == 0
        if len(set(sign[~part])) == 2 and len(set(sign[part])) == 2:
            w = linear_svm(x[rows[~part]], sign[~part])
            slope, shift = platt(x[rows[part]] @ w[:-1] + w[-1], sign[part])
        else:
            slope, shift = 1.0, 0.0
        out.append((a, b, linear_svm(x[rows], sign), slope, shift))
    return out


def fit(x: np.ndarray, languages: np.ndarray) -> dict:
    """The model: languages by family, and the SVMs between families and within them."""
    order = np.argsort(languages, kind="stable")  # every fifth row of each language calibrates
    x, languages = x[order], languages[order]
    families: dict[str, list[str]] = {}
    for name in sorted(set(languages.tolist())):
        families.setdefault(family_of(name), []).append(name)
    kinds = np.array([family_of(name) for name in languages])
    model = {"families": {f: families[f] for f in sorted(families)}, "between": _pairs(x, languages, sorted(families), kinds)}
    model["within"] = {f: _pairs(x, languages, names, languages) for f, names in model["families"].items()}
    return model


def _coupled(names: list[str], pairs: list[tuple], margins: np.ndarray) -> np.ndarray:
    """Probabilities (rows, names) from the pairs' margins."""
    log = np.zeros((len(margins), len(names)))
    for k, (a, b, _, slope, shift) in enumerate(pairs):
        p = sigmoid(slope * margins[:, k] + shift)
        log[:, names.index(a)] += np.log(np.maximum(p, 1e-300))
        log[:, names.index(b)] += np.log(np.maximum(1 - p, 1e-300))
    odds = np.exp(log - log.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def predict(texts: pa.Array, model: dict) -> tuple[list[str], np.ndarray]:
    """Language and score of each text (null texts are given as empty)."""
    n = len(texts)
    names, scores = np.full(n, UNKNOWN, object), np.zeros(n)
    if model["families"]:
        codes, offsets, words = words_of(texts)
        pairs = [*model["between"], *[p for f in model["families"] for p in model["within"][f]]]
        weights = np.stack([*[p[2][:-1] for p in pairs], np.ones(1 << BITS)], axis=1)
        by_text = sums(word_sums(words, SIZES, BITS, weights)[codes], offsets)
        margins = SCALE * by_text[:, :-1] / np.maximum(by_text[:, -1:], 1) + np.array([p[2][-1] for p in pairs])
        families = list(model["families"])
        at = len(model["between"])
        between = _coupled(families, model["between"], margins[:, :at])
        best = np.argmax(between, axis=1)
        for i, f in enumerate(families):
            own, k = model["families"][f], len(model["within"][f])
            rows = np.flatnonzero(best == i)
            within = _coupled(own, model["within"][f], margins[rows, at:at + k])
            names[rows] = np.array(own, object)[np.argmax(within, axis=1)]
            scores[rows] = between[rows, i] * within.max(axis=1)
            at += k
    blank = ~pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    names[blank], scores[blank] = UNKNOWN, 0.0
    return names.tolist(), np.clip(scores, 0.0, 1.0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> dict:
    """The model learned from at most about ``sample`` rows of ``docs`` with a language and a letter."""
    usable = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
                         F.xxhash64(F.lit(17), F.col(key), F.col(text)).alias("h"))
    usable = usable.where(r"lang is not null and text rlike '\\p{L}'")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return {"families": {}, "between": [], "within": {}}
    quota = max(sample // len(counts), 10)
    share = F.lit(0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col("lang") == name, int(min(1.0, quota / n) * (1 << 40))).otherwise(share)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            rows = profiles(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("h"), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())],
                names=["lang", "h", "x"])

    few = (usable.where(F.pmod("h", F.lit(1 << 40)) < share).orderBy("h").limit(2 * quota * len(counts))
           .mapInArrow(tidy(run), "lang string, h long, x binary").toPandas().sort_values(["lang", "h"], kind="stable"))
    x = np.stack([np.frombuffer(zlib.decompress(b), np.float32) for b in few["x"]])
    names = few["lang"].to_numpy(object).astype(str)
    del few
    model = fit(x, names)
    del x
    give_back()  # the driver goes on with other steps
    return model


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score (0 to 1), from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is any
    text if the model learned from no row.  Columns named like an output are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weights per pair of languages
    source = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", BLOCK):
            names, scores = predict(texts_of(batch, "text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(scores)],
                                             names=["row", "lang_pred", "score"])
            del batch, names, scores
            give_back()

    schema = T.StructType([source.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return outputs_last(source.mapInArrow(tidy(run), schema), "row", lang_pred="lang_pred", score="score")


def accepted(least: float = 0.5) -> Column:
    """Texts in a known language: predicted, and more likely right than wrong."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
