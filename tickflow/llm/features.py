"""Hashed features of words, and small linear models on them (run inside tasks or on a bounded sample).

A linear model over n-gram counts needs no feature vector of a text: each
distinct word of a block gets the sum of its features' weights once, and a
text sums its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of ' w1 w2 ... ' and each word's begin and end there."""
    words = words.cast(pa.large_binary())
    cut = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[cut[0]:cut[-1]]
    cut = cut - cut[0]
    shift = np.arange(1, len(words) + 1)
    out = np.full(len(raw) + len(words) + 1, 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(shift, np.diff(cut))] = raw
    return out, cut[:-1] + shift, cut[1:] + shift


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, for feature hashing."""
    raw, begin, end = _bytes_of(words)
    if not len(words):
        return np.empty(0, U64)
    at = np.arange(len(raw)) - np.repeat(np.concatenate([[0], end]), np.diff(np.concatenate([[0], end, [len(raw)]])))
    power = np.cumprod(np.full(int(at.max()) + 2, _MULTIPLIER, U64))
    ends = np.concatenate([[U64(0)], np.cumsum((raw.astype(U64) + U64(1)) * power[at])])
    return (ends[end] - ends[begin]) * _MULTIPLIER


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` bits of mixed hashes."""
    h = hashes ^ (hashes >> U64(29))
    return ((h * U64(0xBF58476D1CE4E5B9)) >> U64(64 - bits)).astype(np.int64)


def ngram_features(words: pa.Array, sizes: range, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) of every byte n-gram of ' word ', sizes as given."""
    raw, begin, end = _bytes_of(words)
    wide = raw.astype(U64)
    out_word, out_feature = [], []
    for n in sizes:
        count = np.maximum(end - begin + 3 - n, 0)
        word = np.repeat(np.arange(len(words)), count)
        at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin - 1, count)
        key = np.full(len(at), U64(n), U64)
        for i in range(n):
            key = (key << U64(8)) | wide[at + i]
        out_word.append(word)
        out_feature.append(bucket(key * _MULTIPLIER, bits))
    return np.concatenate(out_word), np.concatenate(out_feature)


def word_sums(words: pa.Array, sizes: range, bits: int, weights: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Sum of ``weights`` (features, columns) over each word's n-grams, some words at a time."""
    out = np.zeros((len(words), weights.shape[1]))
    for at in range(0, len(words), step):
        word, feature = ngram_features(words.slice(at, step), sizes, bits)
        out[at:at + step] = summed(word, weights[feature], min(step, len(words) - at))
    return out


def summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by index: an array (n, columns)."""
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of an L2 linear SVM by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    diagonal = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 200) -> np.ndarray:
    """Weights (the last is the bias) of an L2 logistic regression by accelerated gradient steps; y is 0 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    ridge = np.full(x.shape[1], penalty, x.dtype)
    ridge[-1] = 0
    vector = np.ones(x.shape[1], x.dtype)
    for _ in range(12):  # largest eigenvalue of x'x / n, for the step
        vector = (x @ vector) @ x
        size = np.sqrt(vector @ vector)
        vector = (vector / max(size, 1e-30)).astype(x.dtype)
    step = 1 / (0.25 * float(size) / len(x) * 1.1 + penalty)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for i in range(rounds):
        miss = (sigmoid(x @ ahead) - y).astype(x.dtype)  # in one precision: no copy of x is made
        gradient = (miss @ x) / len(x) + ridge * ahead
        new = (ahead - step * gradient).astype(x.dtype)
        ahead = (new + (i / (i + 3)) * (new - w)).astype(x.dtype)
        w = new
    return w.astype(np.float64)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities of y = 1 (Platt, 1999, with his smoothed targets)."""
    positive = float((y > 0).sum())
    negative = len(y) - positive
    if not positive or not negative:
        return 1.0, 0.0
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * margin + b)
        weight, miss = np.maximum(p * (1 - p), 1e-9), p - target
        h = np.array([[(weight * margin * margin).sum() + 1e-6, (weight * margin).sum()],
                      [(weight * margin).sum(), weight.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(miss * margin).sum(), miss.sum()]))
        size = max(1.0, np.abs(step).max() / 2)
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)
