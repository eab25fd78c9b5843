"""Operator 12: periodic runs of words, by block convolution.

Method.  A run of smallest period q is at least 4q words long, so at the
dyadic scale B, the largest power of two up to (3q + 1) / 2, it holds a whole
block of B words that begins at a multiple of B, together with the same block
q words later.  At each scale the blocks are therefore looked up in the window
of words after them: the sum of squared differences of word codes is
convolved for all distances of the scale at once, by a number-theoretic
transform (integers modulo a prime, so nothing is rounded).  A distance whose
sum is zero seeds an extension, which compares the words themselves in both
directions and so gives the run's borders; a zero sum that is only a multiple
of the prime extends to nothing.  Every distance with equal blocks has a zero
sum, so no run is missed.

Only blocks whose every word comes again within the scale's reach are
transformed: another block cannot occur in its window.  All texts of a block
of input are searched as one sequence, parted by words that occur nowhere
else; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.frames import outputs_last
from tickflow.llm.text import U64, sliced, texts_of, tidy, words_of

#: A run has at least LEAST words and TIMES periods (the scales below rest on TIMES = 4).
LEAST, TIMES = 6, 4
#: 15 * 2**27 + 1, a prime with roots of unity of every order up to 2**27; 31 generates its units.
PRIME, GENERATOR, LARGEST = 2013265921, 31, 1 << 27
#: Integers transformed at once (bounds memory; a larger block is transformed alone).
AT_ONCE = 1 << 19
_P = U64(PRIME)


def reach(size: int) -> tuple[int, int]:
    """First and last distance looked up with blocks of ``size`` words."""
    return -(-(2 * size - 1) // 3), -(-(4 * size - 1) // 3) - 1


def roots(n: int, inverse: bool = False) -> np.ndarray:
    """The first n / 2 powers of an n-th root of unity."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = U64(pow(root, -1, PRIME) if inverse else root)
    out = np.ones(max(n // 2, 1), U64)
    have = 1
    while have < len(out):
        out[have:2 * have] = out[:have] * root % _P
        have *= 2
        root = root * root % _P
    return out


def forward(a: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Transform of each row (length a power of two), its terms in bit-reversed order."""
    half = a.shape[1] // 2
    step = 1
    while half:
        pair = a.reshape(len(a), -1, 2, half)
        total = pair[:, :, 0] + pair[:, :, 1]
        rest = pair[:, :, 0] + (_P - pair[:, :, 1])
        out = np.empty_like(pair)
        out[:, :, 0] = np.minimum(total, total - _P)  # the smaller one: unsigned differences wrap around
        out[:, :, 1] = rest * powers[::step] % _P
        a = out.reshape(a.shape)
        half, step = half // 2, step * 2
    return a


def backward(a: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Inverse of :func:`forward`, given the inverse root's powers."""
    n = a.shape[1]
    half, step = 1, n // 2
    while half < n:
        pair = a.reshape(len(a), -1, 2, half)
        turned = pair[:, :, 1] * powers[::step] % _P
        out = np.empty_like(pair)
        total = pair[:, :, 0] + turned
        out[:, :, 0] = np.minimum(total, total - _P)
        rest = pair[:, :, 0] + (_P - turned)
        out[:, :, 1] = np.minimum(rest, rest - _P)
        a = out.reshape(a.shape)
        half, step = half * 2, step // 2
    return a * U64(pow(n, -1, PRIME)) % _P


def mismatches(blocks: np.ndarray, windows: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Sum of squared differences, modulo the prime, of each block and its window from each of the window's places.

    ``blocks`` (rows, B) and ``windows`` (rows, W) hold integers below the
    prime, B <= W <= 2B; the result has W - B + 1 columns.
    """
    rows, size = blocks.shape
    n, places = 2 * size, windows.shape[1] - size + 1
    turned = np.zeros((rows, n), U64)
    turned[:, 0] = blocks[:, 0]
    turned[:, n - size + 1:] = blocks[:, :0:-1]  # the block backwards in time: a product is a correlation
    held = np.zeros((rows, n), U64)
    held[:, :windows.shape[1]] = windows
    product = backward(forward(turned, powers) * forward(held, powers) % _P, inverse)[:, :places]
    own = (blocks * blocks % _P).sum(axis=1)
    squares = np.zeros((rows, windows.shape[1] + 1), U64)
    np.cumsum(windows * windows % _P, axis=1, out=squares[:, 1:])
    other = squares[:, size:size + places] - squares[:, :places]
    return (own[:, None] + other + U64(2) * (_P - product)) % _P


def stretch(x: np.ndarray, s: int, d: int) -> tuple[int, int]:
    """The longest ``[a, b)`` around ``s`` in which words ``d`` apart are equal."""
    right, step = s, 32
    while right + d < len(x):
        end = min(right + step, len(x) - d)
        miss = x[right:end] != x[right + d:end + d]
        first = int(miss.argmax())
        if miss[first]:
            right += first
            break
        right, step = end, step * 2
    left, step = s, 32
    while left:
        begin = max(left - step, 0)
        miss = (x[begin:left] != x[begin + d:left + d])[::-1]
        first = int(miss.argmax())
        if miss[first]:
            left -= first
            break
        left, step = begin, step * 2
    return left, right + d


def prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def find_runs(x: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of codes ``x`` (below the prime), whose texts have ``longest`` words at most."""
    found: set[tuple[int, int, int]] = set()
    n = len(x)
    if longest < LEAST:
        return np.empty((0, 3), np.int64)
    order = np.argsort(x, kind="stable")
    again = np.full(n, n + 1, np.int64)  # words until this one comes again
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = order[1:][same] - order[:-1][same]
    cover_end, cover_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    size, most = 1, again
    while True:
        size *= 2
        first, last = reach(size)
        if TIMES * first > longest:
            break
        if 2 * size > LARGEST:
            raise ValueError(f"a period of {first} words is beyond the transform")
        most = most[:len(most) // 2 * 2].reshape(-1, 2).max(axis=1)
        starts = np.flatnonzero(most <= last) * size
        powers, inverse = roots(2 * size), roots(2 * size, inverse=True)
        chunk = max(1, AT_ONCE // (2 * size))
        for at in range(0, len(starts), chunk):
            begin = starts[at:at + chunk]
            place = begin[:, None] + np.arange(last + size)[None, :]
            held = np.where(place < n, x[np.minimum(place, n - 1)], PRIME - 1).astype(U64)
            sums = mismatches(held[:, :size], held[:, first:], powers, inverse)
            row, distance = np.nonzero(sums == 0)
            s, d = begin[row], distance + first
            known = (s + d + size <= cover_end[s]) & (d % cover_period[s] == 0)
            s, d = s[~known], d[~known]
            by_distance = np.lexsort((s, d))
            done = (0, 0)  # the distance searched last, and how far
            for s, d in zip(s[by_distance].tolist(), d[by_distance].tolist()):
                if d == done[0] and s + d < done[1]:
                    continue
                a, b = stretch(x, s, d)
                done = (d, b)
                if b - a < max(LEAST, TIMES * d) or (a, b, d) in found:
                    continue
                if any(np.array_equal(x[a:a + d], x[a + d // f:a + d + d // f]) for f in prime_factors(d)):
                    continue  # a run of a smaller period
                found.add((a, b, d))
                longer = cover_end[a:b] < b
                cover_end[a:b][longer], cover_period[a:b][longer] = b, d
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        texts = texts_of(batch, "text")
        codes, offsets, words = words_of(texts, lower=False)
        count = np.diff(offsets)
        # one sequence of all texts, a word of its own after each
        at = np.arange(len(codes)) + np.repeat(np.arange(len(count)), count)
        x = np.empty(len(codes) + len(count), np.int64)
        x[at] = codes
        ends = offsets[1:] + np.arange(len(count))
        x[ends] = len(words) + np.arange(len(count))
        runs = find_runs(x, int(count.max()) if len(count) else 0)
        owner = np.searchsorted(ends, runs[:, 0], side="right")
        begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        # a word goes if a run holds it after the run's first period
        change = np.zeros(len(x) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 1], -1)
        stays = np.cumsum(change)[at] == 0
        left = np.concatenate([[0], np.cumsum(stays)])[offsets]
        kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(codes[stays])))
        listed = np.searchsorted(owner, np.arange(len(count) + 1))
        order = np.lexsort((runs[:, 2], runs[:, 0]))  # by start, then period
        runs, owner = runs[order], owner[order]
        spans = pa.StructArray.from_arrays(
            [pa.array(runs[:, 0] - begins[owner]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
            names=["start", "length", "period"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(count, pa.int64()), pa.ListArray.from_arrays(pa.array(listed, pa.int32()), spans),
             pc.binary_join(kept, " ")], names=["row", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, runs (start, length, period in words, by start, then period) and collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch of
    at least max(6, 4q) words with smallest period q which no neighbouring
    word extends at that period; runs of different periods may overlap.
    ``collapsed`` holds, joined by one space, the words that no run holds
    after its first period.  A null or empty text has no word, no run and ''
    for collapsed.  Rows are judged one by one (repeated rows alike, null ids
    as they come); columns named like an output are replaced.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(tidy(_search), f"row {kind}, n_words long, "
                          "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return outputs_last(out, "row", n_words="n_words", runs="runs", collapsed="collapsed")
