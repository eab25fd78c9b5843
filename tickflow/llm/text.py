"""Arrow and numpy helpers for whole batches of texts (run inside tasks).

Texts are split by Arrow's kernels and handled as integer codes into the
distinct pieces of a batch, so the per-word work (hashing, encoding,
weighing) is done once for each distinct word of a batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes of one unit of work inside a task (bounds a Python worker's memory).
BLOCK_BYTES = 16 << 20
#: Bytes that a row counts for besides its text, so that many short texts fill a block too.
ROW_BYTES = 16

U64 = np.uint64


def sliced(batches: Iterable[pa.RecordBatch], text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut where ``block_bytes`` of text (and ROW_BYTES a row) are full.

    The cuts depend on the rows alone, not on the size of the Arrow batches
    in which they arrive.  A longer text is a block of its own.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate((lengths + ROW_BYTES).tolist()):
            if size and size + n > block_bytes:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield joined(held)
                held, size, start = [], 0, i
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield joined(held)


def give_back() -> None:
    """Return freed memory to the system between blocks (workers live on and would keep it)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run, forget=None):
    """``run`` for mapInArrow; its worker, which goes on to other stages, keeps nothing of the stage before or of this one.

    ``forget`` empties what the module of ``run`` keeps between blocks.
    """
    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()
    return tidied


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One record batch with the rows of all."""
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], schema=table.schema)


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column; a null text is empty."""
    return pc.fill_null(batch.column(name).cast(pa.string()), "")


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words, the offsets of each text's words, and the distinct words.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``lower`` lower-cases A-Z first.
    """
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy().astype(np.int64)
    encoded = split.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    vocabulary = encoded.dictionary
    offsets = offsets - offsets[0]
    blank = pc.index(vocabulary, "").as_py()
    if blank >= 0:  # white space at an end of a text leaves an empty piece
        real = codes != blank
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
        vocabulary = pa.concat_arrays([vocabulary.slice(0, blank), vocabulary.slice(blank + 1)])
        codes[codes > blank] -= 1
    return codes, offsets, vocabulary


def string_hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """xxHash64 of the UTF-8 bytes of each value."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(v, seed) for v in values.to_pylist()), dtype=U64, count=len(values))


def byte_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of the UTF-8 bytes of each value, eight bytes at a time over all values at once.

    Every eight bytes are mixed with what came before; values of up to eight
    bytes of one length never share a hash.
    """
    values = values.cast(pa.large_binary())
    cut = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)[cut[0]:cut[-1]].tobytes() + bytes(8)
    begin, length = cut[:-1] - cut[0], np.diff(cut)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    out = mixed(length.astype(U64) * U64(0x9E3779B97F4A7C15))
    active, at = np.flatnonzero(length), 0
    while len(active):
        rest = np.minimum(length[active] - at, 8)
        lane = eight[begin[active] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (8 - rest).astype(U64)))
        out[active] = mixed(out[active] + lane * U64(0xD1342543DE82EF95))
        at += 8
        active = active[length[active] > at]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (every output bit depends on every input bit)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words of one sequence (may be empty)."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for i in range(width):
        out = out * U64(0x9E3779B97F4A7C15) + word_hashes[i:i + n]
    return mixed(out)


def ragged_take(offsets: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``values[offsets[i]:offsets[i + 1]]`` for each i of ``index``; with the new offsets."""
    lengths = offsets[index + 1] - offsets[index]
    ends = np.cumsum(lengths)
    out = np.concatenate([[0], ends]).astype(np.int64)
    if not len(index) or not out[-1]:
        return values[:0], out
    kind = np.int32 if max(len(values), out[-1]) < 1 << 31 else np.int64
    at = np.repeat((offsets[index] - (ends - lengths)).astype(kind), lengths)
    at += np.arange(len(at), dtype=kind)
    return values[at], out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``values`` between consecutive offsets (0 for an empty run)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def pack_varints(codes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """LEB128 bytes of each run of ``codes`` (below 2**28)."""
    if len(offsets) > 257:  # some runs at a time
        return [x for at in range(0, len(offsets) - 1, 256) for x in pack_varints(
            codes[offsets[at]:offsets[min(at + 256, len(offsets) - 1)]], offsets[at:at + 257] - offsets[at])]
    codes = codes.astype(np.uint32)
    lengths = 1 + (codes >= 1 << 7) + (codes >= 1 << 14) + (codes >= 1 << 21)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    out = np.zeros(ends[-1], np.uint8)
    for k in range(4):
        has = lengths > k
        byte = (codes[has] >> np.uint32(7 * k)) & np.uint32(127)
        out[ends[:-1][has] + k] = byte | ((lengths[has] > k + 1).astype(np.uint32) << np.uint32(7))
    raw, cut = out.tobytes(), ends[offsets].tolist()
    return [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]


def unpack_varints(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of :func:`pack_varints`: the codes and each run's offsets."""
    packed = packed.cast(pa.large_binary())
    cut = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    raw = (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[cut[0]:cut[-1]]
    last = raw < 128
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lengths = ends - starts
    codes = np.zeros(len(ends), np.int64)
    for k in range(4):
        has = lengths > k
        codes[has] |= (raw[starts[has] + k] & 127).astype(np.int64) << (7 * k)
    done = np.concatenate([[0], np.cumsum(last)]).astype(np.int64)
    return codes, done[cut - cut[0]]
