"""Operator 10: packing documents into fixed windows by online sum of squares.

Method.  A document's ids are cut into whole windows and a remainder.  The
remainder goes to the fill level that minimises the sum of squared counts of
partially filled windows, tracked in an array with one count per level
(Csirik et al., 2006).  Windows still partial at the end of a task are filled
up by cutting the pieces of the emptiest ones, and the last rest is cut into
windows whose lengths are powers of two, so that no padding remains.

Every task packs the documents of its own partition: nothing is shuffled and
no window is shared between tasks.  A task holds one row for each piece of its
open windows, a few hundred windows, and the ids of those.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.llm import vocab
from tickflow.llm.bpe import pretokens
from tickflow.llm.frames import outputs_last
from tickflow.llm.text import give_back, ragged_take, sliced, texts_of, tidy

#: Text bytes tokenized at once.
BLOCK_BYTES = 8 << 20


class Packer:
    """Sum-of-squares packing of pieces into windows of ``size`` tokens.

    ``add`` returns the windows it closes; ``close`` the rest.  A window is a
    list of pieces (key, start, ids) with ``len(ids) > 0``.
    """

    def __init__(self, size: int):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list] = [[] for _ in range(size)]

    def add(self, key, ids: np.ndarray) -> Iterator[list]:
        size, levels = self.size, self.levels
        whole = len(ids) // size * size
        for start in range(0, whole, size):
            yield [(key, start, ids[start:start + size])]
        n = len(ids) - whole
        if not n:
            return
        # Half the change of the sum of squares when a window of level h gets the piece, up to a constant:
        # N(h+n) - N(h) + 1 for an open window, N(n) + 1/2 for a new one, -N(h) + 1/2 where it becomes full.
        at, best = 0, levels[n] + 0.5
        change = levels[n + 1:] - levels[1:size - n + 1] + 1.0
        change[-1] -= 0.5  # N(size) is 0: a full window counts no more
        change[levels[1:size - n + 1] == 0] = np.inf
        if len(change) and (low := int(np.argmin(change[::-1]))) is not None:
            h = len(change) - low  # the fullest of equal ones
            if change[h - 1] <= best:
                at, best = h, change[h - 1]
        window = self.open[at].pop() if at else []
        levels[at] -= at > 0
        window.append((key, whole, ids[whole:]))
        if at + n == size:
            yield window
        else:
            self.open[at + n].append(window)
            levels[at + n] += 1

    def close(self) -> Iterator[list]:
        """Fill the fullest open windows with cut pieces of the emptiest; cut the last rest at powers of two."""
        left = [w for stack in self.open for w in stack]  # emptiest first
        i, j = 0, len(left) - 1
        loose: list = []
        while j >= i:
            window = left[j]
            room = self.size - sum(len(p[2]) for p in window)
            while room and (loose or j > i):
                if not loose:
                    loose, i = left[i][::-1], i + 1
                    continue
                key, start, ids = loose.pop()
                window.append((key, start, ids[:room]))
                if len(ids) > room:
                    loose.append((key, start + room, ids[room:]))
                room -= min(room, len(ids))
            if room:
                break
            yield window
            j -= 1
        rest = (left[j] if j >= i else []) + loose[::-1]
        while (n := sum(len(p[2]) for p in rest)):
            room, window = min(self.size, 1 << (n.bit_length() - 1)), []
            while room:
                key, start, ids = rest.pop(0)
                window.append((key, start, ids[:room]))
                if len(ids) > room:
                    rest.insert(0, (key, start + room, ids[room:]))
                room -= min(room, len(ids))
            yield window
        self.__init__(self.size)


def cut_at(texts: pa.Array, added: dict[str, int]) -> tuple[pa.Array, np.ndarray, dict[int, int]]:
    """The texts cut at the added tokens: pieces, each text's first piece, and the ids of pieces that are such tokens.

    A piece that is an added token is empty in the first.  Of tokens that
    begin at the same character the longest counts.
    """
    pattern = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))
    has = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) if added else np.zeros(len(texts), bool)
    if not has.any():
        return texts, np.arange(len(texts) + 1), {}
    split, lengths, chunks, ids, done, n = re.compile(f"({pattern})").split, np.ones(len(texts), np.int64), [], {}, 0, 0
    for i in np.flatnonzero(has).tolist():
        own = split(texts[i].as_py())  # text, token, text, ...
        n += i - done
        ids.update((n + k, added[own[k]]) for k in range(1, len(own), 2))
        own[1::2] = [""] * (len(own) // 2)
        chunks += [texts.slice(done, i - done), pa.array(own, texts.type)]
        lengths[i] = len(own)
        n, done = n + len(own), i + 1
    return pa.concat_arrays([*chunks, texts.slice(done)]), np.concatenate([[0], np.cumsum(lengths)]), ids


def _pack(ranks, added: dict[str, int], size: int, end_id: int, block_bytes: int):
    schema = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # partitions number their windows apart; a task run again makes the same numbers
        number = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        packer, rows = Packer(size), []
        first = next(batches := iter(batches), None)
        if first is None:
            return
        kind = first.schema.field("row").type

        def flush():
            out = [pa.array([r[0] for r in rows], kind)] + [
                pa.array([r[k + 1] for r in rows], f.type) for k, f in enumerate(schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=["row", *schema.names])

        def emit(windows):
            for window in windows:
                n, offset = next(number), 0
                for (row, tokens), start, ids in window:
                    rows.append((row, start, len(ids), ids.astype("<u4").tobytes(), tokens, n, offset))
                    offset += len(ids)

        encode = vocab.encoding(ranks.value).encode_ordinary
        for batch in sliced(itertools.chain([first], batches), "text", block_bytes):
            pieces, first_piece, marks = cut_at(texts_of(batch, "text"), added)
            codes, offsets, words = pretokens(pieces)
            parts = [encode(w) for w in words]  # each distinct pre-token of the block once
            cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            flat = np.fromiter(itertools.chain.from_iterable(parts), np.uint32, cut[-1])
            del parts, words
            ids, ends = ragged_take(cut, flat, codes)
            ends = ends[offsets].tolist()
            del codes, offsets, pieces
            for i, row in enumerate(batch.column("row").to_pylist()):
                a, b = first_piece[i], first_piece[i + 1]
                parts = [ids[ends[a]:ends[b]]] if b - a == 1 else [
                    [marks[k]] if k in marks else ids[ends[k]:ends[k + 1]] for k in range(a, b)]
                own = np.concatenate([*parts, [end_id]]).astype(np.uint32)
                emit(packer.add((row, len(own)), own))
                if len(rows) >= 4096:
                    yield flush()
            del ids
            give_back()
        emit(packer.close())
        if rows:
            yield flush()
    return run


def pack(docs: DataFrame, vocab_path: str, text: str = "text", size: int = 2048, end_id: int = 1,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per piece: the document's other columns, then start, length, ids, doc_tokens, sequence_id, offset.

    A document is its token ids (byte-level BPE; the strings of the file's
    added tokens, wherever a text has them, are those tokens) and ``end_id``;
    a null or empty text is ``end_id`` alone.  ``ids`` are packed little-endian uint32;
    ``start`` counts the document's ids before the piece, ``offset`` those
    before it in its sequence.  A sequence holds ``size`` tokens, or a smaller
    power of two for the last few of a partition.  Rows with equal columns
    are packed as documents of their own.  Columns named like an output are
    replaced.
    """
    others = [F.col(c) for c in docs.columns if c.lower() != text.lower()]
    source = docs.select(F.struct(*(others or [F.lit(None).cast("int").alias("_")])).alias("row"),
                         F.col(text).cast("string").alias("text"))
    ranks = docs.sparkSession.sparkContext.broadcast(vocab.read_json_ranks(vocab_path))
    schema = T.StructType([source.schema["row"], *[T.StructField(n, T.LongType()) for n in ("start", "length")],
                           T.StructField("ids", T.BinaryType()),
                           *[T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]])
    pieces = source.mapInArrow(tidy(_pack(ranks, vocab.added_tokens(vocab_path), size, end_id, block_bytes)), schema)
    out = outputs_last(pieces, "row", **{n: n for n in schema.names[1:]})
    return out if others else out.drop("_")

