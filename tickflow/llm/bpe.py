"""Operator 1: byte-level BPE encoding and decoding by a global shuffle of distinct words.

Method.  Texts are exploded into pre-tokens with positions; every distinct
pre-token is encoded once; its ids are joined back and reassembled by
position; decoding looks ids up in the token-byte table.

To keep the shuffles small the explosion is per block of texts (some MB): a
block's positions travel as one compact list of word codes per row, and each
distinct pre-token of a block as one row (block, code, word).  The word rows
are dealt by word, so that all blocks' rows of a word meet and the word is
encoded once; the ids return to the block (all its words of one task packed in
one row), where codes are replaced by ids.
A word has one row per block at most, whatever its frequency, so no word is a
hot key.  A block's id is the digest of its rows and words: if an input is
not stable between its two readings, ids go missing and the job fails.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.llm import vocab
from tickflow.llm.frames import outputs_last
from tickflow.llm.text import give_back, pack_varints, ragged_take, sliced, texts_of, unpack_varints

#: White space as a character class (Unicode White_Space and the ASCII separators).
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Where a space may lie inside a pre-token: after white space, and before more or at the end.
_INNER = rf"{_SPACE} (?:{_SPACE}|\z)"
#: Letters of the Latin blocks, where all tables agree on what a letter is.
_LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"
#: Text bytes of a block: larger ones have fewer distinct words in all, and take more memory.
BLOCK_BYTES = 14 << 20
_PATTERN = regex.compile(vocab.PATTERN)


def pretokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all pre-tokens, each text's offsets, and the distinct pre-tokens (most frequent first).

    A space starts a pre-token unless white space surrounds it, so a text
    without such spaces may be cut before every space and each distinct cut
    piece be split by the pattern once.
    """
    inner = pc.match_substring_regex(texts, _INNER).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(~inner), texts, "")
    split = pc.split_pattern(plain, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    pieces = split.flatten()
    encoded = pieces.dictionary_encode()
    units = [" " + p for p in encoded.dictionary.to_pylist()]
    index = encoded.indices.to_numpy().astype(np.int32)
    heads = pieces.take(pa.array(offsets[:-1])).dictionary_encode()  # a text's first piece has no space before it
    index[offsets[:-1]] = len(units) + heads.indices.to_numpy()
    units += heads.dictionary.to_pylist()
    if inner.any():
        rows = np.flatnonzero(inner)
        index[offsets[:-1][rows]] = len(units) + np.arange(len(rows))
        units += texts.take(pa.array(rows)).to_pylist()
    del split, pieces, plain
    used = np.zeros(len(units), bool)
    used[index] = True
    whole = np.zeros(len(units), bool)  # a piece of letters alone is one pre-token, as it stands
    whole[:len(encoded.dictionary)] = pc.match_substring_regex(encoded.dictionary, _LETTERS).to_numpy(zero_copy_only=False)
    whole &= used
    words = [units[i] for i in np.flatnonzero(whole).tolist()]
    code = dict(zip(words, range(len(words))))
    lengths = np.zeros(len(units), np.int64)
    lengths[whole] = 1
    rest: list[int] = []
    find, add, put = _PATTERN.findall, code.setdefault, rest.append
    for i in np.flatnonzero(used & ~whole).tolist():
        tokens = find(units[i])
        lengths[i] = len(tokens)
        for token in tokens:
            put(add(token, len(code)))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.empty(ends[-1], np.int32)
    own = np.repeat(whole, lengths)
    flat[own] = np.arange(len(words))
    flat[~own] = rest
    codes, cut = ragged_take(ends, flat, index)
    offsets = cut[offsets]
    order = np.argsort(-np.bincount(codes, minlength=len(code)), kind="stable")
    rank = np.empty(len(code), np.int32)
    rank[order] = np.arange(len(code))
    words = list(code)
    return rank[codes] if len(code) else codes, offsets, [words[i] for i in order.tolist()]


def _blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[tuple]:
    for batch in sliced(batches, "text", block_bytes):
        texts = texts_of(batch, "text")
        codes, offsets, words = pretokens(texts)
        digest = xxhash.xxh3_64(offsets.tobytes())
        digest.update("\x00".join(words).encode())
        digest.update(pc.binary_length(texts).to_numpy().tobytes())
        yield batch, codes, offsets, words, np.int64(np.uint64(digest.intdigest()).astype(np.int64))


def _word_rows(block_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, words, block in _blocks(batches, block_bytes):
            for at in range(0, len(words), 1 << 16):
                part = words[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block)), pa.array(np.arange(at, at + len(part), dtype=np.int32)),
                     pa.array(part, pa.string())], names=["block", "code", "word"])
            del words
            give_back()
    return run


def _code_rows(block_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, codes, offsets, _, block in _blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, block)), batch.column("row"),
                 pa.array(pack_varints(codes, offsets), pa.binary())], names=["block", "row", "codes"])
            del codes, batch
            give_back()
    return run


def _encode_words(ranks):
    """Rows sorted by word to rows (block, codes, lengths, ids): some blocks' words, packed together."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocab.encoding(ranks.value).encode_ordinary
        word, last, held, n = None, 0, [], 0
        table: list[list[int]] = []

        def flush():
            block, code, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((code, block))
            block, code, at = block[order], code[order], at[order]
            lengths = np.fromiter(map(len, table), np.int64, len(table))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            ids, cut = ragged_take(ends, np.fromiter(itertools.chain.from_iterable(table), np.uint32, ends[-1]), at)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            bounds = np.concatenate([first, [len(block)]])
            gaps = np.diff(code, prepend=0)
            gaps[first] = code[first]
            return pa.RecordBatch.from_arrays(
                [pa.array(block[first]), pa.array(pack_varints(gaps, bounds), pa.binary()),
                 pa.array(pack_varints(lengths[at], bounds), pa.binary()),
                 pa.array(pack_varints(ids, cut[bounds]), pa.binary())], names=["block", "codes", "lengths", "ids"])

        for batch in batches:  # each word is encoded when it first appears
            at = []
            for w in batch.column("word").to_pylist():
                if w != word or not table:
                    word, last = w, len(table)
                    table.append(encode(w))
                at.append(last)
            held.append((batch.column("block").to_numpy(), batch.column("code").to_numpy().astype(np.int64),
                         np.asarray(at, np.int64)))
            n += len(at)
            if n >= 1 << 19:
                yield flush()
                held, n, table = [], 0, []
        if n:
            yield flush()
    return run


def _assemble(key, rows: pa.Table, words: pa.Table) -> pa.Table:
    rows, words = rows.combine_chunks(), words.combine_chunks()
    one = lambda name: unpack_varints(words.column(name).combine_chunks()) if len(words) else (np.empty(0, np.int64), None)
    gaps, runs = one("codes")
    lengths, ids = one("lengths")[0], one("ids")[0].astype("<u4")
    if len(gaps):  # gaps back to codes, for each run of words
        total = np.cumsum(gaps)
        gaps = total - np.repeat(total[runs[:-1]] - gaps[runs[:-1]], np.diff(runs))
    known, first = np.unique(gaps, return_index=True)  # copies of a block repeat its words
    if len(known) and known[-1] != len(known) - 1:
        raise ValueError("word ids are missing: the input changed between its two readings; write it first")
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out: list[bytes] = []
    packed = rows.column("codes").combine_chunks()
    part = ids[:0]
    for start in range(0, len(rows), 256):  # few rows at a time: ids take several times a text's bytes
        codes, offsets = unpack_varints(packed.slice(start, 256))
        if len(codes) and codes.max() >= len(known):
            raise ValueError("word ids are missing: the input changed between its two readings; write it first")
        part, cut = ragged_take(ends, ids, first[codes] if len(codes) else codes)
        raw, at = part.tobytes(), (4 * cut[offsets]).tolist()
        out += [raw[a:b] for a, b in zip(at[:-1], at[1:])]
    del part
    give_back()
    return pa.table([rows.column("row"), pa.array(out, pa.binary())], names=["row", "ids"])


def encode(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its text, plus ``ids``: the text's token ids as packed little-endian uint32.

    Every match of the pattern is encoded separately, without special tokens.
    Null and empty texts have no ids; rows are kept as they are, repeated ones
    too; other columns pass through, one named like ``ids`` is replaced.
    """
    spark = docs.sparkSession
    others = [F.col(c) for c in docs.columns if c.lower() != text.lower()]
    source = docs.select(F.struct(*(others or [F.lit(None).cast("int").alias("_")])).alias("row"),
                         F.col(text).cast("string").alias("text"))
    ranks = spark.sparkContext.broadcast(vocab.read_ranks(ranks_path))
    words = (source.select("text").mapInArrow(_word_rows(block_bytes), "block long, code int, word string")
             .repartition("word").sortWithinPartitions("word")
             .mapInArrow(_encode_words(ranks), "block long, codes binary, lengths binary, ids binary"))
    schema = T.StructType([T.StructField("block", T.LongType()), source.schema["row"],
                           T.StructField("codes", T.BinaryType())])
    rows = source.mapInArrow(_code_rows(block_bytes), schema)
    result = T.StructType([source.schema["row"], T.StructField("ids", T.BinaryType())])
    whole = rows.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_assemble, result)
    out = outputs_last(whole, "row", **{ids: "ids"})
    return out if others else out.drop("_")


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` plus ``out``: the bytes of its ids, from the token-byte table.

    Null ids decode to no bytes; an id outside the table is an error.
    """
    table = vocab.token_bytes(ranks_path)  # as many rows as the vocabulary, whatever the data
    data = encoded.sparkSession.sparkContext.broadcast(
        (np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64), b"".join(table)))

    @F.pandas_udf("binary")
    def run(packed):
        ends, raw = data.value
        raw = np.frombuffer(raw, np.uint8)
        import pandas as pd

        return pd.Series([
            ragged_take(ends, raw, np.frombuffer(p or b"", "<u4").astype(np.int64))[0].tobytes() for p in packed])

    return encoded.withColumn(out, run(F.col(ids)))
