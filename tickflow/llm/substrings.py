"""Operator 5: removal of repeated substrings by a depth-limited radix sort of suffixes.

Method.  Suffixes are ordered only as deep as the threshold (200 bytes), by
most-significant-digit passes; groups that are still equal after the last
pass are exactly the repeated windows.  The passes are shuffles:

1. Anchors: of the suffixes only those at the anchors of windows are sorted
   (see ``suffixes``; equal windows have equal anchors).  First digit: the 64
   bytes at the anchor.  A suffix alone with its digit is dropped.
2. Second digit: the whole region of an anchor, that is all windows it stands
   for.  Anchors with equal regions are equal in all their windows.
3. Third digit, for anchors whose first digit is shared by different regions
   (the edges of copies): their single windows.  Groups of at most ``GROUP``
   anchors are sorted within a task.  Larger groups take two more passes, so
   none is ever gathered: the windows of an anchor in runs of ``STEP``, first
   digit the bytes common to a run's windows, second digit all bytes of the
   run; only runs with equal first and different second digits are exploded
   into one row per window.  Both ways give the same windows.

Nothing is put in order but small groups: a pass brings equal digits together,
which is what the order is needed for.  Counts are aggregated before they are
shuffled and written; members get them by joins of two tables, which adaptive
execution splits where a digit is hot.  Texts are shuffled by their hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.llm.frames import outputs_last, written
from tickflow.llm.suffixes import BLOCK, GRAM, Hashes, anchors, forget_powers
from tickflow.llm.text import U64, mixed, tidy

#: Bytes of a window.
WIDTH = 200
#: Anchors with the same first digit that are sorted in one task.
GROUP = 256
#: Windows of a run, in groups of more anchors.
STEP = 12


def _pieces(batch: pa.RecordBatch, width: int, block: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Blocks of (row, offset in its text, bytes); long texts are cut with an overlap of one window."""
    rows, offsets, parts, size = [], [], [], 0
    for i, value in enumerate(batch.column("text").cast(pa.binary())):
        n = len(value.as_buffer()) if value.is_valid else 0
        if n < width:
            continue
        raw = value.as_py()
        for at in range(0, n - width + 1, block - width + 1):
            part = raw[at:at + block]
            if size and size + len(part) > block:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, offsets, parts


def _anchor_rows(width: int, block: int):
    """(digit, region, t, n, place): place packs the first window's start, the further windows and the anchor's shift."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n = batch.column("t").to_numpy(), batch.column("n").to_numpy()
            for rows, offsets, parts in _pieces(batch, width, block):
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                hashes = Hashes(np.frombuffer(b"".join(parts), np.uint8))
                found = anchors(hashes, bounds, width)
                if not len(found.at):
                    continue
                piece = np.searchsorted(bounds, found.at, "right") - 1
                row = np.asarray(rows)[piece]
                shift = found.at - found.low
                start = found.low - bounds[piece] + np.asarray(offsets)[piece]
                region = mixed(hashes.of(found.low, found.high + width) + shift.astype(U64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.of(found.at, found.at + GRAM).view(np.int64)), pa.array(region.view(np.int64)),
                     pa.array(t[row]), pa.array(n[row]), pa.array((start << 16) | ((found.high - found.low) << 8) | shift)],
                    names=["digit", "region", "t", "n", "place"])
    return run


def _runs(raw: bytes, digit: int, more: int, shift: int, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(digit, region, first and further windows, bytes) of an anchor's runs of at most STEP windows.

    Runs are cut by the anchor's place in the window, so equal windows lie in
    runs of the same name; a run at the end of the region may be shorter.
    """
    h = Hashes(np.frombuffer(raw, np.uint8))
    b = np.arange((shift - more) // STEP, shift // STEP + 1)
    low, high = np.maximum(b * STEP, shift - more), np.minimum(b * STEP + STEP - 1, shift)
    core = shift - b * STEP  # where the last window of a whole run begins
    digits = mixed(mixed(h.of(core, core + width - STEP + 1) + U64(digit & (1 << 64) - 1)) + b.astype(U64))
    regions = mixed(h.of(shift - high, shift - low + width) + (low * 512 + high).astype(U64))
    for d, r, i, j in zip(digits.view(np.int64).tolist(), regions.view(np.int64).tolist(), (shift - high).tolist(), (shift - low).tolist()):
        yield d, r, i, j - i, raw[i:j + width]


def _open_rows(width: int, group: int):
    """Texts with their open anchors to (digit, region, alone, t, n, place, raw, run): whole in small groups, runs of large."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digit", "region", "alone", "t", "n", "place", "raw", "run"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            for t, n, text, open_ in zip(*(batch.column(c).to_pylist() for c in ("t", "n", "text", "open"))):
                text = text.encode()
                for a in open_:
                    start, more, shift = a["place"] >> 16, (a["place"] >> 8) & 255, a["place"] & 255
                    raw = text[start:start + more + width]
                    if a["count"] <= group:
                        out.append((a["digit"], a["region"], a["alone"], t, n, a["place"], raw, False))
                    else:
                        out += [(digit, region, a["alone"], t, n, ((start + first) << 16) | (further << 8), part, True)
                                for digit, region, first, further, part in _runs(raw, a["digit"], more, shift, width)]
            for at in range(0, len(out), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at:at + (1 << 14)]), types)], names=names)
    return run


def _windows(width: int):
    """Runs (region, alone, t, n, place, raw) to one row for each of their windows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(at, 1 << 12)
                raw, place = part.column("raw").to_pylist(), part.column("place").to_numpy()
                count = ((place >> 8) & 255) + 1
                owner = np.repeat(np.arange(len(raw)), count)
                k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                begin = np.concatenate([[0], np.cumsum([len(r) for r in raw])])[owner] + k
                h = Hashes(np.frombuffer(b"".join(raw), np.uint8))
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(h.of(begin, begin + width, x).view(np.int64)) for x in (0, 1)),
                     *(part.column(c).take(rows) for c in ("region", "alone", "t", "n")), pa.array(((place >> 16)[owner] + k) << 16)],
                    names=["w1", "w2", "region", "alone", "t", "n", "place"])
    return run


def _equal_windows(width: int):
    """Anchors sorted by digit and region to the places of windows that another anchor of the digit has too."""
    def groups(batches):
        held = None
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            batch = batch if held is None else pa.concat_tables([held, batch])
            digit = batch.column("digit").to_numpy()
            last = int(np.searchsorted(digit, digit[-1]))  # the last digit may go on in the next batch
            if last:
                yield batch.slice(0, last)
            held = batch.slice(last)
        if held is not None:
            yield held

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            digit, region = table.column("digit").to_numpy(), table.column("region").to_numpy()
            new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (region[1:] != region[:-1])])  # copies of a text
            table = table.filter(pa.array(new)).combine_chunks()
            digit, place = table.column("digit").to_numpy(), table.column("place").to_numpy()
            raw = table.column("raw").to_pylist()
            more = (place >> 8) & 255
            begin = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            owner = np.repeat(np.arange(len(raw)), more + 1)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
            at = begin[owner] + k
            h = Hashes(np.frombuffer(b"".join(raw), np.uint8))
            key = mixed(h.of(at, at + width) + digit[owner].view(U64))
            second = h.of(at, at + width, 1)
            order = np.lexsort((second, key))
            same = (key[order[1:]] == key[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            twice &= table.column("alone").to_numpy()[owner]  # anchors with an equal one are removed as a whole
            hit = np.flatnonzero(twice)
            if not len(hit):
                continue
            first = np.concatenate([[True], (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])])
            run_start = hit[first]
            run_end = hit[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(hit) - 1]])]
            own = owner[run_start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(table.column("t").to_numpy()[own]), pa.array(table.column("n").to_numpy()[own]),
                 pa.array((((place[own] >> 16) + k[run_start]) << 16) | ((run_end - run_start) << 8))], names=["t", "n", "place"])
    return run


def _remove(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                raw = (text or "").encode()
                found = []
                if places:
                    place = np.sort(np.asarray(places, np.int64))
                    begin = place >> 16
                    end = np.maximum.accumulate(begin + ((place >> 8) & 255) + width)
                    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                    found = list(zip(begin[new].tolist(), end[np.concatenate([new[1:] - 1, [len(end) - 1]])].tolist()))
                    cut = [0, *(x for span in found for x in span), len(raw)]
                    raw = b"".join(raw[a:b] for a, b in zip(cut[::2], cut[1::2]))
                kept.append(raw)
                spans.append([{"begin": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                names=["row", "kept", "spans"])
    return run


def as_text(kept: str) -> Column:
    """A column of kept bytes as text; what a removal left of a character cut in two is dropped."""
    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: x.decode("utf-8", "ignore"))

    return run(F.col(kept))


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """``docs`` plus kept (binary: the bytes that stay) and spans (begin, end in bytes of what was removed, in order).

    A byte goes if any ``width``-byte string over it starts anywhere else
    too, in the same text or another; strings are judged on the input, so
    every copy of a passage goes, and of two equal rows all bytes of texts of
    at least ``width`` bytes.  A null text is empty; texts shorter than
    ``width`` stay.  Columns named like an output are replaced.  ``width``
    is at least 2 * GRAM and at most 319, for windows are packed in a byte.
    """
    if not 2 * GRAM <= width <= 319:
        raise ValueError("width must be 128 to 319")
    source = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    source = source.withColumn("t", F.xxhash64("text")).withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)))
    found = (source.where(F.col("n") >= width).select("t", "n", "text")
             .mapInArrow(tidy(_anchor_rows(width, block), forget_powers), "digit long, region long, t long, n int, place long"))
    found = written(found, "substrings")  # anchors are made once
    shared = written(found.groupBy("digit").agg(F.count("*").alias("count")).where("count > 1"), "substrings")
    equal = written(found.join(shared, "digit"), "substrings")
    regions = equal.groupBy("digit", "region").agg(
        F.count("*").alias("times"), F.max("count").alias("count"), F.min(F.struct("t", "n", "place")).alias("one"))
    several = written(regions.where("times > 1").select("digit", "region"), "substrings")
    whole = equal.join(several, ["digit", "region"]).select("t", "n", "place").distinct()
    open_ = (regions.where("times < count")
             .select(F.col("one.t").alias("t"), F.col("one.n").alias("n"),
                     F.struct("digit", "region", "count", (F.col("times") == 1).alias("alone"), F.col("one.place").alias("place")).alias("a"))
             .groupBy("t", "n").agg(F.collect_list("a").alias("open")))  # anchors of one text, at most one per byte
    third = source.join(open_, ["t", "n"]).mapInArrow(
        tidy(_open_rows(width, group), forget_powers),
        "digit long, region long, alone boolean, t long, n int, place long, raw binary, run boolean")
    third = written(third, "substrings")
    small = (third.where("not run").drop("run").repartition("digit").sortWithinPartitions("digit", "region")
             .mapInArrow(tidy(_equal_windows(width), forget_powers), "t long, n int, place long"))
    runs = third.where("run").drop("run")
    classes = written(runs.groupBy("digit", "region").agg(
        F.count("*").alias("times"), F.min(F.struct("alone", "t", "n", "place", "raw")).alias("one")), "substrings")
    equal_runs = (runs.where("alone").join(classes.where("times > 1").select("digit", "region"), ["digit", "region"])
                  .select("t", "n", "place"))
    mixed_digits = classes.groupBy("digit").agg(F.count("*").alias("classes")).where("classes > 1").select("digit")
    single = (classes.join(mixed_digits, "digit")
              .select("region", (F.col("one.alone") & (F.col("times") == 1)).alias("alone"), "one.t", "one.n", "one.place", "one.raw"))
    large = written(single.mapInArrow(tidy(_windows(width), forget_powers),
                                      "w1 long, w2 long, region long, alone boolean, t long, n int, place long"), "substrings")
    twice = large.groupBy("w1", "w2").agg(F.min("region").alias("a"), F.max("region").alias("b")).where("a < b")
    singles = large.where("alone").join(twice.select("w1", "w2"), ["w1", "w2"]).select("t", "n", "place").distinct()
    places = (whole.union(small).union(equal_runs).union(singles).groupBy("t", "n").agg(F.collect_list("place").alias("places")))
    schema = T.StructType([source.schema["row"], T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(
        T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))])
    joined = source.join(places, ["t", "n"], "left").select("row", "text", "places")
    return outputs_last(joined.mapInArrow(tidy(_remove(width)), schema), "row", kept="kept", spans="spans")
