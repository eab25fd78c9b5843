"""Operator 9: chat formatting by token-level assembly.

Method.  Every turn's text is encoded on its own; reserved ids for the
template's control strings are spliced around it; each token's place in the
conversation and the loss mask come from prefix sums over the turns.  Control
strings that occur in a text are escaped first, reversibly, so that the text
form of the output is as unambiguous as its ids.

Template: ``<s>`` before the first turn; a user turn is ``[INST]`` text
``[/INST]``, an assistant turn text ``</s>``, a system turn ``[SYS]`` text
``[/SYS]``, any other role ``[ROLE]`` role ``[/ROLE]`` text ``</s>``.

The output has one row per turn, so a conversation of any length is never one
value in one row; its tokens are the turns' tokens in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickflow.llm import vocab
from tickflow.llm.frames import outputs_last

#: The control strings of the template, in the order of their reserved ids.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"]
#: First reserved id; the vocabulary ends at 50255 and its end mark is 50256.
FIRST_RESERVED = 50257
IDS = {c: FIRST_RESERVED + i for i, c in enumerate(CONTROLS)}
_TAIL = r"(/?s>|/?INST\]|/?SYS\]|/?ROLE\])"
_ESCAPE = regex.compile(r"([<\[])(\\*)" + _TAIL)
_UNESCAPE = regex.compile(r"([<\[])\\(\\*)" + _TAIL)


def escape(text: str) -> str:
    """One more backslash after the first character of whatever looks like a control string."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """Inverse of :func:`escape`."""
    return _UNESCAPE.sub(r"\1\2\3", text)


def turn_ids(role: str, text: str, encode) -> tuple[list[int], int, int]:
    """Ids of one turn, and where its text's own ids begin and end."""
    own = encode(escape(text))
    if role == "user":
        head, tail = [IDS["[INST]"]], [IDS["[/INST]"]]
    elif role == "system":
        head, tail = [IDS["[SYS]"]], [IDS["[/SYS]"]]
    elif role == "assistant":
        head, tail = [], [IDS["</s>"]]
    else:
        head, tail = [IDS["[ROLE]"], *encode(escape(role)), IDS["[/ROLE]"]], [IDS["</s>"]]
    return head + own + tail, len(head), len(head) + len(own)


def format_turns(turns: DataFrame, ranks_path: str, conversation: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` plus n (the turn's place from 0), ids, start, length, loss_start, loss_length.

    ``ids`` are the turn's tokens as packed little-endian uint32; ``start`` is
    the number of the conversation's tokens before them, ``loss_start`` the
    number of its masked tokens before the turn; the loss mask covers
    ``loss_length`` of the turn's tokens from the ``loss_from``-th on (an
    assistant's text, without control ids).  Turns are ordered by ``turn``,
    then role, then text (nulls first); repeated rows are turns of their own.
    A null text is empty, a null role the role ''.  Null conversations are one
    conversation.  Columns named like an output are replaced.
    """
    ranks = turns.sparkSession.sparkContext.broadcast(vocab.read_ranks(ranks_path))

    @F.pandas_udf("ids binary, loss_from int, loss_length int")
    def encode_turn(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        encode = vocab.encoding(ranks.value).encode_ordinary
        out = []
        for r, t in zip(roles, texts):
            ids, first, last = turn_ids(r, t, encode)
            out.append((np.asarray(ids, "<u4").tobytes(), first, last - first if r == "assistant" else 0))
        return pd.DataFrame(out, columns=["ids", "loss_from", "loss_length"])

    rows = turns.select(F.struct(*[F.col(c) for c in turns.columns]).alias("row"), F.col(conversation).alias("__c"),
                        F.col(turn).alias("__t"), F.coalesce(F.col(role), F.lit("")).alias("__r"),
                        F.coalesce(F.col(text), F.lit("")).alias("__x"))
    rows = rows.withColumn("e", encode_turn("__r", "__x"))
    order = Window.partitionBy("__c").orderBy("__t", "__r", "__x")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("n", F.row_number().over(order).cast("long") - 1)
            # the conversation's first id stands before its first turn
            .withColumn("ids", F.when(F.col("n") == 0, F.concat(F.lit(IDS["<s>"].to_bytes(4, "little")), F.col("e.ids")))
                        .otherwise(F.col("e.ids")))
            .withColumn("length", F.expr("length(ids) div 4").cast("long"))
            .withColumn("loss_from", F.col("e.loss_from") + F.when(F.col("n") == 0, 1).otherwise(0))
            .withColumn("loss_length", F.col("e.loss_length").cast("long"))
            .withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
            .withColumn("loss_start", F.coalesce(F.sum("loss_length").over(before), F.lit(0))))
    return outputs_last(rows, "row", **{c: c for c in ("n", "ids", "start", "length", "loss_start", "loss_from", "loss_length")})


def parse_turn(ids: list[int], table: list[bytes]) -> tuple[str, str, str]:
    """Role, unescaped text and formatted text of a turn, read from its ids."""
    decode = lambda part: b"".join(table[i] for i in part).decode("utf-8")
    formatted, run = [], []
    for i in ids:
        if i >= FIRST_RESERVED:
            formatted += [decode(run), CONTROLS[i - FIRST_RESERVED]]
            run = []
        else:
            run.append(i)
    formatted.append(decode(run))
    if ids and ids[0] == IDS["<s>"]:
        ids = ids[1:]
    first = ids[0] if ids else None
    if first == IDS["[INST]"]:
        role, body = "user", ids[1:-1]
    elif first == IDS["[SYS]"]:
        role, body = "system", ids[1:-1]
    elif first == IDS["[ROLE]"]:
        end = ids.index(IDS["[/ROLE]"])
        role, body = unescape(decode(ids[1:end])), ids[end + 1:-1]
    else:
        role, body = "assistant", ids[:-1]
    return role, unescape(decode(body)), "".join(formatted)


def read_back(formatted: DataFrame, ranks_path: str, conversation: str = "conv_id") -> DataFrame:
    """One row per conversation, decoded from the output of :func:`format_turns`.

    n_turns, turns_sha256 (over role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (code points and digest of all text under the
    loss mask, unescaped), formatted_chars (code points of the formatted
    text).  Turns pass by in order and only digests are kept, so a
    conversation may be longer than memory.
    """
    table = formatted.sparkSession.sparkContext.broadcast(vocab.token_bytes(ranks_path))
    kind = formatted.schema[conversation].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state = None, None
        done: list[tuple] = []

        def finish():
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of():
            arrays = [pa.array([d[k] for d in done], types[k]) for k in range(len(names))]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            types[0] = batch.schema.field("c").type
            cols = [batch.column(c).to_pylist() for c in ("c", "ids", "loss_from", "loss_length")]
            for c, ids, loss_from, loss_length in zip(*cols):
                if state is None or c != now:
                    finish()
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(ids, "<u4").tolist()
                role, text, whole = parse_turn(ids, table.value)
                masked = b"".join(table.value[i] for i in ids[loss_from:loss_from + loss_length])
                masked = unescape(masked.decode("utf-8"))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(whole)
            if len(done) > 4096:
                yield batch_of()
        finish()
        if done:
            yield batch_of()

    rows = (formatted.select(F.col(conversation).alias("c"), "n", "ids", "loss_from", "loss_length")
            .repartition("c").sortWithinPartitions("c", "n"))
    out = rows.mapInArrow(run, f"c {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
                               "loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("c", conversation)
