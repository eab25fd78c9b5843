"""Vocabulary files of public tokenizers, read once on the driver.

A vocabulary has a fixed number of entries (tens of thousands), so its table
is sent to the tasks as a broadcast of known size (about 1 MB).
"""

from __future__ import annotations

import base64
import functools
import json
from pathlib import Path

import tiktoken

#: The pattern that splits text before the merges, as in the vocabulary's own documentation.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str) -> str:
    """Place of a file of the installed package ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


def read_json_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE ``.json`` file, without its special tokens.

    Such a file spells bytes as printable characters: the printable Latin-1
    bytes as themselves, the others as characters from U+0100 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {t["content"] for t in data.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}


def added_tokens(path: str) -> dict[str, int]:
    """Strings and ids of the added tokens of a ``.json`` file: those that match as they stand, wherever they are."""
    added = json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at the text around them are not supported")
    return {t["content"]: t["id"] for t in added}


_LAST: list = [None, None]


def encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """The encoder of ``ranks``, kept for the next task of a Python worker."""
    if _LAST[0] is not ranks:
        _LAST[:] = ranks, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LAST[1]


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id (driver side)."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table
