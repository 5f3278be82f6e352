"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json; tests hold both against each other
END = 2
SPECIAL = {"<|endoftext|>": 50256}  # the added tokens of byte_bpe_50k.json, found in texts too


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """As the ``.json`` form without further settings: the string of a special token is that token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def id_bytes(path: str) -> int:
    """Bytes that hold every id of the vocabulary: 2 or 4."""
    return 2 if max(encoding(path).max_token_value, END) < 2 ** 16 else 4


@functools.lru_cache(maxsize=2)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


def token_ids(text: str | None, path: str, end: int | None = END) -> np.ndarray:
    """Ids of the whole text (NULL as empty) as unsigned 32-bit numbers, then the end id unless it is None."""
    try:
        ids = encoding(path).encode(text or "", allowed_special="all")
    except ValueError:  # its pattern matcher gives up on some endless runs of white space
        ids = _slow(path).encode(text, add_special_tokens=False).ids
    return np.fromiter(itertools.chain(ids, () if end is None else (end,)), np.uint32)


def pieces(ids: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of consecutive pieces; all but the first have ``size`` ids."""
    head = len(ids) % size
    start = 0
    for stop in range(head or size, len(ids) + 1, size):
        yield start, ids[start:stop]
        start = stop


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
