"""Sampled sentence-piece segmentations, reproducible per row, and lossless decoding.

A text with a space put before it is a lattice: every vocabulary piece that matches somewhere is an edge, weighted by
its score, and a character outside the vocabulary is an edge of its byte pieces. Forward filtering sums the weights of
all paths to every position; backward sampling walks from the end and takes each edge with its exact conditional
probability. Positions that no piece spans split the lattice into independent chunks, and equal chunks share one
forward pass. The random numbers are a hash of row key, chunk and step, so they do not depend on how rows are dealt.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import map_rows
from ebbtide.llm.near_dedup import mixed

MODEL = "piece_bpe_32k.model"
SHARPNESS = 1e-4  # edge weight = exp(SHARPNESS * score); scores of this kind of model are negative ranks
SLICE = 1024
SLICE_CHARS = 1 << 22

_BASE = np.uint64(0x9E3779B97F4A7C15)
_GOLD = 0xD6E8FEB86659FD93
# What no piece spans: anything before a space, a line feed's two sides, and letters next to other visible characters.
_CHUNK = re.compile(r" +[^\W\d_]*|[^\W\d_]+|[^\w \n]+|[\d_]+|\n")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by length: sorted hashes, with ids and scores in the same order; ``byte`` maps byte values to ids."""

    hashes: dict[int, np.ndarray]
    ids: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]
    byte: np.ndarray
    data: list[bytes]
    spanned: frozenset[str]

    @property
    def longest(self) -> int:
        return max(self.hashes)


def _rolling(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers, such that hash(i, j) = prefix[j] - prefix[i] * power[j - i]."""
    value = mixed(points.astype(np.uint64) + np.uint64(1))
    power = np.ones(len(points) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(points), _BASE), out=power[1:]) if len(points) else None
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    back = np.ones(len(points) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(points), inverse), out=back[1:]) if len(points) else None
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(value * back[1:], out=total[1:])
    return total * power, power


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte, data, found = np.full(256, -1), [b""] * size, {}
    spanned = set()
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            data[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            text = piece.replace("▁", " ")
            data[i] = text.encode()
            prefix, _ = _rolling(_points(text))
            found.setdefault(len(text), []).append((int(prefix[-1]), i, model.get_score(i)))
            spanned.update(a + b for a, b in zip(text, text[1:]))
    if (byte < 0).any():
        raise ValueError("the vocabulary has no pieces for single bytes")
    hashes, ids, scores = {}, {}, {}
    for length, rows in found.items():
        rows.sort()
        hashes[length] = np.array([r[0] for r in rows], np.uint64)
        ids[length] = np.array([r[1] for r in rows])
        scores[length] = np.array([r[2] for r in rows])
    return Vocabulary(hashes, ids, scores, byte, data, frozenset(spanned))


@functools.lru_cache(maxsize=2)
def chunker(path: str):
    """Splits a text only where no piece of the vocabulary spans the two characters."""
    spanned = vocabulary(path).spanned
    wrong = {(_kind(a), _kind(b)) for a, b in spanned}
    joined = {(a, b) for a, b in wrong if a != b and (a, b) != ("space", "letter")}

    def split(text: str) -> list[str]:
        found = _CHUNK.findall(text)
        if not joined:
            return found
        whole, last = [], None
        for chunk in found:
            if last is not None and last + chunk[0] in spanned:
                whole[-1] += chunk
            else:
                whole.append(chunk)
            last = chunk[-1]
        return whole

    return split


def _kind(c: str) -> str:
    if c == " " or c == "\n":
        return "space" if c == " " else "line"
    return "letter" if re.match(r"[^\W\d_]", c) else "digit" if re.match(r"[\d_]", c) else "other"


@dataclass(frozen=True)
class Lattice:
    """Edges of all chunks by end position: those of end e are ``first[e] .. first[e + 1]``; ``steps`` is their end
    plus the running share, so one sorted search draws an edge."""

    starts: np.ndarray
    ends: np.ndarray
    steps: np.ndarray
    source: np.ndarray
    ids: np.ndarray
    points: np.ndarray


def filtered(chunks: list[str], words: Vocabulary, sharpness: float) -> Lattice:
    """Forward pass over the chunks at once. Chunk k has positions ``starts[k] .. ends[k]``, one more than characters."""
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    points = _points("".join(chunks))
    n = len(points)
    char_first = np.cumsum(lengths) - lengths
    starts = char_first + np.arange(len(chunks))
    ends = starts + lengths
    prefix, power = _rolling(points)
    owner = np.repeat(np.arange(len(chunks)), lengths)
    left = np.repeat(char_first + lengths, lengths) - np.arange(n)  # characters to the end of the chunk
    node = np.arange(n) + owner
    source, target, ids, weight = [], [], [], []
    for length in sorted(words.hashes):
        at = np.flatnonzero(left >= length)
        if not len(at):
            continue
        value = prefix[at + length] - prefix[at] * power[length]
        table = words.hashes[length]
        place = np.minimum(np.searchsorted(table, value), len(table) - 1)
        hit = table[place] == value
        source.append(node[at[hit]])
        target.append(node[at[hit]] + length)
        ids.append(words.ids[length][place[hit]])
        weight.append(words.scores[length][place[hit]] * sharpness)
        if length == 1:  # outside the vocabulary: the character itself, as -1 - its place
            lone = at[~hit]
            source.append(node[lone])
            target.append(node[lone] + 1)
            ids.append(-1 - lone)
            weight.append(np.zeros(len(lone)))
    source, target, ids, weight = (np.concatenate(x) for x in (source, target, ids, weight))
    depth = target - np.repeat(starts, lengths + 1)[target]
    order = np.lexsort((source, target, depth))
    alpha = np.full(n + len(chunks), -np.inf)
    alpha[starts] = 0.0
    bounds = np.searchsorted(depth[order], np.arange(1, lengths.max(initial=0) + 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        edges = order[a:b]
        value = alpha[source[edges]] + weight[edges]
        heads = np.flatnonzero(np.diff(target[edges], prepend=-1))
        top = np.maximum.reduceat(value, heads)
        total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(heads, append=b - a))), heads)
        alpha[target[edges][heads]] = top + np.log(total)
    order = np.lexsort((source, target))
    source, target, ids, weight = source[order], target[order], ids[order], weight[order]
    share = np.exp(alpha[source] + weight - alpha[target])
    running = np.cumsum(share)
    heads = np.flatnonzero(np.diff(target, prepend=-1))
    counts = np.diff(heads, append=len(target))
    base = np.repeat((running - share)[heads], counts)
    step = target + np.minimum(running - base, 1.0)
    step[heads + counts - 1] = target[heads] + 1.0  # the last edge takes what rounding left
    return Lattice(starts, ends, step, source, ids, points)


def sampled(lattice: Lattice, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward samples of chunks ``which``: (edge ids in reading order, number of edges per sample)."""
    at, floor = lattice.ends[which].copy(), lattice.starts[which]
    alive = np.arange(len(which))
    taken, step = [], 0
    while len(alive):
        draw = mixed(seeds[alive] + np.uint64(step * _GOLD % 2**64)) >> np.uint64(11)
        u = draw.astype(np.float64) / float(1 << 53)
        edge = np.searchsorted(lattice.steps, at[alive] + u, side="right")
        taken.append((alive, lattice.ids[edge]))
        at[alive] = lattice.source[edge]
        alive = alive[at[alive] > floor[alive]]
        step += 1
    counts = np.zeros(len(which), np.int64)
    for rows, _ in taken:
        counts[rows] += 1
    out = np.empty(counts.sum(), np.int64)
    last = np.cumsum(counts) - 1
    for k, (rows, ids) in enumerate(taken):
        out[last[rows] - k] = ids
    return out, counts


def encode_texts(texts: list[str | None], keys: list[int], path: str, sharpness: float = SHARPNESS) -> list[np.ndarray]:
    """A sampled segmentation of every whole text, as ids; NULL and empty texts have none."""
    words, split = vocabulary(path), chunker(path)
    chunks = [split(" " + t) if t else [] for t in texts]
    per = np.fromiter(map(len, chunks), np.int64, len(texts))
    if not per.sum():
        return [np.zeros(0, np.int64)] * len(texts)
    which, distinct = pd.factorize(np.array(list(chain.from_iterable(chunks)), object))
    lattice = filtered(list(distinct), words, sharpness)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    seeds = mixed(mixed(np.repeat(np.array(keys, np.int64).view(np.uint64), per)) + place.astype(np.uint64) * _BASE)
    ids, counts = sampled(lattice, which, seeds)
    ids, width = _bytes(ids, lattice, words)
    ends = np.concatenate([[0], np.cumsum(width)])[np.cumsum(counts)]
    return np.split(ids, np.concatenate([[0], ends])[np.cumsum(per)][:-1])


def _bytes(ids: np.ndarray, lattice: Lattice, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside the vocabulary as their byte pieces; also the ids each edge became."""
    width = np.ones(len(ids), np.int64)
    lone = np.flatnonzero(ids < 0)
    if not len(lone):
        return ids, width
    points, inverse = np.unique(lattice.points[-1 - ids[lone]], return_inverse=True)
    spelt = [words.byte[list(chr(p).encode("utf-8", "surrogatepass"))] for p in points]
    width[lone] = np.array([len(s) for s in spelt])[inverse]
    out = np.repeat(ids, width)
    first = (np.cumsum(width) - width)[lone]
    for k in range(4):
        rows = np.flatnonzero(width[lone] > k)
        out[first[rows] + k] = np.array([s[k] if k < len(s) else -1 for s in spelt])[inverse[rows]]
    return out, width


def decode_ids(ids, path: str) -> str:
    """The text of any segmentation."""
    data = vocabulary(path).data
    return b"".join([data[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def _sliced(rows: dict) -> list[slice]:
    """Consecutive rows of at most SLICE_CHARS characters, or one longer text."""
    found, start, held = [], 0, 0
    for i, text in enumerate(rows["text"]):
        held += len(text or "")
        if held > SLICE_CHARS and i > start:
            found.append(slice(start, i))
            start, held = i, len(text or "")
    return [*found, slice(start, len(rows["text"]))]


def encode(docs: DataFrame, path: str, sharpness: float = SHARPNESS, seed: int = 0, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_pieces, ids_crc32, lossless[, ids]) of every row.

    The sample depends on the id, the text and ``seed`` alone, so repeated rows get equal segmentations; rows with a
    NULL id share one key. NULL and empty texts have no pieces. ``lossless`` says that decoding gave the text back.
    Other columns are not read; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(slices):
        for rows in slices:
            out = {"id": rows["id"], "n_pieces": [], "ids_crc32": [], "lossless": [], "ids": []}
            for part in _sliced(rows):
                texts = rows["text"][part]
                for text, ids in zip(texts, encode_texts(texts, rows["key"][part], path, sharpness)):
                    out["n_pieces"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    out["lossless"].append(decode_ids(ids.tolist(), path) == (text or ""))
                    out["ids"].append(ids.astype(np.int32) if with_ids else None)
            yield out

    schema = f"id {kind}, n_pieces long, ids_crc32 long, lossless boolean" + (", ids array<int>" if with_ids else "")
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    return map_rows(rows, run, schema, SLICE).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds the text of each row's ids; NULL ids give an empty text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: "" if x is None else decode_ids(x, path))

    return rows.withColumn(text_col, text(ids_col))
