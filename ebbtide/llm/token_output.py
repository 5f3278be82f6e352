"""Token sequences in training order, as binary shards of a fixed stride.

A keyed Feistel network permutes the numbers 0 .. n - 1 (cycle-walking skips what its power-of-four domain has beyond
them), so the slot of every sequence is computed, not stored or sorted for. Range partitions of the slots become
shards: ``per_shard`` records of ``size`` ids each, every record at (slot % per_shard) * stride of shard
slot // per_shard. Readers go on from any slot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ebbtide.llm import tokens
from ebbtide.llm.common import arrow_schema, map_rows
from ebbtide.llm.near_dedup import mixed
from ebbtide.session import stage

SIZE = 1024
PER_SHARD = 512
KEY = 20_240_229
ROUNDS = 8
PAD = 0


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0 .. n - 1 chosen by ``key``."""

    n: int
    key: int = KEY

    def _half(self) -> int:
        return max(1, (max(1, self.n - 1).bit_length() + 1) // 2)

    def _rounds(self, value: np.ndarray, backwards: bool) -> np.ndarray:
        half = np.uint64(self._half())
        mask = np.uint64((1 << int(half)) - 1)
        left, right = value >> half, value & mask
        keys = mixed(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(self.key * 1009 % 2**64))
        for k in keys[::-1] if backwards else keys:
            if backwards:
                left, right = right ^ (mixed(left + k) & mask), left
            else:
                left, right = right, left ^ (mixed(right + k) & mask)
        return (left << half) | right

    def _walk(self, index: np.ndarray, backwards: bool) -> np.ndarray:
        value = self._rounds(np.asarray(index).astype(np.uint64), backwards)
        while (out := np.flatnonzero(value >= np.uint64(self.n))).size:
            value[out] = self._rounds(value[out], backwards)
        return value.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _record(id_bytes: int) -> np.dtype:
    return np.dtype(f"<u{id_bytes}")


def sequences(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Stage table (id, piece, length, ids, part, local): every document's ids and the end id, in pieces.

    Pieces but the first have ``size`` ids, each of as many bytes as the vocabulary's largest id needs. NULL and empty
    texts are just the end id. ``local`` counts within ``part``.
    """
    kind, record = docs.schema[id_col].dataType.simpleString(), _record(tokens.id_bytes(vocabulary))

    def cut(slices):
        part, local = TaskContext.get().partitionId(), 0
        for rows in slices:
            out = {name: [] for name in ("id", "piece", "length", "ids", "part", "local")}
            for doc, text in zip(rows["id"], rows["text"]):
                for i, (_, ids) in enumerate(tokens.pieces(tokens.token_ids(text, vocabulary), size)):
                    for name, value in (("id", doc), ("piece", i), ("length", len(ids)), ("part", part),
                                        ("ids", ids.astype(record).tobytes()), ("local", local)):
                        out[name].append(value)
                    local += 1
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stage(map_rows(rows, cut, f"id {kind}, piece int, length int, ids binary, part int, local long"), "sequences")


def in_training_order(rows: DataFrame, key: int = KEY) -> DataFrame:
    """Adds ``slot``: sequences are numbered by (part, local) and permuted. One number per task reaches the driver."""
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    parts = np.array([r["part"] for r in counts], np.int64)
    sizes = np.array([r["n"] for r in counts], np.int64)
    first, order = np.cumsum(sizes) - sizes, Permutation(int(sizes.sum()), key)

    def place(batches):
        for batch in batches:
            part, local = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("part", "local"))
            slot = order.slot(first[np.searchsorted(parts, part)] + local) if len(part) else local
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot, pa.int64())], names=[*batch.schema.names, "slot"])

    return rows.mapInArrow(place, StructType([*rows.schema.fields, StructField("slot", LongType())]))


def shards(ordered: DataFrame, size: int = SIZE, per_shard: int = PER_SHARD, id_bytes: int = 2) -> DataFrame:
    """One row per shard, range-partitioned and sorted by shard.

    (shard, first_slot, n_sequences, stride, id_bytes, doc_ids, pieces, lengths, payload): the arrays name each record's
    document, piece and number of ids; records are padded to the stride. A task holds one shard at a time.
    """
    kind = ordered.schema["id"].dataType.simpleString()
    schema = (f"shard long, first_slot long, n_sequences int, stride int, id_bytes int, doc_ids array<{kind}>, pieces array<int>, "
              "lengths array<int>, payload binary")
    rows = ordered.withColumn("shard", F.floor(F.col("slot") / per_shard))
    dealt = rows.repartitionByRange("shard").sortWithinPartitions("shard", "slot")
    stride, kept, fields = size * id_bytes, _record(id_bytes), arrow_schema(schema)

    def write(batches):
        shard, held = None, []

        def packed():
            doc_ids, pieces, lengths, ids = zip(*held)
            record = np.full((len(held), size), PAD, kept)
            for i, data in enumerate(ids):
                record[i, : lengths[i]] = np.frombuffer(data, kept)
            values = [shard, shard * per_shard, len(held), stride, id_bytes, list(doc_ids), list(pieces), list(lengths), record.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields)], schema=fields)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "piece", "length", "ids")]
            for number, *row in zip(batch.column(batch.schema.get_field_index("shard")).to_pylist(), *columns):
                if number != shard and held:
                    yield packed()
                    held = []
                shard = number
                held.append(row)
        if held:
            yield packed()

    return dealt.select("id", "piece", "length", "ids", "shard").mapInArrow(write, schema)


def materialise(docs: DataFrame, vocabulary: str, key: int = KEY, size: int = SIZE, per_shard: int = PER_SHARD,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All sequences of ``docs`` as shards in training order, ready for ``write.parquet``.

    Repeated rows are sequences of their own; a NULL id is kept. The order depends on the key, the number of sequences
    and how the input is split into tasks. An empty table gives no shard. Other columns are not read.
    """
    rows = sequences(docs, vocabulary, size, id_col, text_col)
    return shards(in_training_order(rows, key), size, per_shard, tokens.id_bytes(vocabulary))


def read_sequences(written: DataFrame, first_slot: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, doc_id, piece, ids) from a slot on; shards before it are skipped by the scan."""
    kind = written.schema["doc_ids"].dataType.elementType.simpleString()

    def read(slices):
        for rows in slices:
            out = {"slot": [], "doc_id": [], "piece": [], "ids": []}
            for first, stride, width, docs, pieces, lengths, data in zip(
                rows["first_slot"], rows["stride"], rows["id_bytes"], rows["doc_ids"], rows["pieces"], rows["lengths"], rows["payload"]
            ):
                record = np.frombuffer(data, _record(width)).reshape(len(docs), stride // width)
                for i in range(max(0, first_slot - first), len(docs)):
                    out["slot"].append(first + i)
                    out["doc_id"].append(docs[i])
                    out["piece"].append(pieces[i])
                    out["ids"].append(record[i, : lengths[i]].astype(np.int32))
            yield out

    wanted = written.where(F.col("shard") >= first_slot // per_shard)
    return map_rows(wanted, read, f"slot long, doc_id {kind}, piece int, ids array<int>", slice_rows=8)
