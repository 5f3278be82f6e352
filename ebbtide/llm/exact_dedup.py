"""Exact duplicates by sorting content.

Spark samples splitters and range-partitions the rows by their normalised bytes (a short prefix, then a hash that
tells longer texts apart, then the id, so that even a text that a third of all rows share is dealt over many
partitions). Sorting inside a partition (external, it spills) puts equal texts side by side; one scan compares
neighbours in full. A group that crosses partitions shows up as the first or last run of each, and these runs, at
most two per partition, are put together at the end.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.session import stage

BROADCAST_EDGES = 100_000  # rows of about 100 bytes
PREFIX = 64  # characters of the text that splitters hold; the sort and the comparison see all of it


def normalised(text: Column) -> Column:
    """NULL as empty, every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256[, row]).

    Texts equal after ``normalised`` form a group; its smallest id stays. NULL and empty texts are one group. Rows
    with equal ids and texts count one by one and exactly one of them stays. A NULL id loses against any other; a
    group of NULL ids keeps one row and its keep_id is NULL. An empty table gives an empty one. Only id and text are
    read; with ``carry``, kept rows have the whole input row as the struct ``row``, so no names can clash.
    """
    key = normalised(F.col(text_col))
    columns = [F.col(id_col).alias("id"), key.alias("norm")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = docs.select(*columns).withColumns({"prefix": F.substring("norm", 1, PREFIX), "h": F.xxhash64("norm")})
    order = [F.col("prefix"), F.col("h")]
    dealt = rows.repartitionByRange(*order, F.col("id").asc_nulls_last())
    sorted_rows = dealt.sortWithinPartitions(*order, "norm", F.col("id").asc_nulls_last())
    slim = sorted_rows.select("id", "norm", *(["row"] if carry else []))
    fields = [
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("keep_id", docs.schema[id_col].dataType),
        T.StructField("n", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("sha", T.StringType()),
        T.StructField("edge", T.BooleanType()), T.StructField("part", T.IntegerType()),
    ]
    if carry:
        fields.append(T.StructField("row", docs.schema))
    runs = stage(slim.mapInArrow(_scanner(carry), T.StructType(fields)), "runs")
    edges = (
        runs.where("edge").groupBy("sha")
        .agg(F.min("keep_id").alias("edge_keep"), F.sum(F.when(F.col("first"), F.col("n"))).alias("edge_n"),
             F.min("part").alias("edge_part"))
    )
    edges = stage(edges, "edges")  # at most two rows per partition of the sort
    if edges.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES:
        whole = runs.join(F.broadcast(edges), "sha", "left")
    else:  # only the rows of edge runs are shuffled
        inner = runs.where(~F.col("edge"))
        whole = runs.where("edge").join(edges.hint("merge"), "sha").unionByName(inner, allowMissingColumns=True)
    return whole.select(
        F.col("id").alias(id_col),
        F.coalesce("edge_keep", "keep_id").alias("keep_id"),
        F.coalesce("edge_n", "n").alias("group_size"),
        (F.col("first") & F.coalesce(F.col("part") == F.col("edge_part"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``; everything ``content_sort`` defines holds."""
    found = content_sort(docs, id_col, text_col, carry=True).where("kept")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


class _Run:
    """The open run of equal texts; of its rows only the ids are held, and the first row if it is carried."""

    def __init__(self, text: str, row):
        self.text, self.row, self.ids = text, row, []
        self.sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _scanner(carry: bool):
    def scan(batches):
        part, run, closed, opened = TaskContext.get().partitionId(), None, [], False

        def packed(runs, edges):
            ids, keep, n, first, sha, edge, rows, blank = [], [], [], [], [], [], [], None
            for r, e in zip(runs, edges):
                least, size = r.ids[0], sum(len(x) for x in r.ids)
                keep_id = least[0] if len(least) else None
                for x in r.ids:
                    ids.append(x)
                keep.append(pa.array([keep_id.as_py()] * size, keep_id.type))
                n += [size] * size
                first += [True] + [False] * (size - 1)
                sha += [r.sha] * size
                edge += [e] * size
                if carry:
                    blank = pa.nulls(size - 1, r.row.type)
                    rows += [r.row, blank]
            arrays = [
                pa.concat_arrays(ids), pa.concat_arrays(keep), pa.array(n, pa.int64()), pa.array(first), pa.array(sha),
                pa.array(edge), pa.array([part] * len(n), pa.int32()),
            ]
            names = ["id", "keep_id", "n", "first", "sha", "edge", "part"]
            if carry:
                arrays.append(pa.concat_arrays(rows))
                names.append("row")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, norm = batch.column(0), batch.column(1)
            same = pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *(i + 1 for i, s in enumerate(same) if not s)]
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                text = norm[start].as_py()
                if run is None or run.text != text:
                    if run is not None:
                        closed.append(run)
                    run = _Run(text, batch.column(2).slice(start, 1) if carry else None)
                run.ids.append(ids.slice(start, end - start))
            if closed:
                yield packed(closed, [not opened, *[False] * (len(closed) - 1)])
                opened, closed = True, []
        if run is not None:
            yield packed([run], [True])

    return scan
