"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_PARTS = 3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_of(doc_id: str) -> Column:
    """crc32 of the id as text, modulo three; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_PARTS


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows no model may learn from; a NULL id is not held out, and is never learnt from either."""
    return F.coalesce(part_of(doc_id) == 1, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(part_of(doc_id) != 1, F.lit(False))


def agreed_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label 0/1): the majority of a document's labels; evenly split, NULL and id-less rows are left out."""
    return (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.avg(F.col(label)).alias("_share"))
        .where(F.col("_share") != 0.5)
        .select("doc_id", (F.col("_share") > 0.5).cast("int").alias("label"))
    )


def hash_share(key: str, salt: int) -> Column:
    """A fixed number in [0, 1) for every key."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) / float(1 << 30)


def map_rows(df: DataFrame, function: Callable[[Iterator[dict]], Iterator[dict]], schema: str,
             slice_rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of at most ``slice_rows`` rows, each a dict of column lists.

    ``function`` gets the slices of one task and yields dicts of column lists in the order of ``schema``.
    """
    def run(batches):
        def slices():
            for batch in batches:
                for start in range(0, batch.num_rows, slice_rows):
                    piece = batch.slice(start, slice_rows)
                    yield {name: piece.column(i).to_pylist() for i, name in enumerate(piece.schema.names)}

        for columns in function(slices()):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in fields], schema=fields)

    fields = arrow_schema(schema)
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, wanted: Callable[[list], list[bool]], slice_rows: int = 512) -> DataFrame:
    """Rows of ``df`` whose text ``wanted`` accepts; it gets the texts of one slice at a time."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for start in range(0, batch.num_rows, slice_rows):
                piece = batch.slice(start, slice_rows)
                yield piece.filter(pa.array(wanted(piece.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
