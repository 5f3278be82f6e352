"""CSV records with line breaks inside quotes, cut by many tasks at once.

Whether a line lies inside quotes depends on everything before it, but only through one bit. A first pass finds, for
each split of a file, whether it ends inside quotes if it began outside and if it began inside; composing these along
a file gives the bit each split begins with. A second pass then cuts every split into records on its own. What a split
begins or ends in the middle of is a fragment; the few fragments are put together by file.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.session import stage

SLICE = 4096  # lines handled at a time


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind ``line``.

    A quote opens a field only at its beginning, elsewhere in an open field it is itself; a doubled one does not close.
    """
    at, size = 0, len(line)
    while True:
        if not inside:
            if at < size and line[at] == '"':
                inside, at = True, at + 1
            else:
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
        at = line.find('"', at)
        if at < 0:
            return True
        if line[at + 1 : at + 2] == '"':
            at += 2
            continue
        inside, at = False, line.find(",", at + 1) + 1
        if not at:
            return False


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(files)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _segments(batches):
    """(file, block, lines) slices in reading order; a split's slices follow one another."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            piece = batch.slice(at, SLICE)
            files, blocks = piece.column(0), piece.column(1)
            change = pc.or_(pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)), pc.not_equal(blocks.slice(1), blocks.slice(0, len(blocks) - 1)))
            starts = [0, *(i + 1 for i, c in enumerate(change.to_pylist()) if c), piece.num_rows]
            for start, end in zip(starts, starts[1:]):
                yield files[start].as_py(), blocks[start].as_py(), piece.column(2).slice(start, end - start)


def _quotes(lines) -> bool:
    return bool(pc.any(pc.match_substring(lines, '"')).as_py())


def _starts(lines: DataFrame) -> set[tuple[str, int]]:
    """The splits that begin inside quotes. The driver lists all splits for any scan; this is a part of that list."""
    def run(batches):
        open_, ends = None, None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([open_[0]]), pa.array([open_[1]], pa.int64()), pa.array([ends[0]]), pa.array([ends[1]])],
                                              names=["file", "block", "out", "in"])

        for file, block, part in _segments(batches):
            if (file, block) != open_:
                if open_:
                    yield told()
                open_, ends = (file, block), [False, True]
            if _quotes(part):
                for line in part.to_pylist():
                    if '"' in line:
                        ends = [ends_inside(line, e) for e in ends]
                    else:  # only a quote ends a quoted field
                        continue
        if open_:
            yield told()

    found = lines.mapInArrow(run, "file string, block long, out boolean, in boolean")
    blocks = found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "out", "in"))).alias("blocks"))
    begun = F.aggregate(
        "blocks", F.struct(F.lit(False).alias("inside"), F.array().cast("array<bigint>").alias("found")),
        lambda acc, b: F.struct(
            F.when(acc["inside"], b["in"]).otherwise(b["out"]).alias("inside"),
            F.when(acc["inside"], F.concat(acc["found"], F.array(b["block"]))).otherwise(acc["found"]).alias("found")))
    rows = blocks.select("file", F.explode(begun["found"]).alias("block")).collect()
    return {(r["file"], r["block"]) for r in rows}


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, record) of all files, headers and blank records left out; a record holds its line breaks.

    A carriage return before the break that ends a record is dropped, within a record it is kept. A field still open
    at the end of a file ends there.
    """
    lines = _lines(spark, files)
    inside_at = _starts(lines)

    def cut(batches):
        open_, inside, began, held, whole, number = None, False, False, [], [], 0

        def told(kinds, texts):
            n = len(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([open_[0]] * n), pa.array([open_[1]] * n, pa.int64()), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())],
                names=["file", "block", "kind", "record"])

        def left():
            """The lines of a record that the split does not finish: behind a whole one, or all of the split."""
            return told([MIDDLE if began else TAIL], ["\n".join(held)])

        for file, block, part in _segments(batches):
            if (file, block) != open_:
                if held:
                    yield left()
                open_, held = (file, block), []
                inside = began = open_ in inside_at
                number = 0
            texts, kinds = [], []
            plain = not inside and not _quotes(part)
            for line in part.to_pylist():
                first, number = block == 0 and number == 0, number + 1
                if not plain:
                    held.append(line)
                    if '"' in line:
                        inside = ends_inside(line, inside)
                    if inside:
                        continue
                    line, held = "\n".join(held), []
                    if began:
                        texts.append(line.removesuffix("\r"))
                        kinds.append(HEAD)
                        began = False
                        continue
                if not first and line.strip():
                    texts.append(line.removesuffix("\r"))
                    kinds.append(WHOLE)
            if texts:
                yield told(kinds, texts)
        if held:
            yield left()

    pieces = lines.mapInArrow(cut, "file string, block long, kind int, record string")
    found = pieces.where(F.col("kind") == WHOLE).select("file", "record")
    fragments = stage(pieces.where(F.col("kind") != WHOLE), "fragments")
    before = W.partitionBy("file").orderBy("block", "kind").rowsBetween(W.unboundedPreceding, 0)
    owned = fragments.withColumn("owner", F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(before))
    joined = owned.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"))
    merged = joined.select("file", F.array_join(F.col("parts.record"), "\n").alias("record"))
    return found.unionByName(merged)


# In one split a head comes before a tail.
HEAD, MIDDLE, TAIL, WHOLE = 0, 1, 2, 3
