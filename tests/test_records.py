"""Line breaks inside quotes, in files that many tasks read."""

import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.sources import csv
from ebbtide.sources.records import ends_inside


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name, value in zip(names, ("96", "1")):
        spark.conf.set(name, value)
    yield spark
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("line, inside, after", [
    ("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True), ('a,"b"",c', False, True),
    ('5" disk,b', False, False), ('a, "b', False, False), ('b",c', True, False), ('b"",c', True, True), ("b", True, True),
    ('b","c', True, True), ("", True, True), ("", False, False), ('"', False, True), ('"', True, False), ('""', False, False), ('","",', False, True),
])
def test_state_behind_a_line(line, inside, after):
    assert ends_inside(line, inside) is after


def cells(seed, rows=60):
    pick = random.Random(seed)
    texts = ["plain", "two\nlines", "a,b", 'say ""hi""', "x" * 150, "\n\n", "1\n2\n3\n4" * 12, 'end""\n', "", "é🎉", "5' 6"]
    return [(i, pick.choice(texts), pick.choice(texts)) for i in range(rows)]


def written(path, rows, end="\n"):
    lines = ["id,first,second", *(f'{i},"{a}","{b}"' for i, a, b in rows)]
    path.write_bytes((end.join(lines) + end).encode())
    return pd.read_csv(io.BytesIO(path.read_bytes()), keep_default_na=False)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_a_reader_of_one_task(small_splits, tmp_path, seed):
    spark = small_splits
    wanted = [written(tmp_path / f"{k}.csv", cells(10 * seed + k), end) for k, end in enumerate(("\n", "\r\n"))]
    wanted = pd.concat([w.assign(file=k) for k, w in enumerate(wanted)])
    text = csv._text_rows(spark, str(tmp_path), True, "DROPMALFORMED")
    assert text.rdd.getNumPartitions() > 20 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = sorted(map(tuple, text.select(F.col("id").cast("int"), F.coalesce("first", F.lit("")), F.coalesce("second", F.lit(""))).collect()))
    assert got == sorted(zip(wanted["id"], wanted["first"], wanted["second"]))
    rows, checks = csv.ingest_csv(spark, str(tmp_path), multi_line=True)
    assert rows.schema["id"].dataType.simpleString() == "bigint" and rows.count() == len(wanted)
    assert {r["check"]: r["passed"] for r in checks.collect()}["well_formed"]


def test_bad_records_and_open_ends(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n\n2\n3,"z",4\n5," ""q"""\n6,"never\nclosed\n')
    bad = sorted(r["line"] for r in csv.bad_lines(small_splits, str(tmp_path), True).collect())
    assert bad[:2] == ["2", '3,"z",4']
    rows, _ = csv.ingest_csv(small_splits, str(tmp_path), multi_line=True)
    assert [tuple(r) for r in rows.where("a < 6").orderBy("a").collect()] == [(1, "x\ny"), (5, ' "q"')]
    with pytest.raises(ValueError, match="malformed"):
        csv.read_csv(small_splits, str(tmp_path), multi_line=True)
