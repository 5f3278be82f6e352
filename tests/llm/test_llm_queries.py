"""Queries with an SQL twin give its rows; the pipeline's stages are held against plain Python."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from ebbtide.llm.queries import ORACLES, QUERIES
from oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name]) is None


def test_thirteen_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


def shingles(text, words):
    found = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    if not found:
        return frozenset()
    width = min(words, len(found))
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def linked_groups(texts: dict, words: int, similar: int) -> dict:
    """Smallest reachable id by comparing all pairs."""
    sets = {i: shingles(t or "", words) for i, t in texts.items()}
    label = {i: i for i in texts}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
    for _ in texts:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            break
    return label


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality_classifier", "exact_dedup", "near_dedup", "best_fit_packing"]
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns, kept = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), columns)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.schema == columns and after.items() <= before.items()
        gone = set(before) - set(after)
        if name == "language_id":
            assert all(not re.search(r"[^\W\d_]", before[i]) for i in gone)
        elif name == "quality_classifier":
            held = [i for i in before if i in label and zlib.crc32(str(i).encode()) % 3 == 1]
            assert len(held) > 20 and all((i in after) == (label[i] == 1) for i in held)
        elif name == "exact_dedup":
            firsts = {}
            for i in sorted(before):
                firsts.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", before[i]), i)
            assert set(after) == set(firsts.values())
        else:
            groups = linked_groups(before, 5, 80)
            assert set(after) == {i for i, g in groups.items() if i == g}
        kept[name] = len(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == kept["near_dedup"]
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert ends <= 1024


def test_run_goes_through_all_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_take_odd_rows_and_empty_tables(spark, odd, nothing, tmp_path, some_labels):
    some_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, str(tmp_path))
            if name != "best_fit_packing":
                assert found.columns == docs.columns
            rows = found.collect()
            assert bool(rows) == (docs is odd)
