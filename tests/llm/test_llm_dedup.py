"""Exact and near duplicates."""

import hashlib
import random

import numpy as np
import pytest

from ebbtide.llm import exact_dedup, near_dedup
from test_llm_queries import linked_groups


def test_exact_copies_across_partitions(spark, odd):
    many = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a  b' when id % 3 = 1 then 'a\nb' else string(id) end as text")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps all partitions, so the group lies in many
    try:
        rows = exact_dedup.content_sort(many).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(rows) == 4000
    for r in rows:
        copies = r["doc_id"] % 3 < 2
        assert r["keep_id"] == (0 if copies else r["doc_id"]) and r["group_size"] == (2667 if copies else 1)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
        text = "a b" if copies else str(r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_exact_odd_rows(odd, nothing):
    rows = exact_dedup.content_sort(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    assert len(rows) == 16 and all(sum(r["kept"] for r in g) == 1 for g in by.values())
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert sorted(str(r["doc_id"]) for r in empty) == ["1", "2", "None"] and {r["keep_id"] for r in empty} == {1}
    assert sorted(r["group_size"] for r in rows if r["doc_id"] == 5) == [5, 5]
    kept = exact_dedup.drop_exact(odd)
    assert kept.columns == odd.columns and kept.count() == len(by)
    assert exact_dedup.content_sort(nothing).count() == 0


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 120]))]
        for copy in range(10):
            out = list(words)
            for _ in range(rng.randrange(0, 6)):
                out[rng.randrange(len(out))] = rng.choice(vocabulary)
            texts[base * 10 + copy] = " ".join(out)
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    for i in range(200, 240):  # a passage in common, otherwise different
        texts[i] = shared + " " + " ".join(rng.choice(vocabulary) for _ in range(30))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for words, similar in ((3, 85), (5, 80), (3, 50)):
        expected = linked_groups(texts, words, similar)
        found = {r["doc_id"]: r for r in near_dedup.near_classes(docs, words, similar).collect()}
        assert {i: r["component_id"] for i, r in found.items()} == expected
        assert all(r["kept"] == (i == expected[i]) for i, r in found.items())


def test_edges_beyond_the_broadcast_bound(spark, monkeypatch):
    many = spark.range(3000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'a b' else string(id) end as text")

    def found():
        return sorted(map(tuple, exact_dedup.content_sort(many).collect()))

    plain = found()
    monkeypatch.setattr(exact_dedup, "BROADCAST_EDGES", 0)
    assert found() == plain and sum(r[3] for r in plain) == 1501


def template_texts(texts, own, width=200):
    """Texts of one template, each with ``own`` words of its own at the end."""
    common = [f"t{i}" for i in range(width - own)]
    return {i: " ".join(common + [f"own{i}x{j}" for j in range(own)]) for i in range(texts)}


def test_template_texts_below_the_threshold_reach_nobody(spark):
    texts = template_texts(60, 22)  # pairwise about 0.80
    texts |= {100 + i: t + f" end{i}" for i, t in template_texts(20, 22).items()}  # each a near copy of an earlier one
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_classes(docs, 3, 85).collect()}
    assert found == linked_groups(texts, 3, 85) == {i: i % 100 for i in texts}
    rows = [(i, i % 100, near_dedup.shingle_set(t, 3).view(np.int64).tolist()) for i, t in texts.items()]
    sets = spark.createDataFrame(rows, "id long, component long, shingles array<long>")
    assert near_dedup._reachable(sets.select("id", "component"), sets.drop("component"), 85).isEmpty()


def test_tables_by_id_have_a_row_per_text(spark, monkeypatch):
    """Joins by id are as large as their tables, which held a row per text and bucket."""
    rng = random.Random(3)
    common = [f"t{i}" for i in range(90)]
    texts = {i: " ".join([*common[: 40 + i], *(f"own{i}x{j}" for j in range(3)), *common[40 + i :]]) for i in range(30)}
    texts |= {100 + i: " ".join(rng.sample(common, 80)) for i in range(3)}
    docs = spark.createDataFrame([*texts.items(), (7, texts[7])], "doc_id long, text string").repartition(3)
    staged = {}
    monkeypatch.setattr(near_dedup, "stage", lambda df, name, plain=near_dedup.stage: staged.setdefault(name, plain(df, name)) if name in ("placed", "open") else plain(df, name))
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_classes(docs, 3, 85).collect()}
    assert found == linked_groups(texts, 3, 85)
    placed = [r["id"] for r in staged["placed"].collect()]
    assert len(placed) > 5 and len(placed) == len(set(placed))
    opened = [r["id"] for r in staged["open"].collect()]
    assert len(opened) == len(set(opened))


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(11)
    sets = {i: {rng.randrange(30) for _ in range(rng.randrange(4, 26))} for i in range(150)}
    sets |= {200 + i: sets[i] | {100 + j for j in range(i % 4)} for i in range(60)}  # near and equal copies
    rows = [(i, i, sorted(s)) for i, s in sets.items()]
    table = spark.createDataFrame(rows + rows[:40], "id long, component long, shingles array<long>")  # repeated rows too
    chosen = table.select("id", "component").distinct()
    for similar in (50, 80, 85, 100):
        found = {r["id"]: r for r in near_dedup._reachable(chosen, table.drop("component"), similar).collect()}
        pairs = [(a, b) for a in sets for b in sets if a != b and len(sets[a]) >= len(sets[b])
                 and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
        assert pairs and all(a in found and b in found and found[a]["larger"] and found[b]["smaller"] for a, b in pairs)


def test_near_odd_rows(odd, nothing):
    rows = near_dedup.near_classes(odd).collect()
    assert len(rows) == 16
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            expected = {5: 4, 6: 4, 12: 4, 8: 7}.get(r["doc_id"], r["doc_id"])
            assert r["component_id"] == expected and r["kept"] == (expected == r["doc_id"])
    assert {r["doc_id"]: r["n_shingles"] for r in rows if r["doc_id"] in (1, 2, 3, 7, 13)} == {1: 0, 2: 0, 3: 0, 7: 1, 13: 1}
    assert near_dedup.drop_near(odd).columns == odd.columns
    assert near_dedup.near_classes(nothing).count() == 0 == near_dedup.drop_near(nothing).count()


def test_rows_of_one_id_with_different_texts(spark):
    plain, other = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    docs = spark.createDataFrame([(1, plain), (5, plain), (5, other), (6, plain)], "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_classes(docs).collect()}
    assert found == {(1, 1, True), (5, 1, False), (5, 5, True), (6, 1, False)}
    assert sorted(r["doc_id"] for r in near_dedup.drop_near(docs).collect()) == [1, 5, 5]


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_signature_values_agree_as_often_as_sets_overlap(share):
    rng = np.random.default_rng(3)
    scheme = near_dedup.banding(85, rows=2, miss=1e-200)
    n = 600
    common = int(2 * n * share / (1 + share))
    a = rng.integers(0, 2**64, n, np.uint64)
    b = np.concatenate([a[:common], rng.integers(0, 2**64, n - common, np.uint64)])
    x, y = (near_dedup.min_max(s, scheme.multiply, scheme.add) for s in (a, b))
    assert len(x) == 2 * len(scheme.add) and abs((x == y).mean() - share) < 0.06


def test_bands_follow_from_the_allowed_miss():
    for similar in (80, 85, 95):
        scheme = near_dedup.banding(similar)
        assert (1 - (similar / 100) ** scheme.rows) ** scheme.bands <= near_dedup.MISS
        assert 2 * len(scheme.add) == scheme.rows * scheme.bands
