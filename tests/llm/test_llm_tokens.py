"""Token output, packing and sampled pieces: exact round trips."""

import base64
import functools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ebbtide.llm import packing, pieces, token_output, tokens
from ebbtide.llm.queries import QUERIES

BPE = public_tokenizers.path(tokens.VOCABULARY)
PIECES = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def reference_ids(sf):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    encoded = tokenizer.encode_batch(docs["text"].tolist(), add_special_tokens=False)
    return {i: [*e.ids, 2] for i, e in zip(docs["doc_id"], encoded)}


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_both_token_libraries_agree(text):
    slow = tokens._slow(BPE).encode(text, add_special_tokens=False).ids
    assert tokens.token_ids(text, BPE, None).tolist() == slow


MARK = "<|endoftext|>"
MARKED = [
    MARK, f"end of one.{MARK}start of two", f"{MARK}{MARK} {MARK}", f"a {MARK} b", f"a  {MARK}  b", f"a\n{MARK}\n\nb{MARK}",
    "<|endoftext|", "<|ENDOFTEXT|>", f"x<{MARK}>y", f"it'{MARK}s 12{MARK}34 é{MARK}日本", f" {MARK}\t", "<|im_start|>user",
]


@pytest.mark.parametrize("text", MARKED)
def test_special_tokens_within_texts(text):
    want = _contract().encode(text, add_special_tokens=False).ids
    assert tokens.token_ids(text, BPE, None).tolist() == want
    assert tokens._slow(BPE).encode(text, add_special_tokens=False).ids == want
    assert (50256 in want) == (MARK in text)


@given(st.lists(st.sampled_from([MARK, " ", "\n", "a", " the", "<|", "|>", "é", "'s", "1"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_special_tokens_among_others(text):
    assert tokens.token_ids(text, BPE, None).tolist() == _contract().encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=1)
def _contract():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_special_tokens_in_both_operators(spark):
    text = f"end of one.{MARK}start of two"
    want = [*_contract().encode(text, add_special_tokens=False).ids, 2]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (packed,) = packing.pack(docs, BPE).collect()
    assert packed["length"] == len(want) and packed["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    (row,) = token_output.read_sequences(token_output.materialise(docs, BPE)).collect()
    assert list(row["ids"]) == want and 50256 in want


def test_ids_beyond_two_bytes_are_kept(spark, tmp_path):
    """A vocabulary whose byte b has the id 70,000 + b: records take four bytes an id."""
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % (70_000 + b) for b in range(256)))
    docs = spark.createDataFrame([(1, "hi"), (2, "longer text"), (3, None)], "doc_id long, text string")
    written = token_output.materialise(docs, str(path), size=4, per_shard=2)
    assert {(r["id_bytes"], r["stride"]) for r in written.collect()} == {(4, 16)}
    found = defaultdict(list)
    for r in sorted(token_output.read_sequences(written, per_shard=2).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        found[r["doc_id"]] += r["ids"]
    assert found == {i: [*(70_000 + b for b in text), 2] for i, text in ((1, b"hi"), (2, b"longer text"), (3, b""))}
    assert tokens.id_bytes(BPE) == 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutation(n):
    order = token_output.Permutation(n, key=9)
    slots = order.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (order.index(slots) == np.arange(n)).all()
    if n == 1000:
        assert (slots != token_output.Permutation(n, key=10).slot(np.arange(n))).mean() > 0.9


def test_shards_hold_every_sequence_once(spark, sf, reference_ids, tmp_path):
    shards = QUERIES["op1_training_order"](spark, sf)
    shards.write.parquet(str(tmp_path / "shards"))
    written = spark.read.parquet(str(tmp_path / "shards"))
    meta = written.select("shard", "first_slot", "n_sequences", "stride", "payload").collect()
    assert all(len(r["payload"]) == r["n_sequences"] * r["stride"] and r["first_slot"] == 512 * r["shard"] for r in meta)
    rows = token_output.read_sequences(written).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    texts = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        texts[r["doc_id"]] += r["ids"]
    assert texts == reference_ids
    later = token_output.read_sequences(written, 700).collect()
    assert sorted(r["slot"] for r in later) == list(range(700, len(rows)))


def test_packing(spark, sf, reference_ids):
    rows = QUERIES["op6_pattern_packing"](spark, sf).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(reference_ids)
    for i, found in by_doc.items():
        found.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(len(found)))
        assert [r["start"] for r in found] == [sum(x["length"] for x in found[:k]) for k in range(len(found))]
        assert sum(r["length"] for r in found) == len(reference_ids[i])
        assert all(r["length"] == 1024 for r in found[1:])
        for r in found:
            ids = np.array(reference_ids[i][r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
    for found in by_sequence.values():
        found.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in found] == [sum(x["length"] for x in found[:k]) for k in range(len(found))]
        assert sum(r["length"] for r in found) <= 1024
    assert len(by_sequence) <= 1.01 * math.ceil(sum(r["length"] for r in rows) / 1024) + 1


@given(st.dictionaries(st.integers(1, 32), st.integers(0, 40), max_size=12))
@settings(max_examples=60, deadline=None)
def test_plans_place_every_piece_once(counts):
    histogram = np.zeros(33, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    plan = packing.make_plan(histogram, 32)
    lengths = np.repeat(np.arange(33), histogram)
    ranks = np.concatenate([np.arange(n) for n in histogram]) if len(lengths) else lengths
    sequence, offset = plan.place(lengths, ranks) if len(lengths) else (lengths, lengths)
    used = defaultdict(list)
    for s, o, n in zip(sequence, offset, lengths):
        used[s].append((o, n))
    for found in used.values():
        found.sort()
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:]))
        assert sum(n for _, n in found) <= 32
    assert len(used) == plan.sequences


def test_patterns_fit_histogram():
    patterns = packing.exact_patterns(12)
    assert len({tuple(p) for p in patterns.tolist()}) == len(patterns) and (patterns.sum(1) == 12).all()
    truth = np.zeros(len(patterns))
    truth[[1, 7]] = [30, 50]
    histogram = np.bincount(patterns.ravel(), np.repeat(truth, 3), 13)
    fitted = packing.fit_counts(patterns, histogram, 3000)
    covered = np.bincount(patterns.ravel(), np.repeat(fitted, 3), 13)
    assert (fitted >= 0).all() and np.abs(covered[1:] - histogram[1:]).max() < 0.5


def test_token_operators_odd_rows(odd, nothing):
    rows = packing.pack(odd, BPE).collect()
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(
        [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, None, None, 10, 11, 12, 13])
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack(nothing, BPE).count() == 0
    assert sum(r["n_sequences"] for r in token_output.materialise(odd, BPE).collect()) == len(rows)
    assert token_output.materialise(nothing, BPE).count() == 0
    encoded = pieces.encode(odd, PIECES).collect()
    assert len(encoded) == 16 and all(r["lossless"] for r in encoded)
    assert {r["n_pieces"] for r in encoded if r["doc_id"] in (1, 2)} == {0}
    same = {tuple(r["ids"]) for r in encoded if r["doc_id"] == 5}
    assert len(same) == 1
    assert pieces.encode(nothing, PIECES).count() == 0


def test_long_white_space():
    for text in (" " * 300_000 + "x", "a" * 50_000, "\n" * 50_000):
        assert tokens.encoding(BPE).decode(tokens.token_ids(text, BPE, None).tolist()) == text


@given(st.text(max_size=40))
@settings(max_examples=100, deadline=None)
def test_sampled_pieces_are_lossless(text):
    (ids,) = pieces.encode_texts([text], [5], PIECES)
    assert pieces.decode_ids(ids.tolist(), PIECES) == text
    if "▁" not in text and "\x00" not in text:
        library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        assert library.decode(ids.tolist()) == text


def segmentations(text, words, sharpness):
    """All paths through the lattice with their weights."""
    if not text:
        return {(): 0.0}
    found = {}
    for n in range(1, len(text) + 1):
        if (piece := words.get(text[:n])) is not None:
            for rest, weight in segmentations(text[n:], words, sharpness).items():
                found[(piece[0], *rest)] = weight + sharpness * piece[1]
    return found


def test_samples_follow_the_lattice():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = {model.id_to_piece(i).replace("▁", " "): (i, model.get_score(i)) for i in range(259, model.get_piece_size())}
    paths = segmentations(" the", words, pieces.SHARPNESS)
    total = sum(math.exp(w) for w in paths.values())
    n = 6000
    drawn = Counter(tuple(x.tolist()) for x in pieces.encode_texts(["the"] * n, list(range(n)), PIECES))
    assert set(drawn) <= set(paths) and len(paths) > 4
    for path, weight in paths.items():
        p = math.exp(weight) / total
        assert abs(drawn[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_chunks_never_part_a_piece():
    words, split = pieces.vocabulary(PIECES), pieces.chunker(PIECES)
    text = " the cat's  (x_1) é²3 -> 12.5%\n\n  foo…bar $; *= ▁▁ ١٢ नमस्ते"
    chunks = split(text)
    assert "".join(chunks) == text
    assert not any(a[-1] + b[0] in words.spanned for a, b in zip(chunks, chunks[1:]))


def test_samples_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    rows = [{r["doc_id"]: tuple(r["ids"]) for r in pieces.encode(docs.repartition(n), PIECES).collect()} for n in (1, 7)]
    assert rows[0] == rows[1]
    other = {r["doc_id"]: tuple(r["ids"]) for r in pieces.encode(docs, PIECES, seed=1).collect()}
    assert other != rows[0]
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES).join(docs.withColumnRenamed("text", "original"), "doc_id")
    assert back.where("text = original").count() == docs.count()


def test_registered_query_gives_the_ids(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op10_sampled_pieces"](spark, folder)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    back = pieces.decode(rows, PIECES).collect()
    assert {r["doc_id"]: r["text"] for r in back} == texts
    for r in back:
        assert r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
