import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from searchlab.llm import best_fit, packed_ids, token_trees
from searchlab.llm.tokens import Encoder, cuts, default_tokenizer, token_pieces
from tests.llm.cases import ROWS, edge_documents, no_documents, small_documents


@pytest.fixture(scope="module")
def encoder():
    return Encoder.of(default_tokenizer())


def whole(encoder, text):
    return encoder.full.encode(text or "", add_special_tokens=False).ids


def test_both_libraries_agree_on_every_fast_character(encoder):
    random.seed(3)
    letters = [chr(i) for i in range(0x250)]
    texts = letters + [f"a{x}b {x}{x} 1{x}'s" for x in letters]
    texts += ["".join(random.choices(letters + [" "] * 99, k=60)) for _ in range(3000)]
    texts += ["<|endoftext|>", "it's we'll  don't\n\n x \t y", "\x1c\x1d a", "   b", "日本 語", "😀 é"]
    assert all(encoder.ids(t) == whole(encoder, t) for t in texts)


def test_cuts_put_the_short_piece_first():
    assert cuts(1, 4) == [(0, 1)] and cuts(4, 4) == [(0, 4)]
    assert cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_pieces_edge_rows(spark, encoder):
    got = defaultdict(list)
    for r in token_pieces(edge_documents(spark), 64).collect():
        got[r.doc_id].append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and 0 < r.length <= 64
    assert [(r.length, r.start) for r in got[2]] == [(1, 0)]
    parts = sorted(got[7], key=lambda r: r.piece)
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist()
    assert ids == [*whole(encoder, dict(ROWS)[7]), 2]
    assert len(got[None]) == 2 and token_pieces(no_documents(spark)).count() == 0


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_best_fit_equals_sequential_best_fit_decreasing(spark):
    random.seed(5)
    lengths = [random.choice([1, 2, 5, 30, 64, 64, random.randint(1, 64)]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = best_fit.best_fit(items, ["doc_id"], 64).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert check_packing(rows, 64) == len(packed_ids.pack_lengths(np.array(lengths), 64))


def test_best_fit_edge_cases(spark):
    items = spark.createDataFrame([(None, 3), (None, 3), (1, 5), (1, 5), (2, 8)], "doc_id long, length long")
    rows = best_fit.best_fit(items, ["doc_id"], 8).collect()
    assert len(rows) == 5 and check_packing(rows, 8) == 3
    assert best_fit.best_fit(items.filter("length > 9"), ["doc_id"], 8).count() == 0
    with pytest.raises(ValueError):
        best_fit.best_fit(items, ["doc_id"], 7)


def test_capacity_tree_finds_the_successor():
    tree = packed_ids.CapacityTree(10)
    for capacity in (3, 7, 10):
        tree.add(capacity, 1)
    assert [tree.successor(n) for n in (1, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    tree.add(7, -1)
    assert tree.successor(4) == 10 and packed_ids.CapacityTree(4).successor(1) is None


def test_packed_matrix_round_trip(spark, encoder):
    docs = small_documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    back = defaultdict(dict)
    for r in packed_ids.packed_matrix(docs, 256, shard_bytes=100_000).collect():
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 256
        assert not ids[r.n_tokens :].any() and not positions[r.n_tokens :].any()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            back[doc][start] = ids[a:b].tolist()
    assert {d: [i for s in sorted(p) for i in p[s]] for d, p in back.items()} == {
        d: [*whole(encoder, t), 2] for d, t in texts.items()
    }


def test_packed_matrix_edge_rows(spark):
    rows = packed_ids.packed_matrix(edge_documents(spark), 64).collect()
    assert sum(d is None for r in rows for d in r.doc_ids) == 2
    assert packed_ids.packed_matrix(no_documents(spark)).count() == 0


def test_leaves_add_up_and_edits_equal_a_full_count(encoder):
    random.seed(9)
    parts = ["word", " ", "  ", "\n", "'s", "don't", "1", "23", ".", "é", " the", "x" * 40, "\t"]
    for _ in range(150):
        text = "".join(random.choices(parts, k=random.randint(0, 400)))
        leaves = token_trees.leaves_of(text)
        assert "".join(leaves) == text
        tree = token_trees.SumTree.of([len(encoder.ids(x)) for x in leaves])
        assert tree.total == len(encoder.ids(text))
        marks = sorted(random.sample(range(len(text) + 1), min(len(text) + 1, 2 * random.randint(0, 4)) // 2 * 2))
        edits = [(a, b, random.choice(["", " new", "\n", "n't", "  ", " 9"])) for a, b in zip(marks[::2], marks[1::2])]
        new = text
        for start, stop, by in reversed(edits):
            new = new[:start] + by + new[stop:]
        assert token_trees.recount(leaves, tree, edits, encoder)[0] == len(encoder.ids(new)), (text, edits)


def test_edits_follow_one_another(spark, encoder):
    random.seed(11)
    parts = ["word", " ", "  ", "\n", "'s", "1", "23", ".", "é", " the", "x" * 40]
    for _ in range(40):
        text = "".join(random.choices(parts, k=random.randint(0, 400)))
        leaves = token_trees.leaves_of(text)
        tree = token_trees.SumTree.of([len(encoder.ids(x)) for x in leaves])
        for _ in range(4):
            marks = sorted(random.choices(range(len(text) + 1), k=2))
            by = random.choice(["", " new", "\n", "n't", "  ", " 9", " more words" * 60])
            leaves, tree = token_trees.spliced(leaves, tree, [(*marks, by)], encoder)
            text = text[: marks[0]] + by + text[marks[1] :]
            assert "".join(leaves) == text and tree.total == len(encoder.ids(text))
    trees = token_trees.build_trees(edge_documents(spark))
    for _ in range(2):
        trees = token_trees.edit_trees(trees, token_trees.revision())
    rows = trees.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = "".join(r.leaves)
        assert r.n_chars == len(text) and r.n_tokens == len(whole(encoder, text))


def test_token_trees_edge_rows(spark, encoder):
    trees = token_trees.build_trees(edge_documents(spark))
    rows = token_trees.apply_edits(trees, token_trees.revision()).collect()
    assert len(rows) == len(ROWS)
    before = sorted((r.doc_id or -1, r.n_tokens_before) for r in rows)
    assert before == sorted((d or -1, len(whole(encoder, t))) for d, t in ROWS)
    assert token_trees.build_trees(no_documents(spark)).count() == 0


def test_counts_after_edits_have_the_new_length(spark):
    from pyspark.sql import functions as F

    from searchlab.llm import token_trees

    docs = spark.createDataFrame([(1, "hello world"), (2, "short")], "doc_id long, text string")
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("stop"), F.lit("").alias("replacement")))
    got = {r.doc_id: r.n_chars for r in token_trees.apply_edits(token_trees.build_trees(docs), edits).collect()}
    assert got == {1: 6, 2: 0}
