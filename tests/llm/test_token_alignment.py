import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from searchlab.llm import token_alignment as T
from searchlab.llm.tokens import default_tokenizer
from tests.llm.cases import edge_documents, no_documents, small_documents


def plain_groups(a, b):
    """a, b: (id, bytes) tokens of one text; groups and links, token by token."""
    def ends(tokens):
        at, out = 0, []
        for _, data in tokens:
            at += len(data)
            out.append(at)
        return out

    a_ends, b_ends = ends(a), ends(b)
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        mine = [x for x in range(i, len(a)) if a_ends[x] <= end]
        other = [x for x in range(j, len(b)) if b_ends[x] <= end]
        i, j = i + len(mine), j + len(other)
        groups.append((mine, other))
        links += [(x, y) for x in mine for y in other if a_ends[x] == end == b_ends[y]]
    return groups, links


def brute_force(rows):
    one, two = T.sides(default_tokenizer(), T.default_pieces())
    full, model = one.encoder.full, two.model
    alphabet, found = T.byte_characters(), []
    for doc, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(alphabet[c] for c in full.id_to_token(i))) for i in full.encode(" " + text, add_special_tokens=False).ids]
            for i in model.encode(text):
                piece = model.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
            if any(b"".join(x[1] for x in side) != (" " + text).encode() for side in (a, b)):
                a, b = [], []
        found.append((doc, a, b, *plain_groups(a, b)))
    counts = Counter((a[x][0], b[y][0]) for _, a, b, _, links in found for x, y in links)
    most = Counter()
    for (_, second), n in counts.items():
        most[second] = max(most[second], n)
    out = []
    for doc, a, b, groups, links in found:
        pairs = [(a[x][0], b[y][0]) for x, y in links]
        text = ";".join(",".join(str(a[x][0]) for x in g) + "|" + ",".join(str(b[y][0]) for y in h) for g, h in groups)
        out.append((
            doc, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in pairs),
            sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if a else "",
        ))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1), st.sets(st.integers(0, 400), min_size=1), st.integers(1, 9))
def test_galloping_finds_the_common_values(a, b, chunk):
    a, b = np.array(sorted(a)), np.array(sorted(b))
    kept, T.CHUNK = T.CHUNK, chunk
    try:
        i, j = T.common_places(a, b)
    finally:
        T.CHUNK = kept
    assert list(a[i]) == list(b[j]) == sorted(set(a) & set(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1), st.lists(st.integers(0, 3), min_size=1))
def test_alignment_with_tokens_without_bytes(a, b):
    a, b = a + [max(sum(b) - sum(a), 0) + 1], b + [max(sum(a) - sum(b), 0) + 1]
    groups, links = plain_groups([(0, b"x" * n) for n in a], [(0, b"x" * n) for n in b])
    cut_a, cut_b, link_a, link_b = T.align(np.array(a), np.array(b))
    assert [g[-1] for g, _ in groups] == list(cut_a) and [h[-1] for _, h in groups] == list(cut_b)
    assert links == list(zip(link_a, link_b))


def test_byte_characters_are_those_of_the_vocabulary():
    one, two = T.sides(default_tokenizer(), T.default_pieces())
    for text in ("naïve — 東京   \x00\x7f\x85", "a\r\n\tb  c "):
        assert one.covers(one.ids(text), (" " + text).encode())
        assert two.covers(two.ids(text), (" " + text).encode())


HARD = [
    "<|endoftext|> </s><s> <0x41> <unk>", "▁ lower block", "é ﬁ   　x", "\x00\x01", " ", "  lead", "x" * 5000,
    "\U0001f468‍\U0001f469 \U0001f600", "Ελλάδα йод tiếng", "don't we'll 12345 1,000.5", " ﻿",
]


def test_hard_texts_against_brute_force(spark):
    rows = [*enumerate(HARD), (90, None), (91, ""), (None, "twice"), (None, "twice"), (3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(T.aligned_tokens(df))
    assert got == brute_force(rows)
    assert [r for r in got if r[0] == 1] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("docs", [1, 50])
def test_documents_against_brute_force_in_blocks_of_any_size(spark, monkeypatch, docs):
    monkeypatch.setattr(T, "BLOCK_DOCS", docs)
    df = small_documents(spark)
    got = rows_of(T.aligned_tokens(df))
    assert got == brute_force([(r.doc_id, r.text) for r in df.collect()])
    assert len(got) == df.count()


def test_edge_documents(spark):
    df = edge_documents(spark)
    assert rows_of(T.aligned_tokens(df)) == brute_force([(r.doc_id, r.text) for r in df.collect()])
    assert rows_of(T.aligned_tokens(no_documents(spark))) == []
