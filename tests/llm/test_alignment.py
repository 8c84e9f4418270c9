"""Operator 11: alignments and corpus counts against a plain re-computation with the two public libraries."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridbill.llm import alignment as A
from gridbill.llm.chunks import byte_characters

TOK = Tokenizer.from_file(P.path(A.VOCABULARY_A))
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=P.path(A.VOCABULARY_B))
BACK = {c: b for b, c in enumerate(byte_characters())}
ODD = [None, "", " ", "  ", "a", "▁x", "one ▁ two", "<|endoftext|> <s> </s> <unk> <0x41>", "don't  stop\n\n\tnow ", "日本語 テキスト", "é\x00\x85 z", "\U0001f600\U0001f600", "x" * 3000,
       "the cat the cat the cat", "long text " * 20_000]


def aligned(text):
    """(ids of A, ids of B, groups, links) of one text, token by token."""
    if not text:
        return [], [], [], []
    a, b = TOK.encode(" " + text, add_special_tokens=False).ids, SP.encode(text)
    bytes_a = [bytes(BACK[c] for c in TOK.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
    bytes_b = [bytes([int(SP.id_to_piece(i)[3:5], 16)]) if SP.is_byte(i) else SP.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], []
    groups, links, i, j, at_a, at_b, ga, gb = [], [], 0, 0, 0, 0, [], []
    while i < len(a):
        links.append((a[i], b[j]))
        end_a, end_b = at_a + len(bytes_a[i]), at_b + len(bytes_b[j])
        if end_a <= end_b:
            ga.append(a[i])
        if end_b <= end_a:
            gb.append(b[j])
        if end_a == end_b:
            groups.append((ga, gb))
            ga, gb = [], []
        i, at_a, j, at_b = (i + 1, end_a, j, at_b) if end_a < end_b else (i, at_a, j + 1, end_b) if end_b < end_a else (i + 1, end_a, j + 1, end_b)
    return a, b, groups, links


def said(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def expected(rows):
    each = {t: aligned(t) for t in {t for _, t in rows}}
    counts = Counter(p for _, t in rows for p in each[t][3])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for i, t in rows:
        a, b, groups, links = each[t]
        digest = hashlib.sha256(said(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def results(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_batches_of_any_texts(texts):
    got = A.public_aligner()(texts)
    data, ends = got.groups.tobytes().decode(), [0, *got.group_ends.tolist()]
    stops = [0, *got.pair_ends.tolist()]
    for k, t in enumerate(texts):
        a, b, groups, links = aligned(t)
        assert (got.n_a[k], got.n_b[k], got.n_groups[k], got.n_links[k]) == (len(a), len(b), len(groups), len(links))
        assert data[ends[k] : ends[k + 1]][:-1] == said(groups)
        pairs = dict(zip(got.pairs[stops[k] : stops[k + 1]].tolist(), got.times[stops[k] : stops[k + 1]].tolist(), strict=True))
        assert pairs == Counter(x * SP.get_piece_size() + y for x, y in links)


@pytest.mark.parametrize("most", [1_000_000, 60, 3])
def test_odd_documents(documents, monkeypatch, most):
    monkeypatch.setattr(A, "BROADCAST_PAIRS", most)
    rows = [*enumerate(ODD), (3, "the cat"), (None, "the cat"), (3, "the cat"), *[(100 + i, "the cat sat") for i in range(40)]]
    got = results(A.measured(documents(rows).repartition(4), A.public_aligner, SP.get_piece_size()))
    assert got == expected(rows)


def test_no_documents(documents):
    assert A.measured(documents([]), A.public_aligner, SP.get_piece_size()).count() == 0
    assert results(A.measured(documents([(1, None), (2, "")]), A.public_aligner, SP.get_piece_size())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_are_given(documents):
    df = A.texts_aligned(documents([(1, "the cat"), (2, "the cat"), (3, "a dog")]), A.public_aligner, with_groups=True)
    got = {r.key: (r.copies, r.groups) for r in df.collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): (n, said(aligned(t)[2])) for t, n in (("the cat", 2), ("a dog", 1))}


def test_op11_on_the_test_data(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert results(A.op11_alignment(spark, tiny)) == expected(rows)
