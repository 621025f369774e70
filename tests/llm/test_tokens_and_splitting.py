"""Encoding against a public encoder and round trips; splitting against its promises."""

import base64

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import splitting as S
from tidewell.llm import tokens as K

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return K.encoder(K.tokenizer_file(), K.split_pattern())


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a", "<|endoftext|>", "the魔術師の女", "  \n\n\t x", "é́", "😀👍🏽", "aaaaaaaaaaaaaaaaaaa", "１２３", "한국어 문장", "it's we'll", "\u0000￿", "中国人民" * 300]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'の中ストaeé한")), max_size=60))
def test_random_texts(text):
    enc = K.encoder(K.tokenizer_file(), K.split_pattern())
    ids = enc.encode(text)
    assert enc.decode(ids) == text
    assert ids == REF.encode_ordinary(text)


def _reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


REF = _reference()


def test_odd_texts(encoder, public):
    for t in ODD:
        assert encoder.encode(t) == public.encode_ordinary(t), t
        assert encoder.decode(encoder.encode(t)) == t
    assert encoder.encode(None) == []


def test_column(spark, tiny, public):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None])], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in K.encode_column(docs, "doc_id", "text").collect()}
    assert got == {i: (public.encode_ordinary(t) if t else []) for i, t in enumerate([*ODD, None])}
    assert K.encode_column(docs.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="天地。，！ab .\n\ŕ|", max_size=400), st.integers(1, 60), st.integers(0, 59))
def test_pieces_keep_their_promises(text, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            S.split_item(text, limit, overlap)
        return
    cuts = S.split_item(text, limit, overlap)
    pieces = [text[a:b] for a, b in cuts]
    assert all(len(p) <= limit for p in pieces)
    assert all(b1 - a2 == overlap for (_, b1), (a2, _) in zip(cuts, cuts[1:], strict=False))
    assert "".join([*pieces[:1], *[p[overlap:] for p in pieces[1:]]]) == text


def test_natural_places_come_first():
    text = "第一句话说完了。第二句话比较长一些，还有后半句。第三句。"
    assert text[: S.split_item(text, 20)[0][1]] == "第一句话说完了。第二句话比较长一些，"[:8] or text[S.split_item(text, 20)[0][1] - 1] in "。，"
    assert S.split_item("x" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]


def test_other_tokens():
    text = "aa bb cc dd"
    starts = np.array([0, 2, 5, 8, 11])  # four tokens
    assert S.split_item(text, 2, 1, offsets=starts)[0][0] == 0
    cuts = S.split_item(text, 2, 0, offsets=starts)
    assert "".join(text[a:b] for a, b in cuts) == text


def test_oversized_rows(spark):
    rows = [(1, "ab " * 50, 20, 5), (2, "short", 20, 5), (3, None, 20, 5), (4, "x" * 30, None, 5), (5, "x" * 30, 10, 10), (6, "", 3, 0)]
    df = spark.createDataFrame(rows, "k long, t string, m int, o int")
    out = S.split_oversized(df, ["k"], "t", "m", "o").collect()
    assert {r["k"] for r in out} == {1}
    parts = sorted((r["piece_no"], r["piece"]) for r in out)
    assert parts[0][1] + "".join(p[5:] for _, p in parts[1:]) == "ab " * 50
    assert S.split_oversized(df.limit(0), ["k"], "t", "m", "o").count() == 0
