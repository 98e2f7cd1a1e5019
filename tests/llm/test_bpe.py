"""Encoding against the reference library, round trips, odd texts."""

import importlib.util
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholium.llm import bpe

if not os.path.exists(bpe.vocabulary_path()):
    pytest.skip("no vocabulary here", allow_module_level=True)
ODD = ["", " ", "\n\n  x", "a²b Ⅴ x", "\x1c\x1dab  \x1f", "don't we'll I'M", "zero​width", "\U0001f469‍\U0001f52c \U00020000", "<|endoftext|> here", "é é ｆｕｌｌ", "　全角　空白", "a" * 5000, "日本語テキスト" * 500, "1234567 12.5%", "\r\n\t tabs"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path(name="byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def ours():
    return bpe.load(bpe.vocabulary_path())


def test_odd_texts(library, ours):
    for t in ODD:
        assert ours.encode(t) == library.encode(t, add_special_tokens=False).ids, repr(t[:40])
        assert ours.decode(ours.encode(t)) == t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, ours, t):
    assert ours.encode(t) == library.encode(t, add_special_tokens=False).ids
    assert ours.decode(ours.encode(t)) == t


def test_whole_small_corpus(spark, data, library):
    from scholium.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, data).collect()}
    want = {k: library.encode(t, add_special_tokens=False).ids if t else [] for k, t in texts.items()}
    assert got == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "a b", 7), (3, "a b", 7), (None, "x", 8)], "k long, t string, ids int")
    got = sorted(((r.k, r.ids) for r in bpe.encode_corpus(df, "k", "t").collect()), key=str)
    assert [x for x in got if x[0] in (1, 2)] == [(1, []), (2, [])] and len([x for x in got if x[0] == 3]) == 2
    assert bpe.encode_corpus(df.limit(0), "k", "t").count() == 0
    assert {r.n_tokens for r in bpe.count_tokens(df, "k", "t").collect()} == {0, 1, 2}


def test_memo_does_not_change_results(ours, monkeypatch):
    want = [ours.encode(t) for t in ODD]
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    assert [ours.encode(t) for t in ODD for _ in (0, 1)][::2] == want


def test_core_without_llm():
    assert importlib.util.find_spec("scholium.plans.registry")
