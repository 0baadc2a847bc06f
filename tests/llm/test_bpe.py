import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import bpe


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


ENC = bpe.encoder(bpe.DEFAULT_PATH)


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(reference, text):
    assert ENC.encode(text) == reference(text)


def test_cases(reference):
    for t in ["<|endoftext|>", "a" * 5_000, "ab" * 3_000, "  \n\n x", "क्षति ₹15276", "don't", "\x00﻿", "1234567" * 50]:
        assert ENC.encode(t) == reference(t)
    assert ENC.encode(None) == ENC.encode("") == []


def test_documents(spark, sf, reference):
    rows = [(1, "one", "x"), (2, None, "x"), (3, "", "x"), (None, "null id", "x"), (1, "one", "x")]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((a or 0, reference(b) if b else []) for a, b, _ in rows)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {r.doc_id: list(r.ids) for r in bpe.encode_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert ids == {k: reference(v) if v else [] for k, v in docs.items()}
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
