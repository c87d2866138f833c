import base64
import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from griddoc.llm import tokenize as k

PATH = os.path.join(k.TOKENIZERS, k.VOCABULARY)


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=k.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a" * 3000, "<|endoftext|>", "Größe ≥ 2×\n\n测试 记录 🎉🎉", "it's we'll\t\r\n x", "\x00\x7f\u0085", "don't  stop   \n ", "ab" * 500 + "12345678901234567890"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_public_library(known, text):
    assert k.loaded(PATH).encode(text) == known.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    e = k.loaded(PATH)
    ids = e.encode(text)
    assert "".join(k.stream_decode(ids, e.machine.bytes)) == text


def test_random_pieces(known):
    e, r = k.loaded(PATH), random.Random(1)
    toks = list(e.ranks)
    for _ in range(500):
        piece = b"".join(r.choice(toks) for _ in range(r.randint(1, 6)))
        assert e.machine.encode(piece) == known._core_bpe.encode_single_piece(piece)


def test_store_overflow_changes_nothing(known, monkeypatch):
    monkeypatch.setattr(k, "KEPT", 20)
    e = k.Encoder(PATH)
    for text in TEXTS:
        assert e.encode(text) == known.encode_ordinary(text)


@pytest.mark.parametrize("data", [b"\xe2\x82\xac", b"\xe2\x28", b"\xff", b"\xf0\x9f\x8e\x89", b"\xed\xa0\x80", b"\xc3", b"\xf4\x90\x80\x80", b"a\xe2\x82"])
def test_utf8_equals_python(data):
    u = k.Utf8()
    assert "".join(u.feed(bytes((b,))) for b in data) + u.close() == data.decode("utf-8", "replace")


def test_frames(spark):
    df = spark.createDataFrame([(1, "oil flow", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], list(r["ids"])) for r in k.encode(df).orderBy("doc_id").collect()]
    assert [g for g in got if g[0] != 1] == [(2, []), (3, []), (3, [])] and got[0][1]
    assert {(r["doc_id"], r["text"]) for r in k.decode(k.encode(df)).collect()} == {(1, "oil flow"), (2, ""), (3, "")}
    assert k.encode(df.limit(0)).count() == 0
