import random

import pytest

from griddoc.llm import leakage as k


def brute(items, docs):
    grams = {}
    for i, t in items:
        w = k.words(t)
        for a in range(len(w) - k.RUN + 1):
            grams.setdefault(tuple(w[a : a + k.RUN]), set()).add(i)
    out = set()
    for d, t in docs:
        w = k.words(t)
        for a in range(len(w) - k.RUN + 1):
            out |= {(i, d) for i in grams.get(tuple(w[a : a + k.RUN]), ())}
    return out


@pytest.mark.parametrize("held", [200_000, 0])
def test_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr("griddoc.session.BROADCAST_ROWS", held)
    rng = random.Random(6)
    vocab = [f"w{n}" for n in range(30)]
    items = [(n, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for n in range(20)] + [(98, None), (99, "")]
    docs = []
    for n in range(60):
        body = [rng.choice(vocab) for _ in range(60)]
        if n % 2:
            w = k.words(items[n % 20][1])
            size = rng.choice([11, 12, 13, 40])
            body[20:20] = w[:size]
        docs.append((1000 + n, "-- ".join(x.upper() if n % 3 else x for x in body) + "."))
    docs += [(1, None), (2, ""), (3, "w1 " * 5), (1000, docs[0][1])]
    i = spark.createDataFrame([(*x, "m") for x in items], "item_id long, text string, mark string")
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    got = [tuple(r) for r in k.leaks(i, d).collect()]
    assert set(got) == brute(items, docs) and len(got) == len(set(got)) and got
    assert k.leaks(i.limit(0), d).count() == 0 and k.leaks(i, d.limit(0)).count() == 0


def test_words_ignore_case_and_layout():
    assert k.words("Don't_stop\nÖL-2x (é)") == ["don", "t", "stop", "öl", "2x", "é"]


def test_long_text_is_read_to_its_end(spark):
    item = " ".join(f"q{n}" for n in range(14))
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(2, "filler words " * 100_000 + item)], "doc_id long, text string")
    assert [tuple(r) for r in k.leaks(i, d).collect()] == [(1, 2)]


def test_least_of_windows():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 1000, 50).astype(np.uint64)
    for size in (1, 2, 3, 5, 8, 50):
        assert k._least(x, size).tolist() == [min(x[i : i + size]) for i in range(len(x) - size + 1)]
