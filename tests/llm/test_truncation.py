import math
import random

import pytest

from griddoc.llm import truncation as k

SENTENCES = ["The oil pump was returned to service before the annual survey of the site.", "For 7 bays the offer includes one relay cubicle each.", "Access to the main gallery is limited.", "When the load drops, the cabinet shall fall back to local mode."]


def corpus():
    rng = random.Random(8)
    docs, cut, either = [], set(), set()
    for n in range(600):
        text = " ".join(rng.choice(SENTENCES) for _ in range(rng.randint(2, 9)))
        tail = rng.choice(["", "", "\n- oil pump", "\nflow | 12 | ok", "\nPrepared by Mira Tal", "\nEnd of extract"])
        source = rng.choice(["limited", "free", None])
        text += tail
        if source == "limited" and len(text) > 300:
            short = text[:300]
            if k.ending(short)[0] == "open" and not short.split("\n")[-1].startswith(("Prepared", "End")):
                cut.add(n)
            elif len(text) > 300:  # cut within a list entry or closing line
                either.add(n)
            text = short
        elif n % 17 == 0:
            text = text[: -len(tail) or None][:-20].rstrip() + rng.choice(["", " ", "\n"])
            cut.add(n)
        docs.append((n, source, text))
    return docs, cut, either


def test_planted_cuts(spark):
    docs, cut, either = corpus()
    extra = [(9001, "free", None), (9002, "free", ""), (9003, "free", " \n"), (9004, "free", "Half of a cha�"), (9005, "free", "The oil pump was returned to service before the annual survey of the site ...")]
    df = spark.createDataFrame([(*x, 1, "s") for x in docs + extra], "doc_id long, source string, text string, chars int, state string")
    got = {r["doc_id"] for r in k.cut(df).collect()}
    assert 9004 in got and not got & {9001, 9002, 9003, 9005}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut - either - {9004}) <= 0.03 * len(cut)
    share = {r["source"]: r for r in k.cut_share(df).collect()}
    assert set(share) == {"limited", "free", None} and sum(r["n_docs"] for r in share.values()) == 605
    assert k.cut(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, state", [("Done.", "whole"), ("He said (so.)", "whole"), ("x.\n- item", "item"), ("a | b | c", "item"), ("The re", "open"), ("ends here!\n\n", "whole"), ("bad �", "broken"), ("x.\n-----", "item"), ("One. Two", "open")])
def test_endings(text, state):
    assert k.ending(text)[0] == state


def logs(sizes):
    x = [math.log(s) for s in sizes]
    return len(x), sum(x), sum(v * v for v in x)


def test_fit_recovers_a_censored_distribution():
    rng = random.Random(2)
    sizes = [math.exp(rng.gauss(6.5, 0.5)) for _ in range(4000)]
    limit = 800
    n, s1, s2 = logs(s for s in sizes if s < limit)
    at = sum(s >= limit for s in sizes)
    assert k.cut_shares(n, s1, s2, [(limit, at, 3.0)], 800)[0] > 0.98
    mean, sd = k.fit(n, s1, s2, [(math.log(limit), at)])
    assert abs(mean - 6.5) < 0.05 and abs(sd - 0.5) < 0.05
    assert k.cut_shares(1000, 6500.0, 42500.0, [(700, 3, 1.0)], 900)[0] < 0.6
    assert k.cut_shares(0, 0.0, 0.0, [(700, 3, 1.0)], 1) == [0.0] and k.cut_shares(10, 60.0, 370.0, [], 5) == []


@pytest.mark.parametrize("times", [1, 1_000, 1_000_000, 1_000_000_000])
def test_posterior_does_not_depend_on_the_size_of_the_corpus(times):
    rng = random.Random(4)
    sizes = [math.exp(rng.gauss(6.5, 0.5)) for _ in range(4000)]
    n, s1, s2 = logs(s for s in sizes if s < 800)
    assert k.cut_shares(n * times, s1 * times, s2 * times, [(800, 1500.0 * times, 3.0 * times)], 800)[0] > 0.98
    assert k.cut_shares(n * times, s1 * times, s2 * times, [(400, 6.0 * times, 5.0 * times)], 800)[0] < 0.2


def test_two_limits_of_one_source(spark):
    """A field that was 300 long and became 500 long, beside a source without any."""
    rng, rows = random.Random(3), []
    for n in range(1500):
        size = int(math.exp(rng.gauss(5.8, 0.5)))
        size = min(size, 300 if n % 3 == 0 else 500)
        rows += [("a", size, size, n), ("b", int(math.exp(rng.gauss(5.8, 0.5))), 7000 + n, n)]
    ends = spark.createDataFrame(rows, "source string, chars int, bytes int, hash long")
    got = {(r["source"], r["unit"], r["limit"]): r["posterior"] for r in k.limits(ends).collect()}
    assert got["a", "chars", 300] > 0.9 and got["a", "chars", 500] > 0.9
    assert all(p < 0.9 for (s, _, size), p in got.items() if s == "b" or size not in (300, 500))
