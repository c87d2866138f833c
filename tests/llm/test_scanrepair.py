import random
import textwrap

import pytest

from griddoc.llm import scanrepair as k

WORDS = "the purchaser shall submit an updated bill of quantities before shipment while self-supervised transformer monitor reports moisture content and current over shielded link".split()


def pages():
    rng = random.Random(3)
    body = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(k, f"plain{k % 5}.pdf", "page 1", "Supporting", body(400).capitalize() + ".") for k in range(60)]
    truth = set()
    for n in range(40):
        lines = textwrap.wrap(body(70), 60, break_on_hyphens=False)
        page = ["Survey of the main gallery", "", *lines, "", f"      - {n} -"]
        truth |= {(1000 + n, 1, ""), (1000 + n, len(page), "")}
        for at in range(2, len(page) - 3):
            w = page[at].split()
            spot = next((j for j, x in enumerate(w) if x == "transformer"), None)
            if spot is not None:
                w[spot] = "trarisformer" if n % 2 else "tran5former"
                truth.add((1000 + n, at + 1, "transformer"))
                page[at] = " ".join(w)
            last = page[at].split()[-1]
            if n % 3 == 0 and last in ("purchaser", "quantities", "self-supervised") and page[at + 1] and len(page[at + 1]) < 50:
                head, tail = ("self", "supervised") if last[:4] == "self" else (last[:4], last[4:])
                page[at] = page[at][: -len(last)] + head + ("-" if n % 2 else "\xad")
                page[at + 1] = tail + " " + page[at + 1]
                truth.add((1000 + n, at + 1, last))
        rows.append((1000 + n, f"scan{n % 4}.pdf", "page 2 (OCR)" if n % 2 else "page 2", None, "\n".join(page)))
    return rows, truth


SCHEMA = "seg_id long, file_name string, location string, doc_type string, text string, form string, line_no int"


def test_planted_damage(spark):
    rows, truth = pages()
    rows += [(2000, "scan9.pdf", "page 1 (ocr)", None, None), (2001, "scan9.pdf", "page 1 (ocr)", None, ""), (2002, None, None, None, "x")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)
    got = {tuple(r) for r in k.damaged(df).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    assert not {r for r in got if r[0] < 1000 or r[0] >= 2000}
    assert k.damaged(df.limit(0)).count() == 0


@pytest.mark.parametrize("line, yes", [("  - 3 -", True), ("[ 17 ]", True), ("Sheet 2", True), ("Page 4 of 12", True), ("3/9", True), ("5heet l2", True), ("Pagc l of 9", True), ("12 bays", False), ("of the site", False), ("is", False), ("", False)])
def test_page_numbers(line, yes):
    assert k.is_page_number(line) is yes


def test_keys_fold_misreadings():
    assert k.folded("Kestadt Netz") == k.folded("Kestadt Nefz") and k.folded("Survey 12") == k.folded("Siirvey 345") and k.folded("alpha") != k.folded("omega")


def test_word_parted_within_a_line():
    _, _, words = k.page_places("Head\n\nthe labora- tory has pre- and post tests in the long line here\nand more text follows on this line", set())
    assert ("laboratory", "labora-tory", True) in {w[1:] for w in words}


def test_bounds_that_concern_speed_only(spark, monkeypatch):
    """Few words held by the workers and no broadcast give the same rows; "a fee!" is no misread "feel"."""
    rows, _ = pages()
    rows += [(500 + n, "plain9.pdf", "page 1", None, "the fee is due and you feel fine " * 5) for n in range(30)]
    rows += [(3000 + n, "scan5.pdf", "page 1 (ocr)", None, "Head of it\n\nthe purchaser shall submit a fee! of quantities before\nshipment while you fee! fine and mon!tor reports content\nand more text follows here\n\n- 3 -") for n in range(3)]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)
    every = {tuple(r) for r in k.damaged(df).collect()}
    assert (3000, 4, "monitor") in every and not {r for r in every if r[2] in ("fee", "feel", "feei")}
    monkeypatch.setattr(k, "COMMON", 2)
    monkeypatch.setattr("griddoc.session.BROADCAST_ROWS", 0)
    assert {tuple(r) for r in k.damaged(df).collect()} == every
