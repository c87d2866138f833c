import random

import pytest
from pyspark.sql import functions as F

from griddoc.functions import text as X
from griddoc.operators import boxes, match, regions, tables


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, term, at",
    [("the pmu and", "PMU", 4), ("the xpmu1", "PMU", -1), ("a phase angle", "phase angle", 2), ("xphase angles", "phase angle", 1), ("", "pmu", -1), ("abc", "", -1), ("h2 or h2s", " H2 ", 0), ("a.b c", "a.b", 0)],
)
def test_terms(spark, text, term, at):
    assert one(spark, X.find_term(F.col("t"), F.col("m")), t=text, m=term) == at
    rows = spark.createDataFrame([(1, text, "k")], "seg_id long, text string, at string")
    got = match.first_hits(rows, spark.createDataFrame([(0, term)], "term_ord long, term string"), "seg_id").collect()
    assert [r["at"] for r in got] == ([at] if at >= 0 else [])


def test_term_hits_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["oil", "h2", "oil flow", "flow", "relay", "a.b", "oil temperature rise"]
    texts = [" ".join(rng.choice(["oil", "flow", "h2", "xh2", "relays", "a.b", "temperature", "rise", "\n"]) for _ in range(12)) for _ in range(100)]
    seg = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "seg_id long, text string")
    terms = spark.createDataFrame([(k, t) for k, t in enumerate(words)], "term_ord long, term string")
    got = {(r["seg_id"], r["term_ord"], r["at"]) for r in match.first_hits(seg, terms, "seg_id").collect()}
    both = seg.crossJoin(terms).select("seg_id", "term_ord", X.find_term(F.lower("text"), F.col("term")).alias("at")).where("at >= 0")
    assert got == {tuple(r) for r in both.collect()}


def test_exclusion_reaches_ahead_but_not_too_far(spark):
    near, far = "relay " + "x" * 100 + " out of scope", "relay " + "x" * 260 + " out of scope"
    assert one(spark, X.excluded(F.col("t"), F.lit(0)), t=near) is True
    assert one(spark, X.excluded(F.col("t"), F.lit(0)), t=far) is False
    assert one(spark, X.excluded(F.col("t"), F.lit(-1)), t=near) is False


def test_ambiguous_terms_need_another(spark):
    seg = spark.createDataFrame([(1, "f", 1, "a relay here"), (2, "f", 2, "a relay and buchholz"), (3, "f", 3, None)], "seg_id long, file_name string, seg_ord int, text string")
    terms = spark.createDataFrame([(0, "relay", "S", "keyword", ""), (1, "buchholz", "S", "keyword", "")], "term_ord long, term string, scenario_id string, kind string, priority string")
    assert {(r["seg_id"], r["term"]) for r in match.evidence(seg, terms).collect()} == {(2, "relay"), (2, "buchholz")}


def test_best_evidence_keeps_four_and_the_first_of_ties(spark):
    rows = [("S", "d", k, k, 0, f"term{k}", 1, f"snippet {k}", conf) for k, conf in enumerate([0.6, 0.6, 0.85, 0.2, 0.6, 0.6])] + [("S", "d", 9, 9, 1, "again", 1, "snippet 2", 0.85)]
    df = spark.createDataFrame(rows, "scenario_id string, file_name string, seg_id long, seg_ord int, term_ord long, term string, line int, snippet string, confidence double")
    got = match.best_evidence(df).orderBy("evidence_id").collect()
    assert [r["seg_id"] for r in got] == [2, 0, 1, 4] and [r["evidence_id"] for r in got] == [f"EVD-000{k}" for k in range(1, 5)]
    conf = match.scenario_confidence(df.withColumn("confidence", F.col("confidence").cast("decimal(5,3)")), ["scenario_id"]).first()
    assert float(conf["confidence"]) == 0.95 and conf["evidence_count"] == 7


@pytest.mark.parametrize("text, lo, hi", [("up to 35 kV", None, 35), ("at least 3", 3, None), ("1 to 6 channels", 1, 6), ("5 A", None, 5), ("none", None, None), ("1,200", None, 1200), ("max of at least 3 or 9", None, 9), (None, None, None)])
def test_bounds(spark, text, lo, hi):
    got = one(spark, X.bounds(F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("t")), t=text)
    assert (got["lo"], got["hi"]) == (lo, hi)


@pytest.mark.parametrize("req, text, want", [("50", "up to 35", "fail"), ("30", "up to 35", "pass"), ("30", "", "unknown"), ("SCADA", "DNP3, Modbus", "unknown"), ("modbus tcp", "DNP3, Modbus", "pass"), ("", "x", "unknown")])
def test_verdict(spark, req, text, want):
    assert one(spark, X.verdict(F.col("r"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("t")), r=req, t=text) == want


def test_values_near(spark):
    got = one(spark, X.values_near(F.col("t"), F.lit(0)), t="rated 10-20 kV, 5 of 12 bays at 1,5 Hz")
    assert [(r["number"], r["unit"]) for r in got] == [("10-20", "kV"), ("12", "bays"), ("1,5", "Hz")]


def test_contents_page(spark):
    toc = "\n".join(f"{k}.1 Section {k} ...... {k}" for k in range(1, 7))
    assert one(spark, X.is_contents(F.col("t")), t=toc) is True
    assert one(spark, X.is_contents(F.col("t")), t="\n".join(toc.split("\n")[:5])) is False
    assert one(spark, X.is_contents(F.col("t")), t="Table of contents\n1 a 1\n2 b 2\n3 c 3\nx\ny") is True
    assert one(spark, X.is_contents(F.col("t")), t=None) is False


def test_running_boilerplate(spark):
    pages = [("a", k, f"page {k}", f"Tender  X\nbody {k}\n{'y' * 101}") for k in range(5)] + [("b", k, f"page {k}", "Tender X") for k in range(4)] + [("a", 9, "paragraph 1", "Tender X")]
    got = regions.running_boilerplate(spark.createDataFrame(pages, "file_name string, seg_id long, location string, text string")).collect()
    assert [(r["file_name"], r["line"], r["n"]) for r in got] == [("a", "tender x", 5)]


def test_islands_equal_brute_force(spark):
    rng = random.Random(2)
    anchors = {f"d{k}": sorted(rng.sample(range(40), rng.randint(1, 8))) for k in range(30)}
    want = set()
    for d, idx in anchors.items():
        covered = sorted({j for i in idx for j in range(max(0, i - 2), min(39, i + 2) + 1)})
        start = covered[0]
        for a, b in zip(covered, [*covered[1:], 99]):
            if b != a + 1:
                want.add((d, start, a))
                start = b
    a = spark.createDataFrame([(d, i) for d, idx in anchors.items() for i in idx], "file_name string, seg_ord int")
    s = spark.createDataFrame([(d, 40) for d in anchors], "file_name string, n int")
    assert {tuple(r) for r in regions.islands(a, s, 2).collect()} == want


def test_packing_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"d{k % 7}", k, k, rng.randint(0, 60)) for k in range(300)]
    got = {r["seg_id"]: r["chunk"] for r in regions.pack(spark.createDataFrame(rows, "file_name string, seg_id long, seg_ord int, size int"), 100).collect()}
    state = {}
    for d, i, _, size in rows:
        if not size:
            assert i not in got
            continue
        chunk, used = state.get(d, (0, 0))
        if used and used + size > 100:
            chunk, used = chunk + 1, 0
        state[d] = chunk, used + size + 1
        assert got[i] == chunk


def test_upsert_replace_insert(spark):
    old = spark.createDataFrame([(1, "A", "x"), (2, "B", "y"), (3, None, "z")], "ord int, model string, v string")
    new = spark.createDataFrame([(1, "a", "n1"), (2, "a ", "n2"), (3, "C", "n3"), (4, None, "n4")], "ord int, model string, v string")
    key = F.lower(F.trim("model"))
    got = {(r["model"], r["v"]) for r in tables.upsert(old, new, key, ["model"], "ord").collect()}
    assert got == {("A", "n2"), ("B", "y"), (None, "n4"), ("C", "n3")}
    assert {r["v"] for r in tables.insert_if_absent(old, new, key, "ord").collect()} == {"x", "y", "z", "n3"}
    p = spark.createDataFrame([("P", "m1", 1), ("P", "m2", 2), ("Q", "m1", 3)], "pid string, metric string, ord int")
    n = spark.createDataFrame([("P", "m9", 1), ("P", "m9", 2)], "pid string, metric string, ord int")
    assert {tuple(r) for r in tables.replace_by_key(p, n, "pid", ["pid", "metric"], ["ord"]).collect()} == {("Q", "m1", 3), ("P", "m9", 1)}


def test_firsts_lasts_and_overlays(spark):
    r = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, "j", "a"), (4, "k", "b"), (5, "k", "a")], "ord int, key string, v string")
    assert {(x["key"], x["v"]) for x in tables.first_seen_mode(r, ["key"], "v", "ord").collect()} == {("k", "a"), ("j", "a")}
    last = {x["key"]: (x["ord"], x["v"]) for x in tables.last_value_first_place(r, ["key"], "ord").collect()}
    assert last == {"k": (1, "a"), "j": (3, "a")}
    assert [x["v"] for x in tables.numbered_suffix(r, ["key"], "v", "ord").orderBy("ord").collect()] == ["a", "b", "a", "b_2", "a_2"]
    e = spark.createDataFrame([("j", "", True), ("k", "new", None)], "key string, v string, deleted boolean")
    assert {(x["ord"], x["v"]) for x in tables.overlay(r, e, "key", ["v"]).collect()} == {(1, "new"), (2, "new"), (4, "new"), (5, "new")}
    s = spark.createDataFrame([(1, 1, "S"), (1, 2, None), (1, 3, "T"), (2, 1, None)], "g int, ord int, head string")
    assert [x["section"] for x in tables.carried(s, ["g"], "head", "ord", "section").orderBy("g", "ord").collect()] == ["S", "S", "T", None]
    h = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "")], "ord int, h string")
    assert {x["ord"] for x in tables.distinct_by_hash(h, F.col("h"), ["ord"]).collect()} == {1, 3, 4, 5}


def test_suppression_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(k % 3, "ab"[k % 2], k, rng.random() * 30, rng.random() * 30, 5 + rng.random() * 20, 5 + rng.random() * 20, rng.choice([0.5, 0.7, 0.9])) for k in range(150)]

    def iou(a, b):
        w = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        h = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
        return w * h / (a[5] * a[6] + b[5] * b[6] - w * h)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[2])):
        if all(r[:2] != k[:2] or iou(r, k) <= 0.4 for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "image_id int, type string, box_id int, x double, y double, w double, h double, confidence double")
    assert {r["box_id"] for r in boxes.suppress(df).collect()} == {k[2] for k in kept}


def test_tiles_cover_the_image(spark):
    df = spark.createDataFrame([(1, 3000, 1000), (2, 1400, 1400), (3, 1401, 90)], "image_id int, width int, height int")
    got = {}
    for r in boxes.tiles(df).collect():
        got.setdefault(r["image_id"], []).append((r["x"], r["y"], r["w"], r["h"]))
    for i, w, h in [(1, 3000, 1000), (2, 1400, 1400), (3, 1401, 90)]:
        assert max(x + a for x, _, a, _ in got[i]) == w and max(y + b for _, y, _, b in got[i]) == h


def test_located_quote_prefers_longer_beginnings(spark):
    seg = spark.createDataFrame([(1, "f", 1, "The  oil\nflow is low."), (2, "f", 2, "The oil flow is low. And steady over time in the long run of things."), (3, "g", 1, "x")], "seg_id long, file_name string, seg_ord int, text string")
    q = spark.createDataFrame([(1, "f", "the oil flow is low. and steady"), (2, "f", "the oil flow"), (3, "g", "absent"), (4, "f", None)], "quote_id long, file_name string, quote string")
    assert {(r["quote_id"], r["seg_id"]) for r in match.locate_quotes(q, seg).collect()} == {(1, 2), (2, 1)}


def test_labels_and_scope(spark):
    t = "Future bay =C03 with SST-1, tr2 and 40CB7, 132 kV; -PD1.2"
    assert one(spark, X.scope_status(F.col("t")), t=t) == "Future"
    assert one(spark, X.labels(F.col("t"), "transformer"), t=t) == ["SST-1", "TR2"]
    assert one(spark, X.labels(F.col("t"), "breaker"), t=t) == ["40CB7"]
    assert one(spark, X.voltages(F.col("t")), t=t) == [132]
    assert one(spark, X.slug(F.col("t")), t="--ab c/1 ") == "AB_C_1" and one(spark, X.slug(F.col("t")), t=None) == "MODEL"
    assert one(spark, X.hash_suffix(F.col("t")), t="sheet_036e803f.pdf") == "036e803f"
    assert one(spark, X.json_part(F.col("t")), t='Sure:\n```json\n{"a": [1]}\n```') == '{"a": [1]}'
    assert one(spark, X.compact_quantity(F.col("t")), t=3.0) == "3" and one(spark, X.compact_quantity(F.col("t")), t=-1.0) == ""
