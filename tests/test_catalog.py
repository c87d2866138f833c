import random

import pytest
from pyspark.sql import functions as F

from griddoc.functions import text as X
from griddoc.operators import anchors, assets, catalog, match, regions, tables
from griddoc.operators.running import previous, running_sum
from griddoc.sources import sheets


def test_running_values_equal_a_window(spark):
    """One group holds most rows, one is null, values repeat."""
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), n, rng.randint(0, 5), "x") for n in range(400)]
    df = spark.createDataFrame(rows, "g string, o long, v long, _x string")
    got = {r["o"]: r for r in previous(running_sum(df, ["g"], ["o"], "v", "total"), ["g"], ["o"], "v", "before").collect()}
    total, last = {}, {}
    for g, o, v, _ in rows:
        total[g] = total.get(g, 0) + v
        assert (got[o]["total"], got[o]["before"]) == (total[g], last.get(g))
        last[g] = v
    assert len(got) == 400 and running_sum(df.limit(0), ["g"], ["o"], "v", "t").count() == 0


@pytest.mark.parametrize("limit", [1, 7, 30, 100, 10_000])
def test_packing_over_ranges_equals_one_pass(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice(["a"] * 9 + ["b", None]), n, n // 3, rng.choice([0, 1, 2, 5, 9, 40])) for n in range(600)]
    want, state = {}, {}
    for f, i, _, size in sorted(rows, key=lambda r: (r[2], r[1])):
        chunk, used = state.get(f, (0, 0))
        if not size:
            continue
        if used and used + size > limit:
            chunk, used = chunk + 1, 0
        state[f] = chunk, used + size + 1
        want[i] = chunk
    df = spark.createDataFrame(rows, "file_name string, seg_id long, seg_ord int, size int")
    assert {r["seg_id"]: r["chunk"] for r in regions.pack(df, limit).collect()} == want
    assert regions.pack(df.limit(0), limit).count() == 0


def test_anchors(spark):
    texts = ["Two relay cubicles stand here.", "No anchor.", "INFORMA is a name.", "information", "pumps", "pumpset", None, "", "pump is out of scope.", "[VLM OCR of embedded image] x", "out of scope " + "x" * 400 + " pump"]
    df = spark.createDataFrame(list(enumerate(texts)), "seg_id long, text string")
    terms = spark.createDataFrame([("pump", "keyword"), ("Informa", "synonym"), ("relay", "keyword"), ("relay cubicle", "keyword"), ("x", "keyword"), (" ", "keyword")], "term string, kind string")
    order = anchors.anchor_terms(terms)
    assert order == ["relay cubicle", "informa", "pump"]
    assert {r["seg_id"] for r in anchors.anchored(df, order).collect()} == {0, 2, 4, 9, 10}
    assert anchors.anchored(df, []).count() == 1


def test_selection_widens_short_segments(spark):
    rows = [("f", n, n, "pump" if n == 5 else "" if n == 6 else f"t{n}") for n in range(12)] + [("g", 20 + n, n, ("pump " if n == 1 else "") + "y" * 1200) for n in range(4)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "file_name string, seg_id long, seg_ord int, text string, at string")
    terms = spark.createDataFrame([("pump", "keyword")], "term string, kind string")
    got = {(r["file_name"], r["seg_id"]): r["chunk"] for r in anchors.select(df, terms, 7).collect()}
    assert set(got) == {("f", 3), ("f", 4), ("f", 5), ("f", 7), ("g", 21)}
    assert got["f", 3] == got["f", 4] == 0 and got["f", 5] == 1
    assert anchors.select(df.limit(0), terms).count() == 0


def test_membership_lookups(spark):
    fam = spark.createDataFrame([(1, "A", "S1; S2", None), (2, "B", "S2;S2", "R2"), (3, "A", None, "R3"), (4, "C", "tbd", "R4")], "row_ord long, family_id string, applicable_scenarios string, rule string")
    pairs = {(r["scenario_id"], r["row_ord"]) for r in catalog.of_member(fam, "row_ord", "applicable_scenarios", "scenario_id", ["family_id"]).collect()}
    assert pairs == {("S1", 1), ("S2", 1), ("S2", 2)}
    prod = spark.createDataFrame([(1, "P1", "B", "S9"), (2, "P2", "A", None), (3, "P2", "A", ""), (4, "P3", "Z", None)], "row_ord long, product_id string, family_id string, applicable_scenarios string")
    got = {(r["scenario_id"], r["product_id"], r["rank"]) for r in catalog.candidates(fam, prod).collect()}
    assert got == {("S1", "P2", 1), ("S2", "P2", 1), ("S2", "P1", 2)}
    own = {(r["row_ord"], r["scenario_id"]) for r in catalog.own_or_inherited(prod, "row_ord", "applicable_scenarios", fam.withColumnRenamed("row_ord", "f"), "family_id", "f", "scenario_id").collect()}
    assert own == {(1, "S9"), (2, "S1"), (2, "S2"), (3, "S1"), (3, "S2")}


def test_containment_and_templates(spark):
    items = spark.createDataFrame([(1, "Number of oil pumps"), (2, "Ambient temperature range"), (3, None), (4, "")], "row_ord long, parameter_name string")
    names = spark.createDataFrame([(7, "Ambient Temperature"), (8, "Pump count"), (9, "Rated level")], "name_ord long, name string")
    got = {(r["name_ord"], r["row_ord"]) for r in catalog.best_template(items, "row_ord", "parameter_name", names).collect()}
    assert got == {(7, 2), (8, 1)}
    assert catalog.contained(items, "row_ord", "parameter_name", names.limit(0).select(F.col("name_ord").alias("term_ord"), F.col("name").alias("term"))).count() == 0


def test_best_product_policy(spark):
    products = spark.createDataFrame([(1, "P1", "F", "candidate"), (2, "P2", "F", "Verified"), (3, "P3", "F", None), (4, "P4", "G", None)], "row_ord long, product_id string, family_id string, status string")
    params = spark.createDataFrame([("P1", "M1", 0.0, 10.0, None), ("P2", "M1", 20.0, 30.0, None), ("P3", "M1", 0.0, 10.0, None), ("P3", "M2", None, None, "5 to 9"), ("P1", "M1", 50.0, 60.0, None)], "product_id string, metric_id string, min_value double, max_value double, supported_value string")
    req = spark.createDataFrame([(1, "M1", "5", "Must-have"), (2, "M2", "7", "Reference")], "requirement_id long, metric_id string, value string, kind string")
    fits = catalog.fit(req, params, X.verdict(F.col("value"), F.col("min_value"), F.col("max_value"), F.col("supported_value")))
    assert {tuple(r) for r in fits.collect()} == {("P1", 1, "pass"), ("P2", 1, "fail"), ("P3", 1, "pass"), ("P3", 2, "pass")}
    best = {r["family_id"]: (r["product_id"], r["points"]) for r in catalog.best_products(products, fits, req, ["family_id"]).collect()}
    assert best == {"F": ("P1", 3.0), "G": ("P4", 0.0)}


def test_merge_scoped_and_documents(spark):
    a = spark.createDataFrame([("S1", 5), ("S2", 6)], "k string, confidence int")
    b = spark.createDataFrame([("S2", 9, False), ("S3", 7, None)], "k string, confidence int, in_scope boolean")
    kept, dropped = catalog.merge_scoped(a, b, "k")
    assert {tuple(r) for r in kept.collect()} == {("S1", 5, "rules"), ("S3", 7, "refined")} and [tuple(r) for r in dropped.collect()] == [("S2", 9, "both")]
    rows = spark.createDataFrame([("f",), ("g",)], "file_name string")
    kinds = spark.createDataFrame([("f", "spec"), ("g", None)], "file_name string, doc_type string")
    assert catalog.of_documents(rows, kinds, "spec").count() == 1 and catalog.of_documents(rows, kinds, "other").count() == 2


def test_rollup(spark):
    df = spark.createDataFrame([(1, None, 2, 4), (2, "a", 1, 0), (3, " ", 1, 2), (4, "b", 1, 3)], "o long, g string, x long, y long")
    got = {r["name"]: (r["n"], r["part"], r["whole"], round(r["ratio"], 3), r["first"]) for r in catalog.rollup(df, F.col("g"), "o", ("x", "y")).collect()}
    assert got == {"Unassigned": (2, 3, 6, 0.5, 1), "a": (1, 1, 0, 0.0, 2), "b": (1, 1, 3, 0.333, 4)}


def test_occurrences_equal_the_column_function(spark):
    texts = ["kV kv 10kV bay bays oil oil oiloil", None, "", "the tap changer tap changer"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    terms = ["kV", "bay", "oil", "tap changer", "oiloil", "none"]
    got = {r["term"]: r["n"] for r in match.occurrences(df, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = df.select(*(F.sum(X.count_term(F.lower("text"), F.lit(t))).alias(t) for t in terms)).first()
    assert got == {t: want[t] for t in terms}


@pytest.mark.parametrize("quote, at", [("Second  words here\nare more than forty characters of this text", 11), ("ond words", 14), ("here", 24), ("absent words of the quote that nobody wrote", None), ("d words here are mo", 16)])
@pytest.mark.parametrize("most", [100_000, 0])
def test_quotes_of_any_length(spark, monkeypatch, most, quote, at):
    monkeypatch.setattr(match, "VOCABULARY", most)
    s = spark.createDataFrame([("f", 1, 1, "nothing"), ("f", 2, 2, "first part second words here are more than forty characters of this text"), ("g", 3, 1, "second words here")], "file_name string, seg_id long, seg_ord int, text string")
    q = spark.createDataFrame([(1, "f", quote), (2, None, quote), (3, "f", "")], "quote_id long, file_name string, quote string")
    got = [tuple(r) for r in match.locate_quotes(q, s).select("quote_id", "seg_id", "at").collect()]
    assert got == ([(1, 2, at)] if at is not None else [])


def test_labels_take_the_first_segment_and_feeders_need_a_voltage(spark):
    rows = [("f", 1, 1, "TR1 future 33 kV 132kV 132 kV"), ("f", 2, 2, "TR1 TR-2 new F01 H02"), ("f", 3, 3, "existing F01, 11 kV"), ("f", 4, 4, None), (None, 5, 1, "BUS A")]
    got = {(r["file_name"], r["asset_type"], r["status"], r["kv"], r["area"], r["tags"]) for r in assets.labelled(spark.createDataFrame(rows, "file_name string, seg_id long, seg_ord int, text string")).collect()}
    assert got == {("f", "Power Transformer", "Future", 132, "132kV Area", "TR1"), ("f", "Power Transformer", "New", 132, "132kV Area", "TR-2"), ("f", "Feeder", "Existing", 11, "11kV Area", "F01"), (None, "Bus", "Unclear", None, "", "BUS A")}


def test_gas_within_a_gas(spark):
    rows = [("a", "methane"), ("b", "CO and h2"), ("c", "co, h2, ch4, c2h2"), ("d", None), ("e", "carbon monoxide")]
    got = {r["file_name"]: r["gases"] for r in assets.gases(spark.createDataFrame(rows, "file_name string, text string")).collect()}
    assert got == {"a": ["CH4", "C2H6"], "b": ["H2"], "c": ["H2", "CH4", "C2H2", "CO"], "d": [], "e": ["CO"]}


def test_package(spark):
    cells = lambda rows: spark.createDataFrame(list(enumerate(rows)), "row long, cells array<string>")
    every = {n: cells([["title"], [h for h, *_ in c], ["K", *["1"] * (len(c) - 1)], ["", "x"]]) for n, c in sheets.TABLES.items() if n not in sheets.OPTIONAL}
    got = sheets.package(every)
    assert {n: d.count() for n, d in got.items()} == {**{n: 1 for n in every}, "missing information": 0}
    blank = sheets.records(cells([["Project ID", "Missing Information Item", "Priority"], ["P", "bus count", ""], ["P", "", "High"]]), "missing information").collect()
    assert [(r["missing_item"], r["priority"], r["status"]) for r in blank] == [("bus count", "Medium", "Open")]
    with pytest.raises(ValueError):
        sheets.package({k: v for k, v in every.items() if k != "metric"})


def test_upper_lower_overlay(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    e = spark.createDataFrame([(1, "", False), (2, "x", None), (3, "y", True)], "k long, v string, deleted boolean")
    assert {tuple(r) for r in tables.overlay(a, e, "k", ["v"]).collect()} == {(1, "a"), (2, "x")}
