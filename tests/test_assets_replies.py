import json

from griddoc.operators import assets, match, metrics, replies


def segs(spark, rows):
    return spark.createDataFrame([(f, k, k, t) for k, (f, t) in enumerate(rows)], "file_name string, seg_id long, seg_ord int, text string")


def test_labels_are_grouped(spark):
    s = segs(spark, [("d", "new 40CB7 and 40cb8, 132 kV"), ("d", "future 43CB4, 33kV 33 kV, 40CB7 again"), ("d", None), ("e", "SST-1")])
    got = {(r["file_name"], r["asset_type"], r["status"], r["kv"], r["quantity"], r["tags"]) for r in assets.labelled(s).collect()}
    assert got == {("d", "Circuit Breaker", "New", 132, 2, "40CB7; 40CB8"), ("d", "Circuit Breaker", "Future", 33, 1, "43CB4"), ("e", "Power Transformer", "Unclear", None, 1, "SST-1")}
    assert {tuple(r) for r in assets.counts(assets.labelled(s)).collect()} == {("d", "Circuit Breaker", 2), ("e", "Power Transformer", 1)}


def test_switchgear_and_stated_quantities(spark):
    s = segs(spark, [("g", "GIS =C00 =C03 =C04 -PD1.1"), ("g", "=C03 -PD1.1 -PD2.1"), ("h", "=C05"), ("t", "Summary of Sensor Quantity"), ("t", "GIS 220 kV 12 178"), ("t", "AIS 999"), ("u", "GIS 55")])
    assert {tuple(r) for r in assets.switchgear(s).collect()} >= {("g", 2, 2)} and "h" not in {r["file_name"] for r in assets.switchgear(s).collect()}
    assert {tuple(r)[::2] for r in assets.stated_quantities(s).collect()} == {("t", 220)}


def test_gases(spark):
    s = segs(spark, [("a", "CO and H2"), ("b", "h2, ch4"), ("b", "c2h2 co n2"), ("c", "carbon monoxide"), ("d", None)])
    assert {r["file_name"]: r["gases"] for r in assets.gases(s).collect()} == {"a": ["H2"], "b": ["H2", "CH4", "C2H2", "CO", "N2"], "c": ["CO"], "d": []}


def test_metric_values(spark):
    s = segs(spark, [("a", "system voltage is named"), ("a", "the system voltage, 12 bays, is 132 kV"), ("a", "UHF used"), ("b", "system voltage"), ("b", "")])
    t = spark.createDataFrame([(0, "system voltage", "V", "kV", "number"), (1, "UHF", "U", "text", "text"), (2, "absent", "X", "m", "number")], "term_ord long, term string, metric_id string, unit string, data_type string")
    got = {(r["file_name"], r["metric_id"]): (r["value"], r["unit"], r["seg_id"], r["has_value"]) for r in metrics.metric_values(s, t).collect()}
    assert got == {("a", "V"): ("132", "kV", 1, True), ("a", "U"): ("UHF", "", 2, True), ("b", "V"): ("", "", 3, False)}


def test_replies_are_held_against_the_catalogue(spark):
    reply = {"products": [{"product_id": "P1", "confidence": 7}, {"product_id": "??", "family_id": "F2", "confidence": "x"}, {"product_id": "P1", "in_scope": False}, {"family_id": "no"}], "requirements": [{"metric_id": "M1", "value": " 5 ", "confidence": 0.5, "requirement_type": "odd", "evidence_quote": "q" * 400}, {"metric_id": "M1", "value": "5", "confidence": 0.9}, {"metric_id": "zz"}]}
    p = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fails")], "chunk_id long, prompt string")
    text = "Here:\n```json\n" + json.dumps(reply) + "\n```"
    r = replies.ask(p, lambda q: text if q == "good" else "no json" if q == "bad" else 1 / 0)
    cat = spark.createDataFrame([("P1", "F1")], "product_id string, family_id string")
    fam = spark.createDataFrame([("F1",), ("F2",)], "family_id string")
    met = spark.createDataFrame([("M1",)], "metric_id string")
    items = {(x["product_id"], x["family_id"], x["confidence"]) for x in replies.validated(r, "products", cat, fam, met).collect()}
    assert items == {("P1", "F1", 1.0), ("", "F2", 0.6)}
    req = replies.best_items(replies.validated(r, "requirements", cat, fam, met), ["family_id", "product_id", "metric_id", "value"]).collect()
    assert [(x["metric_id"], x["value"], x["confidence"], x["requirement_type"]) for x in req] == [("M1", "5", 0.9, "Reference")]
    assert replies.validated(replies.ask(p), "products", cat, fam, met).count() == 0


def test_too_many_terms_are_refused(spark, monkeypatch):
    monkeypatch.setattr(match, "VOCABULARY", 1)
    t = spark.createDataFrame([(0, "a"), (1, "b")], "term_ord long, term string")
    try:
        match.first_hits(segs(spark, [("a", "x")]), t, "seg_id")
    except ValueError:
        return
    raise AssertionError


def test_text_read_off_pages_goes_to_its_place(spark):
    s = spark.createDataFrame([("f", 0, "cover", "c"), ("f", 1, "page 1", "one "), ("f", 2, "Page 3", "three"), ("f", 3, "page 5", replies.READ_OFF + "\nold"), ("g", 0, None, None)], "file_name string, seg_ord int, location string, text string")
    r = spark.createDataFrame([("f", 1, "A"), ("f", 2, "B"), ("f", 5, "C"), ("f", 9, "D"), ("f", 7, "E"), ("g", 1, "F")], "file_name string, page int, text string")
    got = [(x["file_name"], x["seg_ord"], x["location"], x["text"]) for x in replies.injected(s, r).orderBy("file_name", "seg_ord").collect()]
    m = replies.READ_OFF + "\n"
    assert got == [("f", 0, "cover", "c"), ("f", 1, "page 1", "one\n" + m + "A"), ("f", 2, "page 2", m + "B"), ("f", 3, "Page 3", "three"), ("f", 4, "page 5", m + "old"), ("f", 5, "page 7", m + "E"), ("f", 6, "page 9", m + "D"), ("g", 0, None, None), ("g", 1, "page 1", m + "F")]


def test_seen_assets_and_allowed_pairs(spark):
    reply = {"assets": [{"asset_tag": " Q1 ", "asset_type": "Circuit Breaker", "status": "FUTURE", "quantity": "x"}, {"asset_type": "Chair"}, {"asset_type": "Bus", "quantity": 3}]}
    got = [(x["asset_tag"], x["asset_type"], x["status"], x["quantity"]) for x in replies.seen_assets(spark.createDataFrame([(1, json.dumps(reply)), (2, "none")], "chunk_id long, reply string")).collect()]
    assert got == [("Q1", "Circuit Breaker", "Future", 1.0), ("", "Bus", "Unclear", 3.0)]
    items = spark.createDataFrame([("S1", "M1"), ("S1", "M2"), (None, "M1")], "scenario_id string, metric_id string")
    assert [tuple(r) for r in replies.allowed(items, items.where("metric_id = 'M1'")).collect()] == [("S1", "M1")]


def test_items_are_located_in_the_segments_of_their_chunk(spark):
    quote = "the breaker shall be monitored for gas pressure and temperature"
    reply = json.dumps({"requirements": [{"metric_id": "M1", "value": "5", "confidence": 0.9, "evidence_quote": quote.upper()}, {"metric_id": "M1", "value": "6", "evidence_quote": "nowhere in the text at all, really not"}]})
    chunks = spark.createDataFrame([(1, "f", 10, 1, "intro"), (1, "f", 11, 2, "So " + quote.replace(" ", "\n", 3) + ".")], "chunk_id long, file_name string, seg_id long, seg_ord int, text string")
    cat = (spark.createDataFrame([("P1", "F1")], "product_id string, family_id string"), spark.createDataFrame([("F1",)], "family_id string"), spark.createDataFrame([("M1",)], "metric_id string"))
    got = {(r["value"], r["seg_id"]) for r in replies.located(replies.ask(spark.createDataFrame([(1, "q")], "chunk_id long, prompt string"), lambda p: reply), "requirements", chunks, cat).collect()}
    assert got == {("5", 11), ("6", None)}
