import pytest

from griddoc.llm import canonical as k

METRICS = [(1, "M1", "Top Oil Temperature", "TOT; upper oil temperature"), (2, "M2", "Enclosure Width", "case width"), (3, "M3", "Partial Discharge Apparent Charge", "PD charge"), (4, "M4", "Moisture In Oil", '"moisture, dissolved"'), (5, "M5", "Analog Input Channels", "AI (4/20 mA)"), (6, "M6", "Relay Output Contacts", None)]
NAMES = {
    " TOT ": "M1", "Top-Oil-Temperture value": "M1", "TEMP., TOP OIL": "M1", "upperoiltmp": "M1", "encl. width (max)": "M2", "part. disch. Apparent charrge": "M3", "dissolved moisture": "M4",
    "AI (4/20 mA)": "M5", "AnalogInputChannels": "M5", "Analog Output Channels": "", "Top Oil Sampling Valve": "", "Enclosure Height": "", "colour": "", "oil": "", "1)": "",
}


def frames(spark, names, mapped=()):
    met = spark.createDataFrame([(*m, "x") for m in METRICS], "row_ord long, metric_id string, standard_name string, synonyms string, name string")
    syn = spark.createDataFrame([(n, t, m, 1.0) for n, (t, m) in enumerate([*((x, None) for x in names), *mapped])], "row_ord long, raw_term string, metric_id string, score double")
    unm = spark.createDataFrame([(1, None, None), (2, "?", "TOT"), (3, "upper oil temp", ""), (4, "Door Hinge Side", "door hinge side"), (5, "Top Oil Temperture", "xqzv")], "row_ord long, proposed_metric_name string, parameter_name string")
    return syn, unm, met


def test_names(spark):
    out = {(r["tab"], r["row_ord"]): r["metric_id"] for r in k.match(*frames(spark, list(NAMES))).collect()}
    assert [out["synonym_mapping", n] for n in range(len(NAMES))] == list(NAMES.values())
    assert {n: m for (t, n), m in out.items() if t == "unmapped_parameter"} == {1: "", 2: "M1", 3: "M1", 4: "", 5: "M1"}


def test_hand_made_entries_are_learned_and_have_no_row(spark):
    mapped = [("water content", "M4"), ("Water Content", "M4")]
    syn, unm, met = frames(spark, ["water contnt", None, "-", " "], mapped)
    out = {r["row_ord"]: r["metric_id"] for r in k.match(syn, unm, met).where("tab = 'synonym_mapping'").collect()}
    assert out == {0: "M4"}


def test_empty_tables(spark):
    syn, unm, met = frames(spark, ["TOT"])
    assert k.match(syn.limit(0), unm.limit(0), met).count() == 0
    assert {r["metric_id"] for r in k.match(syn, unm.limit(0), met.limit(0)).collect()} == {""}


@pytest.mark.parametrize("a, b, d", [("abc", "acb", 1), ("oil", "oil", 0), ("temperature", "temprature", 1), ("abcd", "xyzw", 3)])
def test_distance(a, b, d):
    assert k.distance(a, b, 2) == d


@pytest.mark.parametrize("short, word, yes", [("temp", "temperature", True), ("tmp", "temperature", True), ("dslvd", "dissolved", True), ("bkr", "breaker", True), ("top", "tower", False), ("volt", "voltage", True), ("cat", "category", True), ("oil", "oil", False)])
def test_abbreviations(short, word, yes):
    assert k.shortens(short, word) is yes


@pytest.mark.parametrize("name", ["abcdxfghijkxmnopqrxtu", "abdcefghikjlmnoprqstu"])
def test_a_near_string_is_found_among_many_that_share_more_pieces(name):
    entries = [(f"D{n}", ["z" * (4 + n) + name]) for n in range(12)] + [("M", ["abcdefghijklmnopqrstu"])]
    assert k.Ranker(entries).rank([name])[0] == "M"


def test_every_hand_made_entry_counts_whatever_the_bound(spark, monkeypatch):
    monkeypatch.setattr(k, "LABELLED", 4)
    mapped = [(f"{w} figure", "M5") for w in ("amber", "birch", "cedar", "dahlia", "elder")] + [("wetness", "M5"), ("wetness", "M4"), ("wetness", "M4"), ("dampness share", "M4")]
    syn, unm, met = frames(spark, ["wetness", "dampnes share", "dampnessshaer", "share dampness", "nothing known"], mapped)
    out = {r["row_ord"]: r["metric_id"] for r in k.match(syn, unm.limit(0), met).collect()}
    assert out == {0: "M4", 1: "M4", 2: "M4", 3: "M4", 4: ""}
