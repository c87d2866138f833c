import pytest

from griddoc.operators import units

PARAM = "param_id long, metric_id string, min_value double, max_value double, supported_value string, unit string, alias string"
HIT = "hit_id long, metric_id string, raw string, number string, unit string, value double"
METRICS = [("T", "degC"), ("G", "ppm"), ("V", "kV"), ("L", "mm"), ("S", "us"), ("M", "months"), ("D", "days"), ("F", "l/min"), ("H", "%RH"), ("N", "count"), ("P", "%"), ("Q", "pC"), ("A", "A")]


def run(spark, parameters=(), hits=()):
    p = spark.createDataFrame([(k, *x, "c") for k, x in enumerate(parameters)], PARAM)
    h = spark.createDataFrame([(k, *x, 1.0) for k, x in enumerate(hits)], HIT)
    m = spark.createDataFrame(METRICS, "metric_id string, unit string")
    out = units.standardise(p, h, m).collect()
    return {(r["tab"], r["row_id"], r["bound"]): r["std_milli"] for r in out}


def test_parameters(spark):
    rows = [
        ("T", None, None, "up to 235,76 degF", ""), ("T", None, None, "min. 333,85 K", None), ("V", 4.0, 12.0, None, "V x 1000"), ("G", None, None, "at least 0.0247 vol-%", ""),
        ("S", None, None, ">= 529 µs", ""), ("L", None, None, "up to 0.2788714 ft", None), ("T", None, None, "-40 to -36.2 deg C", None), ("T", None, None, "not more than 74 deg C", "-"),
        ("V", 0.02, None, "all limits in MV", ""), ("F", None, None, "from 2 m3/h to 3 m³/h", ""), ("H", None, None, "RH (0-1)", None), ("H", 0.4, None, "[RH (0-1)]", None),
        ("A", None, None, "max. 7,780 mA", ""), ("Q", None, None, "5 nC", ""), ("L", None, None, "values in in", ""), ("L", 2.0, None, "values in in", ""),
    ]
    got = {k[1:]: v for k, v in run(spark, rows).items()}
    assert got == {
        (0, "max"): 113200, (1, "min"): 60700, (2, "min"): 4000, (2, "max"): 12000, (3, "min"): 247000, (4, "min"): 529000, (5, "max"): 85000, (6, "min"): -40000, (6, "max"): -36200,
        (7, "max"): 74000, (8, "min"): 20000, (9, "min"): 33333, (9, "max"): 50000, (11, "min"): 40000, (12, "max"): 7780, (13, "min"): 5000000, (13, "max"): 5000000, (15, "min"): 50800,
    }


def test_no_cases(spark):
    rows = [("T", 1.0, None, None, "degC"), ("T", 1.0, None, None, " degC "), ("T", 1.0, None, None, "kg"), ("T", 1.0, None, None, None), ("N", 1.0, None, None, "pcs"), ("P", 1.0, None, None, "vol-%"),
            (None, 1.0, None, None, "K"), ("M", 1.0, None, None, "days"), ("T", None, None, "on request", "K"), ("T", None, None, None, "K"), ("?", 1.0, None, None, "K")]
    assert run(spark, rows) == {}
    assert run(spark) == {}


def test_hits(spark):
    rows = [("T", "339,35 kelvin", "339,35", " kelvin"), ("Q", "1042-3647pico-C", "1042-3647", None), ("L", "4.97 - 15.13 cm", "4.97 - 15.13", " cm"), ("M", "2 yrs", "2", ""), ("D", "1.14286weeks", "1.14286", "weeks"),
            ("A", "660,000 uA", "660,000", ""), ("T", "-9.2C", "-9.2", "C"), ("L", "1.9 - 3.7", "1.9 - 3.7", ""), ("T", None, None, "K"), ("T", "x K", "x", "K")]
    got = {k[1:]: v for k, v in run(spark, (), rows).items()}
    assert got == {(0, "val"): 66200, (1, "min"): 1042000, (1, "max"): 3647000, (2, "min"): 49700, (2, "max"): 151300, (3, "val"): 24000, (4, "val"): 8000, (5, "val"): 660, (6, "val"): -9200}


@pytest.mark.parametrize("text, value", [("1,284", 1284), ("0,645", 0.645), ("12,38", 12.38), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("9,999,999", 9999999), ("-4", -4), ("+3.5", 3.5), ("1'000", 1000), ("x", None)])
def test_numbers(text, value):
    assert units.number_of(text) == value


def test_aliases_have_one_meaning_in_a_kind():
    seen = {}
    for a, k, f, o in units.factors():
        assert seen.setdefault((a, k), (f, o)) == (f, o)
