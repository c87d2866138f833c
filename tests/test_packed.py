import random

from griddoc.operators.packed import NOTHING, unpack


def values(spark, cells, ids=False):
    df = spark.createDataFrame([(k, c, "x") for k, c in enumerate(cells)], "row_ord long, cell string, val string")
    out = {}
    for r in sorted(unpack(df, "row_ord", "cell", ids).collect()):
        out.setdefault(r["row_ord"], []).append(r["val"])
        assert r["pos"] == len(out[r["row_ord"]])
    return [out.get(k, []) for k in range(len(cells))]


def test_delimiters_quotes_and_brackets(spark):
    cells = {
        "TOT; upper oil temperature; ": ["TOT", "upper oil temperature"],
        "bus joint；bolted joint；": ["bus joint", "bolted joint"],
        '"hydrogen in oil","H2 in oil"': ["hydrogen in oil", "H2 in oil"],
        '["fan power", "bank, power"]': ["fan power", "bank, power"],
        'A/D rate': ["A/D rate"],
        "line-to-line voltage / nominal voltage / highest": ["line-to-line voltage", "nominal voltage", "highest"],
        'CT ratio, class;; site altitude;;': ["CT ratio, class", "site altitude"],
        '"19"" rack space"; "alarm list; latest issue"': ['19" rack space', "alarm list; latest issue"],
        '19" rack space / bay count': ['19" rack space', "bay count"],
        "analogue inputs ,AI (4/20, mA) ,AI channels": ["analogue inputs", "AI (4/20, mA)", "AI channels"],
        "site altitude;\nnetwork addresses": ["site altitude", "network addresses"],
        "owner's plan; inspector's list": ["owner's plan", "inspector's list"],
        "'it''s one'; two": ["it's one", "two"],
    }
    assert values(spark, list(cells)) == list(cells.values())


def test_identifiers(spark):
    cells = ["A_B_1/C_D_2 & E_F_3", "A_B_1 and C_D_2;\nE_F_3", "; A_B_1;;C_D_2; ", "'A_B_1';\"C_D_2\"", "A_B_1\tC_D_2", "AND_B_1+C_D_2"]
    assert values(spark, cells, True) == [["A_B_1", "C_D_2", "E_F_3"], ["A_B_1", "C_D_2", "E_F_3"], ["A_B_1", "C_D_2"], ["A_B_1", "C_D_2"], ["A_B_1", "C_D_2"], ["AND_B_1", "C_D_2"]]


def test_nothing_null_long_and_placeholder_characters(spark):
    assert values(spark, [None, "", "  ", "[ ]", *NOTHING, " TBD "]) == [[]] * (5 + len(NOTHING))
    mark = "0"
    assert values(spark, [f'"a; b"; {mark}; c']) == [["a; b", mark, "c"]]
    long = ";".join(f"v{k}" for k in range(20000))
    assert len(values(spark, [long])[0]) == 20000


def test_round_trip(spark):
    rng = random.Random(3)
    pool = ["oil", 'a"b', "x, y", "p; q", "m | n", "19 (4/20)", "it's", "a / b"]
    rows = [[rng.choice(pool) for _ in range(rng.randint(1, 6))] for _ in range(200)]
    sep = [";", " | ", ","]
    cells = [rng.choice(sep).join('"' + v.replace('"', '""') + '"' for v in r) for r in rows]
    assert values(spark, cells) == rows


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "row_ord long, cell string, pos int, val string, parts string")
    assert unpack(df, "row_ord", "cell").count() == 0
