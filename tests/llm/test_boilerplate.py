from pyspark.sql import functions as F

from griddoc.llm import boilerplate as b

SCHEMA = "seg_id long, file_name string, text string, line string, n long"


def rows(spark, data):
    return spark.createDataFrame([(i, f, t, "clash", 0) for i, f, t in data], SCHEMA)


def brute(data):
    out, files = set(), {}
    key = lambda s: "".join(c for c in s.lower() if c.isalpha())
    for i, f, t in data:
        files.setdefault(f, []).append((i, t))
    for segs in files.values():
        counts = {}
        for _, t in segs:
            for k in {key(x) for x in (t or "").split("\n")} - {""}:
                counts[k] = counts.get(k, 0) + 1
        for i, t in segs:
            for n, x in enumerate((t or "").split("\n"), 1):
                c = counts.get(key(x), 0)
                if c >= 4 and c * 5 >= len(segs):
                    out.add((i, n))
    return out


DATA = (
    [(k, "a", f"COPYRIGHT {k} Grid!\n\nbody {chr(97 + k)}\n1 2 3\n© Copyright grid") for k in range(4)]
    + [(10, "a", None), (11, "a", ""), (12, "a", "body q")]
    + [(20 + k, "b", "Share this") for k in range(3)]
    + [(30 + k, None, "Straße ÉTÉ\nx" + "y" * k) for k in range(5)]
    + [(40 + k, "c", "seen" if k < 4 else f"other {chr(97 + k)}") for k in range(21)]
    + [(70 + k, "d", "seen\nseen" if k < 4 else f"other {chr(97 + k)}") for k in range(20)]
)


def test_equals_brute_force(spark):
    got = {tuple(r) for r in b.find(rows(spark, DATA)).collect()}
    assert got == brute(DATA) and got


def test_incremental_equals_full(spark, tmp_path):
    parts = [DATA[0::3], DATA[1::3], DATA[2::3]]
    state = None
    for k, p in enumerate(parts):
        before = state
        b.write_postings(rows(spark, p), str(tmp_path / "postings"))
        b.merge_counts(state, b.count_delta(rows(spark, p))).write(str(tmp_path / f"state{k}"))
        state = b.Counts.read(spark, str(tmp_path / f"state{k}"))
    assert {tuple(r) for r in b.frequent(state).collect()} == {tuple(r) for r in b.frequent(b.count_delta(rows(spark, DATA))).collect()}
    crossed = b.crossings(before, state)
    posted = b.read_postings(spark, str(tmp_path / "postings"), crossed)
    changed = {r["seg_id"] for r in b.rows_to_rebuild(posted, crossed).collect()}
    assert changed == {r["seg_id"] for r in b.rows_to_rebuild(b.postings(rows(spark, DATA)), crossed).collect()}
    earlier = brute(parts[0] + parts[1])
    lines = {(i, n) for i, n in brute(DATA) ^ earlier if i in {x[0] for x in parts[0] + parts[1]}}
    assert {i for i, _ in lines} <= changed


def test_a_line_may_fall_below_the_threshold_again(spark):
    first, more = [(k, "a", "note") for k in range(4)], [(100 + k, "a", f"t{chr(97 + k)}") for k in range(17)]
    before = b.count_delta(rows(spark, first))
    after = b.merge_counts(before, b.count_delta(rows(spark, more)))
    assert [r["now"] for r in b.crossings(before, after).collect()] == [False]
    assert {r["seg_id"] for r in b.rows_to_rebuild(b.postings(rows(spark, first + more)), b.crossings(before, after)).collect()} == {0, 1, 2, 3}


def test_removal_and_empty(spark):
    df = rows(spark, DATA)
    got = {r["seg_id"]: r["clean"] for r in b.remove(df, b.frequent(b.count_delta(df))).collect()}
    assert got[0] == "\nbody a\n1 2 3" and got[10] is None and got[11] == "" and got[20] == "Share this"
    assert b.find(df.where(F.lit(False))).count() == 0


def test_removal_drops_the_found_lines(spark):
    df = rows(spark, DATA)
    drop = brute(DATA)
    want = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in drop) for i, _, t in DATA}
    assert {r["seg_id"]: r["clean"] for r in b.remove(df, b.frequent(b.count_delta(df))).collect()} == want
