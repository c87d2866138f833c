import io
import json
import zipfile

from pyspark.sql import functions as F

from griddoc.sources import documents, sheets, sinks
from griddoc.streaming import logs

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def xlsx():
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>Metric ID</t></si><si><t>M1</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2" t="inlineStr"><is><t>Unit</t></is></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="D3"><v>5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\ntwo\n\n\nthree")
    (tmp_path / "sub" / "spec.docx").write_bytes(docx())
    (tmp_path / "t.xlsx").write_bytes(xlsx())
    (tmp_path / "r.csv").write_text("x, ,y\n,,\nz\n")
    (tmp_path / "m.eml").write_text("From: a@b.example\nSubject: Hi\n\nBody one\n\nBody two\n")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "skip.bin").write_text("x")
    (tmp_path / "plan.txt").write_text("bay")
    rows = documents.read_folder(spark, str(tmp_path), ("PLAN.txt",)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["file_name"], r["seg_ord"])):
        got.setdefault(r["file_name"], []).append((r["location"], r["text"]))
    assert got["a.txt"] == [("lines 1-2", "one\ntwo"), ("lines 5-5", "three")]
    assert got["spec.docx"] == [("paragraph 1", "First"), ("table 1 row 1", "a | b")]
    assert got["t.xlsx"] == [("S row 2", "Metric ID | Unit"), ("S row 3", "M1 | 5")]
    assert got["r.csv"] == [("row 1", "x | y"), ("row 3", "z")]
    assert got["m.eml"] == [("header", "From: a@b.example\nSubject: Hi"), ("body block 1", "Body one"), ("body block 2", "Body two")]
    assert got["bad.docx"][0][0] == "error" and "empty.txt" not in got and "skip.bin" not in got
    kinds = {r["file_name"]: r["doc_type"] for r in rows}
    assert kinds["plan.txt"] == "Drawing / SLD" and kinds["m.eml"] == "Raw Email" and kinds["spec.docx"] == "Project Specification"


def test_header_is_found_anywhere(spark):
    cells = [(1, ["Guide", ""]), (2, ["", "metric id", "Standard Unit", "Synonyms / Raw Terms", "Extra"]), (3, ["", "M1", " kV ", "a; b;;", "x"]), (4, ["", "", "no key", "", ""]), (5, ["", "M2"]), (6, ["", "M1", "V", "c", ""])]
    df = spark.createDataFrame(cells, "row int, cells array<string>")
    heads = [(r, ["Metric ID" if c == "metric id" else c for c in cs]) for r, cs in cells]
    df = spark.createDataFrame(heads, "row int, cells array<string>")
    got = sheets.records(df, "metric").orderBy("row").collect()
    assert [(r["metric_id"], r["unit"], r["synonyms"], r["standard_name"]) for r in got] == [("M1", "kV", ["a", "b"], ""), ("M2", "", [], ""), ("M1", "V", ["c"], "")]
    assert {(r["metric_id"], r["row"], r["unit"]) for r in sheets.by_key(sheets.records(df, "metric"), "metric_id").collect()} == {("M1", 3, "V"), ("M2", 5, "")}
    assert sheets.records(df, "synonym", optional=True).count() == 0


def test_sections_are_carried(spark):
    cells = [(1, ["", "Part No"]), (2, ["Sensors", ""]), (3, ["S1", "P1"]), (4, ["S2", "P2"]), (5, ["Units", ""]), (6, ["U1", "P3"])]
    got = sheets.priced_models(spark.createDataFrame(cells, "row int, cells array<string>")).orderBy("row").collect()
    assert [(r["section"], r["model"]) for r in got] == [("Sensors", "S1"), ("Sensors", "S2"), ("Units", "U1")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"'), (2, "c")], "k int, v string")
    for _ in range(2):
        sinks.publish(df, str(tmp_path / "p"))
    assert sinks.read_published(spark, str(tmp_path / "p")).count() == 2
    sinks.publish(df.where("k = 1"), str(tmp_path / "p"))
    assert [r["k"] for r in sinks.read_published(spark, str(tmp_path / "p")).collect()] == [1]
    assert len([x for x in (tmp_path / "p").iterdir() if x.name.startswith("v-")]) == 2
    for v in (df, df.limit(1)):
        sinks.backed_up(v, str(tmp_path / "b"), "t")
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1 and spark.read.parquet(str(tmp_path / "b.t")).count() == 2
    assert {r["value"] for r in sinks.json_rows(df).collect()} == {'{"k":1,"v":"a \\"b\\""}', '{"k":2,"v":"c"}'}
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.export_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '"1","a ""b"""' in text


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"at": f"2025-01-01T00:{m:02d}:00", "kind": k} for m, k in [(1, "a"), (2, "a"), (12, "b")]] + [{"at": "2025-01-02T00:00:00", "kind": "z"}]
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    s = logs.read_log(spark, str(tmp_path / "in"), "at timestamp, kind string")
    q = logs.windowed_counts(s.where(F.col("at").isNotNull()), "at", "kind").writeStream.outputMode("complete").format("memory").queryName("log_counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["kind"], r["n"]) for r in spark.table("log_counts").collect()} == {("a", 2), ("b", 1), ("z", 1)}
