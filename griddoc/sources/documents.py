"""Folders of project files as tables of documents and segments.

Files are read by Spark's binary source and parsed on the executors, one file at a time. A file that cannot be read gives one
segment with location "error".
"""

from __future__ import annotations

import csv
import email
import email.policy
import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from griddoc.functions.text import doc_type_of
from griddoc.sources import pdf

#: Extensions that are read.
EXTENSIONS = ["pdf", "docx", "xlsx", "xlsm", "pptx", "csv", "eml", "msg", "txt", "md"]
Segments = list[tuple[str, str]]


def decoded(data: bytes) -> str:
    """Text of a file: UTF-8 without byte order mark, else Latin-1."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def text_blocks(text: str) -> Segments:
    """Blocks between blank lines, located by their lines."""
    out, start, block = [], 0, []
    for n, line in enumerate([*text.splitlines(), ""], 1):
        if line.strip():
            start = start or n
            block.append(line)
        elif block:
            out.append((f"lines {start}-{n - 1}", "\n".join(block).strip()))
            start, block = 0, []
    return out


def csv_rows(data: bytes) -> Segments:
    rows = csv.reader(io.StringIO(decoded(data)))
    cells = ((n, [c.strip() for c in r if c.strip()]) for n, r in enumerate(rows, 1))
    return [(f"row {n}", " | ".join(c)) for n, c in cells if c]


def mail(data: bytes) -> Segments:
    """Headers that are set, then the body's blocks; plain text is preferred to HTML."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    head = "\n".join(f"{k}: {m[k]}" for k in ("From", "To", "Cc", "Subject", "Date") if m[k])
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_subtype() == "html":
        text = html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<br\s*/?>|</p>|</div>", "\n", text)))
    blocks = [b.strip() for b in re.split(r"\n\s*\n", text.replace("\r\n", "\n")) if b.strip()]
    return [("header", head)] * bool(head) + [(f"body block {n}", b) for n, b in enumerate(blocks, 1)]


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ElementTree.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == tag)


def word(data: bytes) -> Segments:
    """Paragraphs, then the rows of tables with their cells between bars."""
    body = next(e for e in _xml(zipfile.ZipFile(io.BytesIO(data)), "word/document.xml") if _local(e) == "body")
    out = [(f"paragraph {n}", t) for n, p in enumerate((e for e in body if _local(e) == "p"), 1) if (t := _texts(p).strip())]
    for k, table in enumerate((e for e in body if _local(e) == "tbl"), 1):
        for n, row in enumerate((e for e in table if _local(e) == "tr"), 1):
            cells = [t for c in row if _local(c) == "tc" and (t := _texts(c).strip())]
            if cells:
                out.append((f"table {k} row {n}", " | ".join(cells)))
    return out


def sheet_cells(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook; shared strings and inline texts are resolved, gaps are empty cells."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = [_texts(e) for e in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    links = {e.get("Id"): e.get("Target") for e in _xml(z, "xl/_rels/workbook.xml.rels")}
    out = []
    for s in (e for e in _xml(z, "xl/workbook.xml").iter() if _local(e) == "sheet"):
        target = next(links[v] for k, v in s.attrib.items() if k.endswith("}id"))
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for row in (e for e in _xml(z, path).iter() if _local(e) == "row"):
            cells: list[str] = []
            for c in (e for e in row if _local(e) == "c"):
                at = 0
                for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                value = next((v.text or "" for v in c if _local(v) == "v"), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else _texts(c) if c.get("t") == "inlineStr" else value)
            out.append((s.get("name"), int(row.get("r", len(out) + 1)), cells))
    return out


def sheet(data: bytes) -> Segments:
    return [(f"{s} row {n}", " | ".join(t)) for s, n, cells in sheet_cells(data) if (t := [c.strip() for c in cells if c.strip()])]


def slides(data: bytes) -> Segments:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    out = []
    for k, n in enumerate(names, 1):
        text = "\n".join(t for p in _xml(z, n).iter() if _local(p) == "p" and (t := _texts(p).strip()))
        if text:
            out.append((f"slide {k}", text))
    return out


def pdf_pages(data: bytes) -> Segments:
    """Pages with text. The package pypdf, where it is installed, knows more of the format than the reader of this package."""
    try:
        from pypdf import PdfReader
    except ImportError:
        texts = pdf.page_texts(data)
    else:
        texts = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
    return [(f"page {n}", t) for n, t in enumerate(texts, 1) if t]


PARSERS = {"pdf": pdf_pages, "docx": word, "xlsx": sheet, "xlsm": sheet, "pptx": slides, "csv": csv_rows, "eml": mail}


def parse(name: str, data: bytes) -> Segments:
    """Segments (location, text) of one file, by its extension."""
    parser = PARSERS.get(name.rpartition(".")[2].lower(), lambda d: text_blocks(decoded(d)))
    try:
        return parser(data)
    except Exception as e:  # noqa: BLE001
        return [("error", f"{type(e).__name__}: {e}")]


def read_folder(spark: SparkSession, folder: str, drawings: tuple[str, ...] = ()) -> DataFrame:
    """(path, file_name, seg_ord, location, text, doc_type) of all files below a folder with a known extension.

    Documents are ordered by path, segments by seg_ord. Names in drawings (in any case) are drawings whatever they are called.
    Files without text are left out, but PDF files and drawings keep one row without text. Each file is parsed once, and
    nothing is shuffled: what the kind of document needs of the first segment goes along as two flags.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    low = {x.lower() for x in drawings}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                found = parse(name, data)
                head = found[0][1].lower() if found else ""
                flags = "from:" in head[:500], any(w in head for w in ("single line diagram", "legend", "circuit breaker"))
                rows += [(path, name, k, loc, t, *flags) for k, (loc, t) in enumerate(found, 1)]
                if not found and (name.lower().endswith(".pdf") or name.lower() in low):
                    rows.append((path, name, 1, None, None, *flags))
            yield pd.DataFrame(rows, columns=["path", "file_name", "seg_ord", "location", "text", "mail", "drawing"])

    schema = "path string, file_name string, seg_ord int, location string, text string, mail boolean, drawing boolean"
    segments = files.where(ext.isin(EXTENSIONS)).select("path", "content").mapInPandas(run, schema)
    kind = F.when(F.lower("file_name").isin(sorted(low)), "Drawing / SLD").otherwise(doc_type_of(F.col("file_name"), F.col("mail"), F.col("drawing")))
    return segments.select("path", "file_name", "seg_ord", "location", "text", kind.alias("doc_type"))
