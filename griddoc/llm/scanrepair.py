"""Repair of pages that come from scanned files.

A page is scanned if its location says so or its lines are broken at one narrow width. Running headers and footers are
found by fuzzy repetition of lines at page edges: lines are compared by a key in which figures and the letters that
scanners mistake for each other are the same. Page numbers are recognised at the edges by their form. In the body, words
parted at a line end are joined and misread words replaced by what the vocabulary of the whole corpus holds: word counts
over all segments, apart for scanned and other text. A word is suspect if it is far rarer in other text than in scans, and
it is replaced only by a word that the named confusions lead to and that is far more common.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from griddoc.session import checkpointed, small

#: Longest line of a scanned page, lines at each edge that may be headers or footers, repetitions that make one.
WIDTH, TOP, BOTTOM, PER_FILE, PER_CORPUS = 80, 3, 2, 2, 3
#: The same for lines that only begin alike ("Survey of ..."), nine of ten of which must be as short as titles are.
PER_BEGINNING = 10
#: The most common words, which are not looked up again; a bound for the broadcast, without effect on the result.
COMMON = 50_000
#: Words counted per worker before they are passed on.
FLUSH = 300_000
#: A word is suspect below this part of the rate expected from scans; a replacement must be this much more common.
RARE, SURE = 0.1, 10
#: What scanners make of letters, as (read, true).
CONFUSED = [
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("rri", "m"), ("ii", "u"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"),
    ("vv", "w"), ("nn", "m"), ("0", "o"), ("o", "0"), ("5", "s"), ("s", "5"), ("@", "a"), ("!", "i"), ("!", "l"), ("|", "l"),
    ("|", "i"), ("1", "l"), ("1", "i"), ("l", "1"), ("l", "i"), ("i", "l"), ("i", "1"), ("c", "e"), ("e", "c"), ("b", "h"),
    ("h", "b"), ("f", "t"), ("t", "f"), ("6", "b"), ("8", "b"), ("9", "g"), ("q", "g"), ("g", "q"), ("u", "n"), ("n", "u"),
    ("v", "y"), ("y", "v"), ("$", "s"), ("€", "e"), ("(", "c"), ("3", "e"), ("4", "a"), ("2", "z"), ("7", "t"),
]
#: Signs at which a word is parted at a line end, and signs stripped around words.
PARTED = "-­¬=‐‑"
AROUND = " \t.,;:()[]\"'?„“”«»’‘*"
_FOLD = [("rri", "m"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("nn", "m")]
_FOLD_ONE = str.maketrans({"@": "a", "!": "i", "|": "i", "l": "i", "1": "i", "0": "o", "5": "s", "c": "e", "b": "h", "f": "t", "q": "g", "9": "g", "8": "h", "6": "h", "$": "s"})
_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "!": "1", "i": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8"})
_NUMBER = re.compile(r"^[\dlI|!iOoSsB]{1,5}$")
_PAGE_WORDS = ("page", "sheet", "seite", "blatt", "folio", "p", "pg", "pag", "feuille", "hoja", "of", "von", "de", "sur")


def folded(line: str) -> str:
    """A key under which a line and its misreadings fall together; figures are all the same."""
    t = re.sub(r"\s+", " ", line.strip().lower())
    for a, b in _FOLD:
        t = t.replace(a, b)
    t = t.translate(_FOLD_ONE)
    t = re.sub(r"(?<= )[a-z]$", "#", t)
    return re.sub(r"(?<![^\W\d_])[ios\d]*\d[ios\d]*(?![^\W\d_])|(?<=/)[ios\d]+(?= )|\b[ios]+\b(?= *$)", "#", t)


def is_page_number(line: str) -> bool:
    """A line of nothing but a page number, with or without a word for page, frame or total."""
    parts = re.findall(r"[^\s\-–—\[\]()/.,:]+", line)
    if len(parts) > 4:
        return False
    numbers = 0
    for p in parts:
        if _NUMBER.match(p) and (any(c.isdigit() for c in p) or len(p) <= 2 and p.lower() not in ("is", "so", "il", "si", "os", "b", "s")):
            numbers += 1
        elif len(p) > 6 or not _is_page_word(p.lower()):
            return False
    return 1 <= numbers <= 2


@lru_cache(20_000)
def _is_page_word(word: str) -> bool:
    """Whether the word is one of _PAGE_WORDS, or a longer one of them misread."""
    if word in _PAGE_WORDS:
        return True
    x = folded(word).replace("#", "")
    return any(x == y or len(x) == len(y) and sum(c != d for c, d in zip(x, y)) <= 1 for y in (folded(w).replace("#", "") for w in _PAGE_WORDS if len(w) > 2))


def is_scanned(text: str, location: str | None, mail: bool) -> bool:
    """Whether a page comes from a scanner, by its location or by lines broken at one narrow width."""
    if location and re.search(r"ocr|scan", location, re.I):
        return True
    if mail:
        return False
    lines = text.split("\n")
    pairs = [(a.rstrip(), b) for a, b in zip(lines, lines[1:]) if a.strip() and b.strip()]
    width = max(map(len, lines))
    if not pairs or width > WIDTH:
        return False
    full = sum(len(a) + 1 + len(b.split()[0]) > width - 1 for a, b in pairs)
    ended = sum(a[-1] in ".!?:" for a, _ in pairs)
    return full >= 0.35 * len(pairs) and ended <= 0.5 * len(pairs)


_MAIL = "coalesce(regexp_replace(lower(doc_type), '[^a-z]', '') in ('rawemail', 'email'), false) or coalesce(lower(file_name) rlike '[.](eml|msg)$', false)"


def _pages(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("text").isNotNull() & (F.col("text") != "")).select(
        F.col("seg_id").cast("long"), F.coalesce("file_name", F.lit("")).alias("file_name"), "location", F.expr(_MAIL).alias("mail"), "text"
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, other, scans): how often each word stands in scanned and in other text, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            done = (Counter(), Counter())
            for raw, c in zip(counts, done):
                for w, n in raw.items():
                    c[w.strip(AROUND)] += n
                raw.clear()
            words = [w for w in done[0].keys() | done[1].keys() if w]
            arrays = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in done)]
            return pa.RecordBatch.from_arrays(arrays, ["word", "other", "scans"])

        for b in batches:
            location, mail, text = (b.column(k).to_pylist() for k in range(3))
            for x, m, t in zip(location, mail, text):
                counts[is_scanned(t, x, m)].update(t.lower().split())
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield out()
        if counts[0] or counts[1]:
            yield out()

    counted = _pages(rows).select("location", "mail", "text").mapInArrow(run, "word string, other long, scans long")
    return counted.groupBy("word").agg(F.sum("other").alias("other"), F.sum("scans").alias("scans"))


def variants(word: str) -> list[str]:
    """What the word may be if one letter or group was misread."""
    out = set()
    for read, true in CONFUSED:
        i = word.find(read)
        while i >= 0:
            out.add(word[:i] + true + word[i + len(read) :])
            i = word.find(read, i + 1)
    if not word.isalpha() and _NUMBER.match(word):
        out.add(word.translate(_DIGITS))
    out.discard(word)
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _variants(words: pd.Series) -> pd.Series:
    return words.map(variants)


def page_places(text: str, common: set[str]) -> tuple[list, list, list]:
    """(edges, numbers, words) of a scanned page.

    edges: (line_no, key, unfilled) of lines that may be headers or footers; unfilled: the next word would have fitted, and no
    sentence ends. numbers: lines that are page numbers. words: (line_no, form, other form, within a line) to be looked up, the
    other form being the one with hyphen of a parted word.
    """
    lines = text.split("\n")
    filled = [k for k, x in enumerate(lines) if x.strip()]
    width = max(map(len, lines))
    edges, numbers, words = [], [], []
    skip = set()
    for rank, k in enumerate(filled):
        top, low = rank < TOP, rank >= len(filled) - BOTTOM
        line = lines[k]
        if not top and not low:
            continue
        if is_page_number(line):
            numbers.append(k + 1)
            skip.add(k)
            continue
        following = lines[k + 1].split() if k + 1 < len(lines) else []
        bare = line.rstrip()
        unfilled = bare[-1] not in ".!?;:," + PARTED and (not following or len(bare) + 1 + len(following[0]) < width)
        edges.append((k + 1, folded(re.sub(r"\s{3,}\S{1,4}$|^\S{1,4}\s{3,}", "", line)), unfilled))
    body = [k for k in filled if k not in skip]
    carried = None
    for at, k in enumerate(body):
        found = lines[k].lower().split()
        if carried is not None and found:
            head, line_no = carried
            tail = found.pop(0).strip(AROUND)
            if tail and tail[0].isalpha():
                words.append((line_no, head + tail, head + "-" + tail, False))
            elif tail:
                found.insert(0, tail)
            carried = None
        if found and len(found[-1]) > 1 and found[-1][-1] in PARTED and at + 1 < len(body) and lines[k].rstrip()[-1] in PARTED:
            head = found.pop().rstrip(PARTED).lstrip(AROUND)
            if head and head[-1].isalnum():
                carried = (head, k + 1)
        k0 = 0
        while k0 < len(found):
            w, k0 = found[k0].strip(AROUND), k0 + 1
            # A line set anew keeps the sign within it.
            if k0 < len(found) and len(w) > 1 and w[-1] in PARTED and w[-2].isalpha() and found[k0][0].isalpha():
                head, tail = w.rstrip(PARTED), found[k0].strip(AROUND)
                words.append((k + 1, head + tail, head + "-" + tail, True))
                k0 += 1
                continue
            if w not in common and any(c.isalpha() or c in "@!|$" for c in w):
                # A word of which only the exclamation mark may be misread is left to the look-up, unless its other letters are a common word.
                if not (w[-1] == "!" and len(w) > 2 and w[:-1] in common):
                    words.append((k + 1, w, None, False))
    return edges, numbers, words


def _places(rows: DataFrame, common) -> DataFrame:
    schema = "seg_id long, file_name string, kind string, line_no int, form string, other string, unfilled boolean"
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for b in batches:
            out = []
            for i, f, x, m, t in zip(*(c.to_pylist() for c in b.columns)):
                if not is_scanned(t, x, m):
                    continue
                edges, numbers, words = page_places(t, known)
                out += [(i, f, "edge", n, k, None, u) for n, k, u in edges]
                out += [(i, f, "number", n, None, None, None) for n in numbers]
                out += [(i, f, "word" if o is None else "inline" if inside else "parted", n, w, o, None) for n, w, o, inside in words]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    return _pages(rows).mapInArrow(run, schema)


def running_lines(edges: DataFrame) -> DataFrame:
    """(seg_id, line_no) of the edge lines whose key repeats within their file or over the corpus."""
    pages = edges.select("seg_id", "file_name", "line_no", "form", "unfilled")
    by_file = pages.groupBy("file_name", "form").agg(F.count_distinct("seg_id").alias("n_file"), F.count_if("unfilled").alias("u_file"))
    by_key = by_file.groupBy("form").agg(F.sum("n_file").alias("n_all"), F.sum("u_file").alias("u_all"))
    keys = by_file.join(by_key, "form").where((F.col("n_file") >= PER_FILE) & (F.col("u_file") * 2 >= F.col("n_file")) | (F.col("n_all") >= PER_CORPUS) & (F.col("u_all") * 2 >= F.col("n_all")))
    head = F.array_join(F.slice(F.split("form", " "), 1, 2), " ")
    beginnings = pages.groupBy(head.alias("head")).agg(F.count_distinct("seg_id").alias("n"), F.count_if("unfilled").alias("u"))
    beginnings = beginnings.where((F.col("n") >= PER_BEGINNING) & (F.col("u") * 10 >= F.col("n") * 9)).select("head")
    short = pages.where("unfilled").withColumn("head", head)
    same = short.join(keys.select("file_name", "form"), ["file_name", "form"], "left_semi")
    return same.unionByName(short.join(beginnings, "head", "left_semi")).select("seg_id", "line_no").distinct()


def _resolved(forms: DataFrame, counts: DataFrame, rate: float) -> DataFrame:
    """(form, repaired) for each form that is suspect and has a sure replacement; rate: words of other text per scanned word."""
    seen = forms.join(counts, forms["form"] == counts["word"], "left").select("form", F.coalesce("other", F.lit(0)).alias("other"), F.coalesce("scans", F.lit(0)).alias("scans"))
    suspect = seen.where(F.col("other") < RARE * rate * F.greatest("scans", F.lit(1))).select("form", "scans")
    suspect = checkpointed(suspect)
    lookup = counts.select(F.col("word").alias("v"), F.col("other").alias("n")).where(F.col("n") >= SURE)
    best = W.partitionBy("form").orderBy(F.col("n").desc(), "v")

    def pick(tried: DataFrame) -> DataFrame:
        sure = tried.join(lookup, "v").where(F.col("n") >= F.greatest(F.lit(SURE), F.col("scans")))
        return sure.withColumn("r", F.row_number().over(best)).where("r = 1").select("form", F.col("v").alias("repaired"))

    once = suspect.select("form", "scans", F.explode(_variants("form")).alias("v"))
    first = checkpointed(pick(once))
    left = suspect.join(first, "form", "left_anti").where(F.length("form").between(4, 40)).select("form", "scans", F.explode(_variants("form")).alias("u"))
    twice = left.select("form", "scans", F.explode(_variants("u")).alias("v")).distinct()
    return first.unionByName(pick(twice))


def damaged(rows: DataFrame) -> DataFrame:
    """(seg_id, line_no, repaired): one row per damaged place of the scanned pages among rows.

    Lines that are only running header, footer or page number have an empty repaired; a word parted or misread has the
    correct word in lower case at the line where it begins. Null and empty texts have no row; pages without damage neither;
    repeated deliveries each have their rows; other columns are ignored. The vocabulary comes from all rows.
    """
    counts = checkpointed(word_counts(rows))
    total = counts.agg(F.sum("other").alias("o"), F.sum("scans").alias("s")).first()
    rate = (total["o"] or 0) / max(total["s"] or 0, 1)
    good = counts.where((F.col("other") >= SURE) & (F.col("other") >= RARE * rate * F.greatest("scans", F.lit(1)))).select("word", "other")
    shared = rows.sparkSession.sparkContext.broadcast({r["word"] for r in good.orderBy(F.col("other").desc(), "word").limit(COMMON).select("word").collect()})
    places = checkpointed(_places(rows, shared))
    lines = running_lines(places.where("kind = 'edge'")).unionByName(places.where("kind = 'number'").select("seg_id", "line_no"))
    lines = checkpointed(lines.distinct())
    words = places.where("kind in ('word', 'parted', 'inline')").join(lines, ["seg_id", "line_no"], "left_anti")
    forms = words.groupBy("form", "other").agg(F.count(F.lit(1)).alias("n"))
    called = (F.length("form") > 2) & F.endswith("form", F.lit("!")) & F.col("other").isNull()
    bare = forms.where(called).withColumn("word", F.expr("left(form, length(form) - 1)")).join(good.select("word"), "word", "left_anti").drop("word")
    forms = checkpointed(forms.where(~called).unionByName(bare))
    # A parted word is the form that is more common; where neither is known, what either can be mended to; else the plain one,
    # but within a line, where a dash may be meant, none.
    every = forms.select("form").unionByName(forms.where("other is not null").select(F.col("other").alias("form"))).distinct()
    mend = small(checkpointed(_resolved(every, counts, rate)))
    c = counts.select("word", F.col("other").alias("k"))
    known = (
        forms.join(c.select(F.col("word").alias("form"), F.col("k").alias("k1")), "form", "left")
        .join(c.select(F.col("word").alias("other"), F.col("k").alias("k2")), "other", "left")
        .join(mend.select("form", F.col("repaired").alias("r1")), "form", "left")
        .join(mend.select(F.col("form").alias("other"), F.col("repaired").alias("r2")), "other", "left")
    )
    k1, k2 = F.coalesce("k1", F.lit(0)), F.coalesce("k2", F.lit(0))
    whole = F.when((k1 > 0) & (k1 >= k2) & F.col("r1").isNull(), F.col("form")).when((k2 > 0) & F.col("r2").isNull(), F.col("other")).otherwise(F.coalesce("r1", "r2", "form"))
    answer = known.select("form", "other", F.when(F.col("other").isNull(), F.col("r1")).otherwise(whole).alias("repaired"), ((k1 > 0) | (k2 > 0) | F.coalesce("r1", "r2").isNotNull()).alias("sure")).where("repaired is not null")
    fixed = words.alias("w").join(small(checkpointed(answer)).alias("a"), (F.col("w.form") == F.col("a.form")) & F.col("w.other").eqNullSafe(F.col("a.other")))
    fixed = fixed.where("kind <> 'inline' or sure")
    return lines.select("seg_id", "line_no", F.lit("").alias("repaired")).unionByName(fixed.select("seg_id", "line_no", "repaired")).distinct()
