"""Cells that pack several values.

Spans whose inside must not be split (quoted values, parentheses) are replaced by indexed placeholders, the rest is split
at its delimiters, the placeholders are filled again from the array of spans, and the values are exploded with positions.
All of it is built-in expressions over one row; nothing is shuffled.

Of several kinds of delimiters the strongest that stands outside the spans counts, since the weaker ones then belong to
the values: line break, tab, semicolon or bar; a slash between blanks; a comma. Cells of identifiers, which hold no
delimiter themselves, are split at all of them and at blanks, slash, ampersand, plus and "and".

A placeholder is U+E000, the index, U+E001. These two characters are spans themselves where a cell already holds one, so
no text can be taken for a placeholder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _SHUT = "\ue000", "\ue001"
_BEFORE, _AFTER = r"(?<![^\s;；|,/&+])", r"(?=[\s;；|,/&+]|$)"
SPAN = rf'{_BEFORE}"(?:[^"]|"")*+"{_AFTER}|{_BEFORE}\x27(?:[^\x27]|\x27\x27)*+\x27{_AFTER}|\([^()]*+\)|[{_OPEN}{_SHUT}]'
MARK = rf"{_OPEN}(\d+){_SHUT}"
STRONG, SLASH, COMMA = r"[\n\r\t;；|]+", r"\s+/\s+", r"[,，]"
IDS = r"(?:[\s,，;；|/&+]|\band\b)+"
#: Cell contents that mean "nothing", in lower case.
NOTHING = ["-", "--", "–", "—", "?", "n/a", "n.a.", "na", "none", "null", "nil", "tbd", "tbc", "tba"]


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", "")


def is_nothing(c: Column) -> Column:
    """Null, blank or only a placeholder for nothing."""
    s = F.lower(stripped(c))
    return c.isNull() | (s == "") | s.isin(NOTHING)


def _marked(cell: Column) -> Column:
    """The cell with each span replaced by its placeholder."""
    between = F.split(cell, SPAN, -1)
    last = F.size(between) - 1
    return F.array_join(F.transform(between, lambda p, i: F.when(i < last, F.concat(p, F.lit(_OPEN), i.cast("string"), F.lit(_SHUT))).otherwise(p)), "")


def _parts(marked: Column, ids: bool) -> Column:
    if ids:
        return F.split(marked, IDS, -1)
    return (
        F.when(marked.rlike(STRONG), F.split(marked, STRONG, -1))
        .when(marked.rlike(SLASH), F.split(marked, SLASH, -1))
        .otherwise(F.split(marked, COMMA, -1))
    )


def _filled(part: Column, spans: Column) -> Column:
    """The part with its spans in place again; a part that is one quoted span loses the quotes."""
    at = F.regexp_extract_all(part, F.lit(MARK), F.lit(1))
    between = F.split(part, MARK, -1)
    whole = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(spans, F.get(at, i).cast("int")), F.lit("")))), "")
    quote = F.substring(whole, 1, 1)
    inner = F.substring(whole, F.lit(2), F.length(whole) - 2)
    bare = F.when(quote == '"', F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.replace(inner, F.lit("''"), F.lit("'")))
    return F.when(part.rlike(rf"^{MARK}$") & quote.isin('"', "'"), bare).otherwise(whole)


def unpack(rows: DataFrame, key: str, cell: str, ids: bool = False) -> DataFrame:
    """(key, pos, val): one row per value of rows[cell], pos from 1 in the order of the cell.

    Null and blank cells and placeholders for nothing give no row; empty entries neither row nor position. Rows of equal
    content each give their values. Other columns are ignored, so their names cannot clash.
    """
    whole = stripped(F.col("cell"))
    bare = F.when(whole.rlike(r"(?s)^\[.*\]$"), F.substring(whole, F.lit(2), F.length(whole) - 2)).otherwise(whole)
    return (
        rows.select(F.col(key), F.col(cell).alias("cell"))
        .where(~is_nothing(F.col("cell")))
        .select(key, stripped(bare).alias("cell"))
        .select(key, F.regexp_extract_all("cell", F.lit(SPAN), F.lit(0)).alias("spans"), _marked(F.col("cell")).alias("marked"))
        .select(key, "spans", F.transform(_parts(F.col("marked"), ids), stripped).alias("parts"))
        .select(key, F.transform("parts", lambda p: stripped(_filled(p, F.col("spans")))).alias("vals"))
        .select(key, F.posexplode(F.filter("vals", lambda v: v != "")).alias("pos", "val"))
        .select(key, (F.col("pos") + 1).alias("pos"), "val")
    )
