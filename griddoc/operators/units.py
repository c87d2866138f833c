"""Quantities in different units, brought to the standard unit of their metric.

An Aho-Corasick automaton over all unit aliases runs over the text beside the numbers. Of overlapping aliases the longest
counts; an alias counts for the number it follows, or, in a text without numbers, if it ends the text ("values in mm").
What an alias means is left open until the conversion factors are joined, on the alias and the kind of quantity of the
metric, so "C" is a temperature for one metric and a charge for another, and a unit of another kind finds no factor.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from griddoc.operators.packed import NOTHING, stripped
from griddoc.session import small

#: Decimal prefixes as symbols and as words.
PREFIX = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9}
PREFIX_WORD = {"pico": 1e-12, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "kilo": 1e3, "mega": 1e6, "giga": 1e9}
#: Units that take all prefixes - kind, symbols, names, factor to the kind's base.
PREFIXED = [
    ("charge", ["C"], ["coulomb", "coulombs"], 1.0),
    ("capacitance", ["F"], ["farad", "farads"], 1.0),
    ("voltage", ["V"], ["volt", "volts"], 1.0),
    ("current", ["A"], ["amp", "amps", "ampere", "amperes"], 1.0),
    ("power", ["W"], ["watt", "watts"], 1.0),
    ("apparent power", ["VA"], ["va"], 1.0),
    ("frequency", ["Hz"], ["hertz"], 1.0),
    ("resistance", ["ohm", "Ohm", "ohms", "Ohms"], [], 1.0),
    ("pressure", ["Pa"], ["pascal", "pascals"], 1.0),
    ("mass", ["g"], ["gram", "grams", "gramme", "grammes"], 1.0),
    ("length", ["m"], ["metre", "metres", "meter", "meters"], 1.0),
    ("time", ["s", "sec"], ["second", "seconds", "secs"], 1.0),
]
#: All other units - kind, factor, offset to the base (base = value * factor + offset), aliases.
SINGLE = [
    ("temperature", 1.0, 0.0, ["degC", "deg C", "deg. C", "°C", "° C", "C", "Celsius", "celsius", "degrees C", "degrees Celsius"]),
    ("temperature", 1.0, -273.15, ["K", "kelvin", "Kelvin", "degK", "°K"]),
    ("temperature", 5 / 9, -160 / 9, ["degF", "deg F", "deg. F", "°F", "° F", "F", "Fahrenheit", "fahrenheit", "degrees F", "degrees Fahrenheit"]),
    ("share", 1.0, 0.0, ["ppm", "PPM", "parts per million", "uL/L", "ul/l", "uL/l", "mL/m3", "ppmv"]),
    ("share", 1e-3, 0.0, ["ppb", "PPB", "parts per billion", "nL/L"]),
    ("share", 1e4, 0.0, ["%", "vol-%", "vol.-%", "vol%", "vol. %", "Vol-%", "Vol.-%", "% vol", "percent", "per cent"]),
    ("share", 1e3, 0.0, ["‰"]),
    ("pressure", 1e5, 0.0, ["bar", "Bar", "BAR", "bars"]),
    ("pressure", 1e2, 0.0, ["mbar", "mBar", "hPa", "millibar"]),
    ("pressure", 6894.757293168361, 0.0, ["psi", "PSI", "lbf/in2"]),
    ("pressure", 101325.0, 0.0, ["atm"]),
    ("mass", 1e6, 0.0, ["t", "tonne", "tonnes", "ton", "tons"]),
    ("mass", 453.59237, 0.0, ["lb", "lbs", "lb.", "pound", "pounds"]),
    ("mass", 28.349523125, 0.0, ["oz", "ounce", "ounces"]),
    ("length", 1e-2, 0.0, ["cm", "centimetre", "centimetres", "centimeter", "centimeters"]),
    ("length", 0.0254, 0.0, ["in", "in.", "inch", "inches"]),
    ("length", 0.3048, 0.0, ["ft", "ft.", "foot", "feet"]),
    ("time", 60.0, 0.0, ["min", "minute", "minutes", "mins"]),
    ("span", 1.0, 0.0, ["h", "hr", "hrs", "hour", "hours"]),
    ("span", 24.0, 0.0, ["d", "day", "days"]),
    ("span", 168.0, 0.0, ["wk", "wks", "week", "weeks"]),
    ("period", 1.0, 0.0, ["mo", "mo.", "month", "months", "mth", "mths"]),
    ("period", 12.0, 0.0, ["y", "yr", "yrs", "yr.", "year", "years"]),
    ("frequency", 1.0, 0.0, ["c/s", "cps"]),
    ("speed", 1.0, 0.0, ["m/s", "m per s", "m/sec", "metres per second"]),
    ("speed", 1e-3, 0.0, ["mm/s", "mm per s", "mm/sec"]),
    ("speed", 1e-2, 0.0, ["cm/s", "cm per s", "cm/sec"]),
    ("speed", 1 / 60, 0.0, ["m/min", "m per min"]),
    ("speed", 1 / 3.6, 0.0, ["km/h", "kmh", "km per h", "kph"]),
    ("speed", 0.3048, 0.0, ["ft/s", "fps"]),
    ("speed", 0.0254, 0.0, ["in/s", "ips"]),
    ("flow", 1.0, 0.0, ["l/min", "L/min", "lpm", "LPM", "l per min", "litres per minute"]),
    ("flow", 60.0, 0.0, ["l/s", "L/s", "l per s", "lps"]),
    ("flow", 1 / 60, 0.0, ["l/h", "L/h", "l per h", "lph"]),
    ("flow", 1000 / 60, 0.0, ["m3/h", "m3 per h", "cbm/h"]),
    ("flow", 1000.0, 0.0, ["m3/min"]),
    ("flow", 60000.0, 0.0, ["m3/s"]),
    ("humidity", 1.0, 0.0, ["%RH", "% RH", "%rH", "% rH", "rH%", "RH%", "% r.h.", "% rh", "%rh", "% rel. humidity", "% relative humidity", "%", "percent RH"]),
    ("humidity", 100.0, 0.0, ["RH (0-1)", "rh (0-1)", "RH fraction"]),
]
#: Standard units whose values are not converted.
NOT_CONVERTED = ["count", "text", "dB", "%"]
_SAME = str.maketrans({"\u00b5": "u", "\u03bc": "u", "\u03a9": "ohm", "\u2126": "ohm", "\u00b3": "3", "\u00ba": "\u00b0", "\u2103": "\u00b0C", "\u2109": "\u00b0F", "\u2212": "-", "\u00a0": " ", "\u202f": " "})


def alias_of(text: str) -> str:
    """One writing for characters that look or mean the same, single blanks, no blank at the ends."""
    return " ".join(text.translate(_SAME).split())


def factors() -> list[tuple[str, str, float, float]]:
    """(alias, kind, factor, offset), from the tables and the rule of prefixes. An alias has at most one meaning in a kind."""
    found: dict[tuple[str, str], tuple[float, float]] = {}
    for kind, f, o, names in SINGLE:
        for n in names:
            found.setdefault((alias_of(n), kind), (f, o))
    for kind, symbols, names, f in PREFIXED:
        for s, (p, x) in itertools.product(symbols, PREFIX.items()):
            found.setdefault((p + s, kind), (x * f, 0.0))
            found.setdefault((p + s + " x 1000", kind), (x * f * 1000, 0.0))
        for n in names:
            for w in (n, n.capitalize()):
                found.setdefault((w, kind), (f, 0.0))
        for n, (p, x), gap in itertools.product(symbols + names, PREFIX_WORD.items(), ("", "-", " ")):
            for w in (p + gap + n, (p + gap + n).capitalize()):
                found.setdefault((w, kind), (x * f, 0.0))
    return sorted((a, k, f, o) for (a, k), (f, o) in found.items())


class Finder:
    """The automaton over the aliases."""

    def __init__(self, aliases: list[str]):
        self.machine = ahocorasick.Automaton()
        self.known = set(aliases)
        for a in self.known:
            self.machine.add_word(a, a)
        self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """Spans of aliases that stand alone, the longest of any that overlap, from left to right."""
        spans = []
        for end, a in self.machine.iter(text):
            start = end - len(a) + 1
            before, after = text[start - 1 : start], text[end + 1 : end + 2]
            if not (before.isalpha() and a[0].isalpha()) and not (after.isalnum() and a[-1].isalnum()):
                spans.append((start, end + 1))
        taken: list[tuple[int, int]] = []
        for s, e in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
            if all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
        return sorted(taken)


_NUMBER = re.compile(r"(?<![\w.,])[-+]?\d+(?:[.,']\d+)*")
_RANGE = re.compile(r"^\s*([-+]?\d+(?:[.,']\d+)*)\s*(?:-|–|—|~|\.{2,3}|…|to|bis|à|a)\s*([-+]?\d+(?:[.,']\d+)*)")
_UPPER = re.compile(r"\b(?:not|no|nor) (?:more|greater|higher|over|above|exceed\w*)(?: than)?|\bup to\b|\bmax\w*|\bat most\b|\bmaximal\b|<|≤", re.I)
_LOWER = re.compile(r"\b(?:not|no|nor) (?:less|lower|below|under|fewer)(?: than)?|\bat least\b|\bmin\w*|>|≥", re.I)
_UNDER = re.compile(r"\b(?:below|under|less|lower|fewer|ceiling|limit)\b", re.I)
_OVER = re.compile(r"\b(?:above|over|more|greater|higher|from)\b", re.I)


def number_of(text: str) -> float | None:
    """The number of a text in any of the usual habits.

    With both signs the later one is the decimal sign; a sign that repeats groups thousands; a single comma groups
    thousands if just three digits follow it and one to three, not a lone zero, stand before it.
    """
    t = text.strip().replace("'", "")
    if t.count(",") + t.count(".") > 1 and min(t.count(","), t.count(".")) > 0:
        t = t.replace(".", "").replace(",", ".") if t.rfind(",") > t.rfind(".") else t.replace(",", "")
    elif t.count(",") > 1 or re.fullmatch(r"[-+]?[1-9]\d{0,2},\d{3}", t):
        t = t.replace(",", "")
    elif t.count(".") > 1:
        t = t.replace(".", "")
    try:
        return float(t.replace(",", "."))
    except ValueError:
        return None


def wording(text: str) -> tuple[bool, bool]:
    """Whether a lone figure is a lower and an upper bound; both, if the text says neither."""
    up, down = bool(_UPPER.search(text)), bool(_LOWER.search(text))
    if not up and not down:
        up, down = bool(_UNDER.search(text)), bool(_OVER.search(text))
    return down or not up, up or not down


def _folded(text: str) -> tuple[str, list[int]]:
    """The text in one writing, and the place in the original of each of its characters and of its end."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in c.translate(_SAME):
            out.append(x)
            at.append(i)
    return "".join(out), [*at, len(text)]


def read_text(text: str, finder: Finder) -> tuple[list[tuple[float, str | None]], str | None, str]:
    """Numbers with the unit each is followed by, the unit that holds for the text as a whole, and the text without both.

    Units are returned as written.
    """
    folded, at = _folded(text)
    units = finder.find(folded)
    numbers = [m for m in _NUMBER.finditer(folded) if all(m.end() <= s or m.start() >= e for s, e in units) and number_of(m[0]) is not None]
    found, rest, last = [], [], 0
    for m in numbers:
        gap = len(folded[m.end() :]) - len(folded[m.end() :].lstrip())
        unit = next(((s, e) for s, e in units if s == m.end() + gap), None)
        found.append((number_of(m[0]), unit and text[at[unit[0]] : at[unit[1]]]))
        rest.append(folded[last : m.start()])
        last = unit[1] if unit else m.end()
    ends = [text[at[s] : at[e]] for s, e in units if not re.search(r"\w", folded[e:])]
    whole = next((u for _, u in reversed(found) if u), None) if numbers else (ends[-1] if ends else None)
    return found, whole, " ".join([*rest, folded[last:]])


_finder: list[Finder] = []


def _shared() -> Finder:
    if not _finder:
        _finder.append(Finder([a for a, *_ in factors()]))
    return _finder[0]


def _given(unit: str | None) -> str | None:
    """The unit of a unit field, or None for null, blank and placeholders for nothing."""
    return unit.strip() if unit and unit.strip().lower() not in ("", *NOTHING) else None


def read_parameter(low, high, text, unit) -> list[tuple[str, float, str]]:
    """(bound, value, unit as written) of a product parameter."""
    written = _given(unit)
    found, whole, words = read_text(text, _shared()) if text else ([], None, "")
    if low is not None or high is not None:
        u = written or whole
        return [(b, v, u) for b, v in (("min", low), ("max", high)) if u and v is not None]
    if not found or not (written or whole):
        return []
    values = [(v, written or u or whole) for v, u in found]
    if len(values) >= 2:
        return [("min", *values[0]), ("max", *values[1])]
    return [(b, *values[0]) for b, yes in zip(("min", "max"), wording(words)) if yes]


def read_hit(raw, number, unit) -> list[tuple[str, float, str]]:
    """(bound, value, unit as written) of a find in a text."""
    written = _given(unit) or (read_text(_RANGE.sub(r"\2", raw), _shared())[1] if raw else None)
    figures = (number or raw or "").translate(_SAME)
    if not written:
        return []
    if m := _RANGE.match(figures):
        pair = [("min", number_of(m[1])), ("max", number_of(m[2]))]
    elif m := _NUMBER.search(figures):
        pair = [("val", number_of(m[0]))]
    else:
        pair = []
    return [(b, v, written) for b, v in pair if v is not None]


def _read(rows: DataFrame, key: str, cells: list[str], read, tab: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out = [(i, m, bound, v, u, alias_of(u)) for i, m, *x in zip(*cols) for bound, v, u in read(*x)]
            if out:
                arrays = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["row_id", "metric_id", "bound", "value", "written", "alias"])

    wanted = rows.where(F.col("metric_id").isNotNull()).select(F.col(key).cast("long"), "metric_id", *cells)
    return wanted.mapInArrow(run, "row_id long, metric_id string, bound string, value double, written string, alias string").select(F.lit(tab).alias("tab"), "*")


def factor_table(spark: SparkSession) -> DataFrame:
    """(alias, kind, factor, shift) of every alias; its size is fixed by the tables above."""
    return spark.createDataFrame(factors(), "alias string, kind string, factor double, shift double")


def convert(values: DataFrame, metrics: DataFrame) -> DataFrame:
    """(tab, row_id, bound, std_milli) of values not literally in their metric's standard unit.

    A unit without a meaning in the kind of the standard unit gives no row.
    """
    table = factor_table(values.sparkSession)
    std = metrics.select("metric_id", stripped(F.col("unit")).alias("std")).where(~F.col("std").isin(NOT_CONVERTED))
    to = std.join(F.broadcast(table), F.col("std") == F.col("alias")).select("metric_id", "std", "kind", F.col("factor").alias("f0"), F.col("shift").alias("s0"))
    milli = F.round((F.col("value") * F.col("factor") + F.col("shift") - F.col("s0")) / F.col("f0") * 1000).cast("long")
    return (
        values.join(small(to), "metric_id")
        .where(stripped(F.col("written")) != F.col("std"))
        .join(F.broadcast(table), ["alias", "kind"])
        .select("tab", "row_id", "bound", milli.alias("std_milli"))
        .distinct()
    )


def standardise(parameters: DataFrame, hits: DataFrame, metrics: DataFrame) -> DataFrame:
    """Values of product_parameter and value_hit in the standard units of metric_dictionary.

    Rows without metric, without any unit, with a unit of another kind, or whose figures cannot be read give no row; so do
    empty tables. Duplicate rows under an id of their own each count. Other columns are ignored.
    """
    read = _read(parameters, "param_id", ["min_value", "max_value", "supported_value", "unit"], read_parameter, "product_parameter")
    return convert(read.unionByName(_read(hits, "hit_id", ["raw", "number", "unit"], read_hit, "value_hit")), metrics)
