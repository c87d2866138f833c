"""Column functions over text: terms, snippets, numbers, values with units, labels. Positions count from 0, -1 means absent.

All are built-in expressions. A null text gives null, or false for predicates, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that place what stands near them out of scope.
EXCLUSION_CUES = [
    "not part of the scope", "not part of this scope", "not part of the current", "not part of this contract",
    "not part of this technical", "not part of the supply", "not part of scope of supply", "not within the scope",
    "not in the scope", "not in scope", "out of scope", "outside the scope", "outside of scope",
    "not included in the scope", "not included in scope", "excluded from the scope", "excluded from supply",
    "excluded from this", "is excluded", "are excluded", "shall be excluded",
    "additional condition monitoring system is not",
]
#: Characters before and after a hit in which such a phrase counts, and that a snippet shows on each side.
BEHIND, AHEAD, AROUND = 160, 240, 230
#: Characters on each side of a term in which its value may stand.
NEAR = 60
#: Keywords that count only beside a specific term.
AMBIGUOUS = [
    "relay", "alarm", "alarm contacts", "sensor", "sensors", "monitor", "monitoring", "ethernet", "serial", "current",
    "voltage", "speed", "integration", "protocol", "gateway", "api", "display", "output", "outputs", "reliability",
]
#: The form of a number with unit, of a number in a specification, and the units of a count.
VALUE_UNIT = (
    r"(?i)(\d+(?:[.,]\d+)?(?:\s*[-/]\s*\d+(?:[.,]\d+)?)?)\s*(kV|kA|MVA|MVAR|MW|kW|VAC|VDC|Hz|ms|ppm|%RH|%|pC|mV|dB|samples/cycle|fps"
    r"|bays?|channels?|panels?|breakers?|transformers?|units?|sensors?|nos?\.?|sets?)?"
)
SPEC_NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
COUNT_UNITS = ["bay", "bays", "channel", "channels", "panel", "panels", "breaker", "breakers", "transformer", "transformers", "unit", "units", "sensor", "sensors", "no", "nos", "set", "sets", "count", ""]
#: Words that make a lone figure an upper or a lower bound.
UPPER_HINTS, LOWER_HINTS = ["up to", "upto", "max", "maximum", "≤", "<=", "<"], ["at least", "min", "minimum", "≥", ">=", ">"]
#: Lines of a table of contents.
TOC_LINE, TOC_LEADER = r"^\s*\d+(?:\.\d+)*\.?\s+.+?\s+\d{1,4}\s*$", r"\.{3,}\s*\d{1,4}\s*$"
#: The labels of drawings, as patterns, and the scope words in the order in which they count.
TAGS = {
    "breaker": r"(?i)\b\d{2,3}CB\d+\b",
    "transformer": r"(?i)\b(?:SST|TR|TF|AT|GT|ICT|TX|XFMR|OLTC|TRAFO)-?\s*\d+[A-Z]?\b",
    "bus": r"(?i)\b(?:BUSBAR|BUS|BB)-?\s*(?:\d+|[A-Z])\b",
    "coupling": r"(?i)\bPCC-?\s*(?:\d+|[A-Z])\b",
    "bay": r"=C\d{2}\b",
    "discharge sensor": r"-PD\d{1,2}\.\d{1,2}\b",
}
SCOPES = [
    ("Future", r"(?i)\b(?:future|fut\.|for future|future provision|future ext(?:ension)?)\b"),
    ("Provision", r"(?i)\bprov(?:ision)?\b"),
    ("Existing", r"(?i)\b(?:existing|exist\.)\b"),
    ("New", r"(?i)\b(?:new\b|in[\s-]scope|under\s+contract|current\s+scope)"),
]
#: Confidence of a mapped term by its priority.
PRIORITY = {"high": 0.85, "medium": 0.65, "low": 0.5}
VOLTAGE = r"(?i)(\d{2,4})\s*kV"
#: Gases as symbol, pattern of formula or name, name alone; those marked ambiguous need three others beside a bare formula.
GASES = [
    ("H2", r"\bh2\b|hydrogen", "hydrogen", False), ("CH4", r"\bch4\b|methane", "methane", False), ("C2H2", r"\bc2h2\b|acetylene", "acetylene", False),
    ("C2H4", r"\bc2h4\b|ethylene|ethene", "ethylene|ethene", False), ("C2H6", r"\bc2h6\b|ethane", "ethane", False), ("CO2", r"\bco2\b|carbon dioxide", "carbon dioxide", False),
    ("CO", r"\bco\b|carbon monoxide", "carbon monoxide", True), ("O2", r"\bo2\b|oxygen", "oxygen", True), ("N2", r"\bn2\b|nitrogen", "nitrogen", True),
]
#: Features and the words that show them.
FEATURES = {
    "dga_monitor": ["dga", "dissolved gas"], "temperature_monitor": ["temperature", "winding temp", "hot spot", "hot-spot"], "bushing_monitor": ["bushing"],
    "fiber_optic": ["fiber optic", "fibre optic", "fiber-optic", "fiber sensor"], "iec61850": ["61850"], "modbus_tcp": ["modbus"], "dnp3": ["dnp3", "dnp 3", "dnp-3"],
}


def squeezed(c: Column) -> Column:
    """White space runs as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normal_key(c: Column) -> Column:
    """squeezed, in lower case."""
    return F.lower(squeezed(c))


def split_list(c: Column, sep: str = ";") -> Column:
    """Trimmed, non-empty parts of a cell."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), squeezed), lambda x: x != "")


def is_short(term: Column) -> Column:
    """Terms of at most five letters or figures, which count only as whole words."""
    return (F.length(term) <= 5) & F.replace(term, F.lit(" "), F.lit("")).rlike(r"^[\p{L}\p{N}]+$")


def term_pattern(term: Column) -> Column:
    """The pattern of a trimmed, lower-case term: whole words for short terms, else the string."""
    quoted = F.regexp_replace(term, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")
    return F.when(is_short(term), F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))).otherwise(quoted)


def find_term(lowered: Column, term: Column) -> Column:
    """Position of the first hit of a term in a lower-case text; -1 for none and for an empty term."""
    t = F.lower(squeezed(term))
    return F.when(t == "", -1).otherwise(F.when(is_short(t), F.regexp_instr(lowered, term_pattern(t)) - 1).otherwise(F.instr(lowered, t) - 1))


def count_term(lowered: Column, term: Column) -> Column:
    """Hits of a term in a lower-case text, by the same rule."""
    t = F.lower(squeezed(term))
    return F.when(t == "", 0).otherwise(F.regexp_count(lowered, term_pattern(t)))


def window(text: Column, at: Column, behind: int, ahead: int) -> Column:
    """The text from behind characters before a position to ahead after it."""
    start = F.greatest(at - behind, F.lit(0))
    return F.substring(text, start + 1, at + ahead - start)


def snippet(text: Column, at: Column, width: int = AROUND) -> Column:
    """The squeezed text around a position, with dots where it goes on; the beginning for position -1."""
    cut = F.concat(F.when(at > width, "...").otherwise(""), squeezed(window(text, at, width, width)), F.when(at + width < F.length(text), "...").otherwise(""))
    return F.when(at < 0, F.substring(squeezed(text), 1, 2 * width)).otherwise(cut)


def excluded(text: Column, at: Column, behind: int = BEHIND, ahead: int = AHEAD) -> Column:
    """Whether a phrase of EXCLUSION_CUES stands around the position; false for -1."""
    near = F.lower(window(text, at, behind, ahead))
    cue = F.lit(False)
    for c in EXCLUSION_CUES:  # plain searches are many times faster than one alternation
        cue = cue | F.contains(near, F.lit(c))
    return (at >= 0) & F.coalesce(cue, F.lit(False))


def is_ambiguous(term: Column) -> Column:
    return F.coalesce(F.lower(F.trim(term)).isin(AMBIGUOUS), F.lit(False))


def keyword_confidence(term: Column) -> Column:
    n = F.length(F.trim(term))
    return F.when(n <= 3, F.lit(0.45)).when(n <= 6, F.lit(0.52)).otherwise(F.lit(0.6))


def priority_confidence(priority: Column) -> Column:
    p = F.lower(F.trim(F.coalesce(priority, F.lit(""))))
    out = F
    for name, value in PRIORITY.items():
        out = out.when(p == name, F.lit(value))
    return out.otherwise(F.lit(0.6))


def spec_numbers(c: Column) -> Column:
    """All numbers of a text, commas grouping thousands."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SPEC_NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def bounds(low: Column, high: Column, text: Column) -> Column:
    """struct(lo, hi): the given bounds, or what a text like "up to 35 kV" or "1 to 6" says; a lone number is a ceiling."""
    t, n = F.lower(F.coalesce(text, F.lit(""))), spec_numbers(text)
    given = low.isNotNull() | high.isNotNull()
    has = lambda hints: F.greatest(*(F.contains(t, F.lit(h)) for h in hints))
    upper = has(UPPER_HINTS)
    lower = ~upper & has(LOWER_HINTS)
    lo = F.when(given, low).when(F.size(n) == 0, None).when(lower, F.array_min(n)).when(~upper & (F.size(n) >= 2), F.array_min(n))
    hi = F.when(given, high).when(F.size(n) == 0, None).when(upper, F.array_max(n)).when(~lower & (F.size(n) >= 2), F.array_max(n)).when(~lower, F.get(n, F.lit(0)))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def verdict(required: Column, low: Column, high: Column, text: Column) -> Column:
    """'pass', 'fail' or 'unknown' of a required value against a capability; a text never fails."""
    v = F.trim(F.coalesce(required, F.lit("")))
    n = spec_numbers(v)
    b = bounds(low, high, text)
    x, lo, hi = F.get(n, F.lit(0)), b["lo"], b["hi"]
    inside = F.when(lo.isNull() & hi.isNull(), "unknown").when((lo.isNull() | (x >= lo)) & (hi.isNull() | (x <= hi)), "pass").otherwise("fail")
    t, needle = F.lower(F.coalesce(text, F.lit(""))), F.lower(v)
    shared = F.exists(F.split(needle, r"\s+"), lambda w: (F.length(w) > 1) & F.contains(t, w))
    worded = F.when((t != "") & (F.contains(t, needle) | shared), "pass").otherwise("unknown")
    return F.when(v == "", "unknown").when((F.size(n) > 0) & ~v.rlike("[a-zA-Z]{3,}"), inside).otherwise(worded)


def values_near(text: Column, at: Column, reach: int = NEAR) -> Column:
    """array of struct(raw, number, unit): numbers with units around a position; single figures without unit are left out."""
    none = F.array().cast("array<struct<raw:string,number:string,unit:string>>")
    return F.when(at < 0, none).otherwise(values_in(window(text, at, reach, reach)))


def values_in(near: Column) -> Column:
    """The same for a piece of text."""
    parts = [F.regexp_extract_all(near, F.lit(VALUE_UNIT), F.lit(k)) for k in range(3)]
    rows = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("raw", "number", "unit"))))
    kept = F.filter(rows, lambda r: (r["unit"] != "") | (F.length(r["number"]) > 1))
    return F.transform(kept, lambda r: F.struct(squeezed(r["raw"]).alias("raw"), r["number"].alias("number"), r["unit"].alias("unit")))


def unit_fits(unit: Column, expected: Column, is_count: Column) -> Column:
    """Whether a unit may stand for a metric with these expected units, or for a count."""
    u = F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), r"\.+$", "")
    return F.when(is_count, u.isin(COUNT_UNITS)).when(F.size(expected) <= 0, u != "").otherwise(F.array_contains(expected, u))


def tokens(c: Column) -> Column:
    """Distinct runs of a-z and figures of the lower-case text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != ""))


def mail_like(text: Column) -> Column:
    """Whether a text begins like a mail."""
    return F.contains(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 500)), F.lit("from:"))


def drawing_like(text: Column) -> Column:
    """Whether a text speaks of what drawings show."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("single line diagram|legend|circuit breaker")


def doc_type(name: Column, text: Column) -> Column:
    """Kind of document by its name, then by its first text."""
    return doc_type_of(name, mail_like(text), drawing_like(text))


def doc_type_of(name: Column, mail: Column, drawing: Column) -> Column:
    """The same from what mail_like and drawing_like say."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(n.rlike("sld|gsld|drawing|diagram|_dwg"), "Drawing / SLD")
        .when(n.rlike(r"\.(eml|msg)$|raw email") | mail, "Raw Email")
        .when(n.rlike("spec|tender|scope|requirement"), "Project Specification")
        .when(n.rlike("boq|quantity|schedule"), "Equipment List / BOQ")
        .when(n.rlike(r"\.pdf$") & drawing, "Drawing / SLD")
        .otherwise("Supporting")
    )


def is_contents(text: Column) -> Column:
    """Whether a text is a table of contents: most lines, and six at least, are a title with a page number."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"), lambda x: F.trim(x)), lambda x: x != "")
    hits = F.size(F.filter(lines, lambda x: x.rlike(TOC_LINE) | x.rlike(TOC_LEADER)))
    named = F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("table of contents")) & (hits >= 3)
    found = (F.size(lines) >= 6) & (named | ((hits >= 6) & (hits * 2 >= F.size(lines))))
    # Most texts have no line that ends in a figure, and need not be split.
    return F.when(text.rlike(r"\d\s*(?:[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]|$)"), found).otherwise(F.lit(False))


def scope_status(text: Column) -> Column:
    """The first of SCOPES that the text names, else 'Unclear'."""
    out = F
    for name, pattern in SCOPES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("Unclear")


def labels(text: Column, kind: str) -> Column:
    """Sorted distinct labels of a kind of TAGS."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TAGS[kind]), F.lit(0)), F.upper)))


def voltages(text: Column) -> Column:
    """Voltages in kV named in a text, with repetitions, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(VOLTAGE), F.lit(1)), lambda x: x.cast("int"))


def leading_number(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def page_number(location: Column) -> Column:
    return F.regexp_extract(F.coalesce(location, F.lit("")), r"(?i)page\s+(\d+)", 1).try_cast("int")


def quoted_term(notes: Column) -> Column:
    return F.regexp_extract(F.coalesce(notes, F.lit("")), "'([^']+)'", 1)


def slug(c: Column, default: str = "MODEL") -> Column:
    s = F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(s == "", default).otherwise(s)


def safe_id(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_-]", "")


def hash_suffix(name: Column) -> Column:
    """The eight hexadecimal figures at the end of a file name without its extension; empty for none."""
    return F.regexp_extract(F.regexp_replace(name, r"\.[^.]*$", ""), "_([0-9a-f]{8})$", 1)


def without_money(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(?:[$€£]|\b(?:USD|EUR|GBP)\b)\s*\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s*(?:[$€£]|\b(?:USD|EUR|GBP)\b)", "____")


def json_part(c: Column) -> Column:
    """The first object or list of a reply, within a code fence or between other text; empty for none."""
    return F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"```(?:json)?", ""), r"(?s)(\{.*\}|\[.*\])", 1)


def compact_quantity(c: Column) -> Column:
    """A quantity as text: empty if missing or not positive, whole numbers without decimals."""
    return F.when(c.isNull() | (c <= 0), "").when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def percent(c: Column) -> Column:
    """A percentage held between -1000 and 100."""
    return F.greatest(F.least(c, F.lit(100.0)), F.lit(-1000.0))


def features(text: Column) -> dict[str, Column]:
    """A flag for each of FEATURES: whether one of its words stands in the text; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {name: F.greatest(*(F.contains(low, F.lit(w)) for w in words), F.lit(False)) for name, words in FEATURES.items()}


def phrases(snippet_: Column, most: int = 8) -> Column:
    """Distinct parts of a snippet between its stops, the longest first."""
    parts = F.filter(F.transform(F.split(F.coalesce(snippet_, F.lit("")), r"\.{3}|[.;:\n|]"), lambda x: F.trim(x)), lambda x: F.length(x) > 3)
    by_size = F.array_sort(F.transform(F.array_distinct(parts), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("p"))))
    return F.slice(F.transform(by_size, lambda x: x["p"]), 1, most)
