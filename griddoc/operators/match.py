"""Terms of a controlled vocabulary in segments, and the evidence made of them.

The vocabulary is compiled into one Aho-Corasick automaton that passes once over each segment, so the cost does not grow
with the number of terms. Everything after the hits is built-in expressions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from griddoc.functions import text as X
from griddoc.session import checkpointed, small

#: Evidence below this confidence is dropped, and so many are kept per scenario and document.
LEAST_CONFIDENCE, PER_DOCUMENT = 0.30, 4
#: Terms that the vocabulary may have; it is held by every worker.
VOCABULARY = 100_000


HIT = "term_ord long, at int, line int, excluded boolean, snippet string, near string"


def first_hits(segments: DataFrame, terms: DataFrame, key: str, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, term_ord, at, line, excluded, snippet, near): the first hit of each term (term_ord, term) in each segment, by the rule of find_term.

    Line, snippet and whether a phrase excludes the hit are read off while the text is at hand, so it is never joined back.
    Null and empty texts and terms have no hit. More than VOCABULARY terms are refused: a vocabulary of that size is no
    controlled one, and should be joined by tokens.
    """
    rows = terms.select("term_ord", F.lower(X.squeezed(F.col("term"))).alias("term"), X.is_short(F.lower(X.squeezed(F.col("term")))).alias("short")).where("term <> ''").limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} terms")
    by_term: dict[str, tuple[bool, list[int]]] = {}
    for r in rows:
        by_term.setdefault(r["term"], (r["short"], []))[1].append(r["term_ord"])
    shared = segments.sparkSession.sparkContext.broadcast(by_term)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        machine = ahocorasick.Automaton()
        for t in known:
            machine.add_word(t, t)
        if known:
            machine.make_automaton()
        word = set("abcdefghijklmnopqrstuvwxyz0123456789")
        for b in batches if known else ():
            out, place = [], []
            for k, (s, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                seen: dict[str, int] = {}
                for end, t in machine.iter(s):
                    start = end - len(t) + 1
                    if t in seen or known[t][0] and (start and s[start - 1] in word or end + 1 < len(s) and s[end + 1] in word):
                        continue
                    seen[t] = start
                for t, at in seen.items():
                    near = text[max(0, at - X.BEHIND) : at + X.AHEAD].lower()
                    cut = " ".join(text[max(0, at - X.AROUND) : at + X.AROUND].split())
                    cut = ("..." if at > X.AROUND else "") + cut + ("..." if at + X.AROUND < len(text) else "")
                    rest = (at, text.count("\n", 0, at) + 1, any(c in near for c in X.EXCLUSION_CUES), cut, text[max(0, at - X.NEAR) : at + X.NEAR])
                    out += [(o, *rest) for o in known[t][1]]
                    place += [k] * len(known[t][1])
            if out:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
                taken = [c.take(pa.array(place)) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array(list(c), t) for c, t in zip(zip(*out), types))], [key, *carry, "term_ord", "at", "line", "excluded", "snippet", "near"])

    wanted = segments.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.lower(F.col(text)).alias("_low"), F.col(text).alias("_text"), F.col(key).cast("long").alias(key), *carry)
    schema = ", ".join(f"{n} {t}" for n, t in wanted.dtypes[2:])
    return wanted.mapInArrow(run, f"{schema}, {HIT}")


def occurrences(texts: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n, texts): how often each term (term) stands in all texts, by the rule of count_term, and in how many of them.

    One pass of the automaton counts all terms; the sums are formed in the worker before they are shuffled. Terms that stand
    nowhere have zeros; null texts hold none.
    """
    given = terms.select("term", F.lower(X.squeezed(F.col("term"))).alias("t"), X.is_short(F.lower(X.squeezed(F.col("term")))).alias("short")).limit(VOCABULARY + 1)
    rows = given.where("t <> ''").collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} terms")
    shared = texts.sparkSession.sparkContext.broadcast({r["t"]: r["short"] for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        machine = ahocorasick.Automaton()
        for t in known:
            machine.add_word(t, t)
        if known:
            machine.make_automaton()
        word = set("abcdefghijklmnopqrstuvwxyz0123456789")
        n: Counter = Counter()
        held: Counter = Counter()
        for b in batches if known else ():
            for s in b.column(0).to_pylist():
                here: Counter = Counter()
                free: dict[str, int] = {}
                for end, t in machine.iter(s):
                    start = end - len(t) + 1
                    if known[t] and (start and s[start - 1] in word or end + 1 < len(s) and s[end + 1] in word) or start < free.get(t, 0):
                        continue
                    free[t] = end + 1
                    here[t] += 1
                n.update(here)
                held.update(here.keys())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64()), pa.array([held[t] for t in n], pa.int64())], ["t", "n", "texts"])

    counted = texts.where(F.col(text).isNotNull()).select(F.lower(F.col(text))).mapInArrow(run, "t string, n long, texts long").groupBy("t").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    return given.select("term", "t").join(counted, "t", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("texts", F.lit(0)).alias("texts"))


def evidence(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits of the vocabulary with line, snippet and confidence.

    segments: seg_id, file_name, seg_ord, text. terms: term_ord, term, scenario_id, kind ('synonym' or 'keyword'), priority.
    Tables of contents are left out, as are hits near a phrase that excludes them, and ambiguous keywords without another
    term of their scenario in the same segment.
    """
    body = segments.where(~X.is_contents(F.col("text"))).select("seg_id", "file_name", "seg_ord", "text")
    t = terms.select("term_ord", "term", "scenario_id", "kind", "priority", X.is_ambiguous(F.col("term")).alias("ambiguous"))
    hits = first_hits(body, terms, "seg_id", carry=("file_name", "seg_ord")).join(small(t), "term_ord")
    strong = F.count_if(~F.col("ambiguous")).over(W.partitionBy("seg_id", "scenario_id"))
    known = hits.withColumn("strong", strong).where(~F.col("ambiguous") | (F.col("kind") == "synonym") | (F.col("strong") > 0)).where(~F.col("excluded"))
    confidence = F.when(F.col("kind") == "synonym", X.priority_confidence(F.col("priority"))).otherwise(X.keyword_confidence(F.col("term")))
    return known.select("scenario_id", "file_name", "seg_id", "seg_ord", "term_ord", "term", "at", "line", "snippet", confidence.cast("decimal(5,3)").alias("confidence"))


def best_evidence(hits: DataFrame, per_document: int = PER_DOCUMENT) -> DataFrame:
    """The best hit of each snippet's beginning, of these the best per scenario and document, numbered within the document."""
    order = [F.col("confidence").desc(), "seg_ord", "seg_id", "term_ord"]
    one = W.partitionBy("scenario_id", "file_name", F.substring("snippet", 1, 60)).orderBy(*order)
    top = W.partitionBy("scenario_id", "file_name").orderBy(*order)
    kept = hits.where(F.col("confidence") >= LEAST_CONFIDENCE).withColumn("r", F.row_number().over(one)).where("r = 1")
    kept = kept.withColumn("r", F.row_number().over(top)).where(F.col("r") <= per_document)
    n = F.row_number().over(W.partitionBy("file_name").orderBy(F.col("confidence").desc(), "scenario_id", "seg_ord", "seg_id", "term_ord"))
    return kept.withColumn("evidence_id", F.concat(F.lit("EVD-"), F.lpad(n.cast("string"), 4, "0"))).drop("r")


def scenario_confidence(hits: DataFrame, by: list[str], corroborated: Column | None = None) -> DataFrame:
    """Confidence of each group: the best of its evidence, a little more for each further one, more if corroborated; at most 0.97."""
    extra = F.least(F.lit("0.1").cast("decimal(5,3)"), (F.count(F.lit(1)) - 1).cast("decimal(9,0)") * F.lit("0.02").cast("decimal(5,3)"))
    backed = F.max(corroborated) if corroborated is not None else F.lit(False)
    total = F.max("confidence") + extra + F.when(backed, F.lit("0.12").cast("decimal(5,3)")).otherwise(F.lit("0").cast("decimal(5,3)"))
    return hits.groupBy(*by).agg(F.least(F.lit("0.97").cast("decimal(5,3)"), total).cast("decimal(5,3)").alias("confidence"), F.count(F.lit(1)).alias("evidence_count"), backed.alias("corroborated"))


def asset_backed(asset_type: Column, corpus: Column) -> Column:
    """Whether a phrase of two words or more of asset_type (split at slash and comma), or the word gis, stands in the corpus."""
    phrases = F.filter(F.transform(F.split(F.lower(F.coalesce(asset_type, F.lit(""))), "[/,]"), lambda p: F.trim(p)), lambda p: F.size(F.split(p, r"\s+")) >= 2)
    gis = F.array_contains(F.split(F.lower(F.coalesce(asset_type, F.lit(""))), r"\s+"), "gis") & F.contains(corpus, F.lit("gis"))
    return F.exists(phrases, lambda p: F.contains(corpus, p)) | gis


def collapse(hits: DataFrame) -> DataFrame:
    """One row per scenario, document, segment and line: best confidence, distinct terms in order; unplaced hits (no line) stay apart."""
    placed = hits.where("line is not null").groupBy("scenario_id", "file_name", "seg_id", "line").agg(
        F.max("confidence").alias("confidence"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("term_ord", "term"))), lambda x: x["term"])), "; ").alias("terms")
    )
    free = hits.where("line is null").select("scenario_id", "file_name", "seg_id", "line", "confidence", F.col("term").alias("terms"))
    return placed.unionByName(free)


def contained(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term_ord): which terms (term_ord, term) stand anywhere in each lower-case text, as plain strings in any case.

    Null and empty texts and terms contain nothing; a key of several rows has their union.
    """
    rows = terms.select("term_ord", F.lower("term").alias("term")).where("term <> ''").limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} terms")
    by_term: dict[str, list[int]] = {}
    for r in rows:
        by_term.setdefault(r["term"], []).append(r["term_ord"])
    shared = texts.sparkSession.sparkContext.broadcast(by_term)
    wanted = texts.where(F.col(text).isNotNull()).select(F.lower(F.col(text)).alias("_low"), F.col(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        machine = ahocorasick.Automaton()
        for t in known:
            machine.add_word(t, t)
        if known:
            machine.make_automaton()
        for b in batches if known else ():
            place, out = [], []
            for k, s in enumerate(b.column(0).to_pylist()):
                found = [o for t in {t for _, t in machine.iter(s)} for o in known[t]]
                place += [k] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(place, pa.int64())), pa.array(out, pa.int64())], [key, "term_ord"])

    return wanted.mapInArrow(run, f"{key} {dict(wanted.dtypes)[key]}, term_ord long").distinct()


def _by_words(quotes: DataFrame, segments: DataFrame, prefix: int) -> DataFrame:
    """(quote_id, q, seg_id) of quotes (quote_id, file_name, q) and segments (file_name, seg_id, t) that may hold their beginning.

    A segment that holds it holds its second to fourth word as whole words, so segments are looked up by the hash of these.
    Beginnings of fewer words are looked up by what inner words they have; those without by their document alone.
    """
    head, words = F.split(F.substring("q", 1, prefix), " "), F.split("t", " ")
    q = quotes.withColumn("w", F.when(F.size(head) > 2, F.slice(head, 2, F.least(F.lit(3), F.size(head) - 2))).otherwise(F.array().cast("array<string>")))
    q = q.select("quote_id", "file_name", "q", F.size("w").alias("n"), F.xxhash64(F.array_join("w", " ")).alias("key"))
    keyed = small(checkpointed(q.where("n > 0")))
    sizes = [r["n"] for r in keyed.select("n").distinct().collect()]
    span = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda k: F.xxhash64(F.array_join(F.slice(words, k, n), " ")))
    hits = [segments.select("file_name", "seg_id", F.lit(n).alias("n"), F.explode(F.array_distinct(span(n))).alias("key")).join(keyed, ["file_name", "n", "key"]) for n in sizes]
    hits.append(segments.select("file_name", "seg_id").join(small(checkpointed(q.where("n = 0"))), "file_name"))
    return reduce(DataFrame.unionByName, [h.select("quote_id", "q", "seg_id") for h in hits])


def locate_quotes(quotes: DataFrame, segments: DataFrame, prefixes: tuple[int, ...] = (10_000, 160, 100, 60, 40)) -> DataFrame:
    """(quote_id, seg_id, at, prefix_rank): where each quote (quote_id, file_name, quote) stands in its document.

    White space may differ. Longer beginnings of the quote are tried first; of equal ones the first segment wins. The shortest
    beginnings are looked for by one automaton, up to VOCABULARY of them, more by their words; only what is found is compared.
    """
    q = checkpointed(quotes.where("file_name is not null").select("quote_id", "file_name", X.normal_key(F.col("quote")).alias("q")).where("q <> ''"))
    s = segments.where(~X.is_contents(F.col("text"))).select("file_name", "seg_id", "seg_ord", X.normal_key(F.col("text")).alias("t"))
    if q.limit(VOCABULARY + 1).count() <= VOCABULARY:
        keyed = q.withColumn("term", F.substring("q", 1, min(prefixes))).withColumn("term_ord", F.xxhash64("term"))
        held = contained(s, "seg_id", "t", keyed.select("term_ord", "term").distinct()).join(F.broadcast(keyed), "term_ord")
        pairs = held.select("quote_id", "q", "seg_id", F.col("file_name").alias("of"))
    else:
        pairs = _by_words(q, s, min(prefixes)).withColumn("of", F.lit(None).cast("string"))
    both = s.join(small(checkpointed(pairs)), "seg_id").where("of is null or of = file_name")
    rank = F
    for k, n in enumerate(prefixes):
        rank = rank.when(F.contains("t", F.substring("q", 1, n)), F.lit(k))
    found = both.select("quote_id", "q", "seg_id", "seg_ord", "t", rank.alias("prefix_rank")).where("prefix_rank is not null")
    size = F.element_at(F.array(*map(F.lit, prefixes)), F.col("prefix_rank") + 1)
    found = found.select("quote_id", "seg_id", "seg_ord", "prefix_rank", (F.instr(F.col("t"), F.substring(F.col("q"), F.lit(1), size)) - 1).alias("at"))
    best = F.min(F.struct("prefix_rank", "seg_ord", "seg_id", "at")).alias("b")
    return found.groupBy("quote_id").agg(best).select("quote_id", "b.seg_id", "b.at", "b.prefix_rank")
