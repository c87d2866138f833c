"""Texts cut off by a limit of their source or in transfer.

Length evidence. For every source and unit (characters, bytes) each length that far more texts share than its neighbours and
a first fit lead to expect is a candidate limit; a source may have several. A log-normal distribution of lengths is fitted by
maximum likelihood with the texts at all candidates right-censored there; the posterior that a text at a candidate was cut is
the part of those texts that neither the fitted density nor the neighbouring lengths explain. It depends on the shape of the
histogram, not on the size of the corpus.

Ending evidence. A text without sentence end is unfinished only if what stands after its last sentence end is the start
of a sentence. That is learned from all texts: of the pieces that begin with the same word, how many end as sentences do;
headings, list entries, rows and closing lines begin with words that don't.

Both are added as log-odds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from griddoc.session import checkpointed, small

#: Texts that must share a length before it is a candidate limit, and how many times as many as expected.
MIN_AT_LIMIT, TIMES = 3, 2
#: Texts of any one length that are expected at least, since real lengths have longer tails than the fitted ones.
BY_ITSELF = 0.5
#: Lengths compared with a candidate lie from FAR to NEAR away on both sides; a cut by bytes may leave up to three bytes unused.
NEAR, FAR = 4, 16
#: Log-odds of a cut in transfer where no limit explains the length, and of marks of omission there, which authors also use.
TRANSFER, OMISSION = -1.0, -6.0
#: Pieces counted per worker before they are passed on.
FLUSH = 200_000
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_PIECE = re.compile(r"[^.!?]+[.!?]*")
_MARK = re.compile(r"(?:\s*(?:\.{3,}|…|\[\s*(?:\.{3}|…|truncated|cut|cut off|more|continued)\s*\]|\((?:truncated|cut off|continued)\)))+$", re.I)
_ENDED = re.compile(r"[.!?。！？][)\]\"'»”’*_]*$")
_ITEM = re.compile(r"^\s*(?:[-*•–]\s|\d+[.)]\s|[a-z][.)]\s)|\||\t|^\W*$")


def ending(text: str) -> tuple[str, str | None, bool, str | None, bool]:
    """(state, first word, alone, last word, omission) of a text's end.

    state: 'whole' with a sentence end, 'item' for a list entry, row or rule, 'broken' with half a character, else 'open';
    then the first word of the last piece and whether it is the only one, its last word, and whether a mark of omission follows.
    """
    t = text.rstrip()
    if t.endswith("�"):
        return "broken", None, False, None, False
    bare = _MARK.sub("", t)
    omission = bare != t
    line = bare.rstrip().rsplit("\n", 1)[-1]
    if not line.strip() or not omission and _ENDED.search(line):
        return "whole", None, False, None, omission
    if _ITEM.search(line):
        return "item", None, False, None, omission
    piece = re.split(r"(?<=[.!?])[)\]\"'»”’*_]*\s+", line)[-1]
    ws = _WORD.findall(piece.lower())
    if not ws or omission and _ENDED.search(line):
        return "whole", None, False, None, omission
    return "open", ws[0], len(ws) == 1 and line[-1:].isalnum(), ws[-1], omission


def _endings(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, source string, chars int, bytes int, state string, opener string, alone boolean, last string, omission boolean, hash long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, len(t), len(t.encode("utf-8", "replace")), *ending(t), h) for i, s, t, h in zip(*(c.to_pylist() for c in b.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    wanted = docs.where(F.trim("text") != "").select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text", F.xxhash64("text"))
    return wanted.mapInArrow(run, schema)


def piece_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n, hits) over all pieces but the last of each text.

    kind 'first': pieces by first word, hits those with a sentence end; 'part': the same for each proper beginning, of three
    letters or more, of a first word; 'last': occurrences of a word, hits those right before a sentence end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        hits: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(n)
            arrays = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([n[k] for k in keys], pa.int64()), pa.array([hits[k] for k in keys], pa.int64())]
            n.clear()
            hits.clear()
            return pa.RecordBatch.from_arrays(arrays, ["kind", "key", "n", "hits"])

        for b in batches:
            for t in b.column(0).to_pylist():
                pieces = [p for line in t.split("\n") for p in _PIECE.findall(line)][:-1]
                for p in pieces:
                    if not (ws := _WORD.findall(p.lower())):
                        continue
                    end = p[-1] in ".!?"
                    first = ws[0]
                    n["first", first] += 1
                    hits["first", first] += end
                    for k in range(3, len(first)):
                        n["part", first[:k]] += 1
                        hits["part", first[:k]] += end
                    for w in ws:
                        n["last", w] += 1
                    hits["last", ws[-1]] += end
                if len(n) > FLUSH:
                    yield out()
        if n:
            yield out()

    counted = docs.where(F.trim("text") != "").select("text").mapInArrow(run, "kind string, key string, n long, hits long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def _log_tail(at: float, expected: float) -> float:
    """Logarithm of (a bound for) the probability that a Poisson count reaches at; its first term times a geometric series."""
    if at <= expected:
        return 0.0
    first = at * math.log(expected) - expected - math.lgamma(at + 1)
    return min(0.0, first - math.log1p(-expected / (at + 1)))


def fit(n: float, s1: float, s2: float, limits: list[tuple[float, float]]) -> tuple[float, float]:
    """Mean and deviation of the log lengths: n whole texts with sums s1, s2 of the logs and of their squares, and for each of
    limits (log length, texts) texts that are at least that long."""
    known = max(n, 1)
    mean = s1 / known if n else limits[0][0]
    sd = math.sqrt(max(s2 / known - mean * mean, 1e-4))
    total = n + sum(at for _, at in limits)
    for _ in range(200):
        m1, m2 = s1, s2
        for c, at in limits:
            z = (c - mean) / sd
            # Beyond 30 deviations the mean excess of a normal tail is that of an exponential one.
            mills = z + 1 / z if z > 30 else math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)
            m1 += at * (mean + sd * mills)
            m2 += at * (mean * mean + sd * sd + sd * (c + mean) * mills)
        m = m1 / total
        v = math.sqrt(max(m2 / total - m * m, 1e-4))
        done = abs(m - mean) + abs(v - sd) < 1e-7
        mean, sd = m, v
        if done:
            break
    return mean, sd


def cut_shares(n: float, s1: float, s2: float, found: list[tuple[int, float, float]], sizes: float) -> list[float]:
    """Posterior that a text at each candidate limit was cut. found: (limit, texts there, texts its neighbours lead to expect).

    It is the part of the texts there that the censored log-normal and the neighbours do not explain, times the probability
    that so many of them are no chance, given that the limit was picked among that many sizes.
    """
    if n < 2 or not found:
        return [0.0] * len(found)
    mean, sd = fit(n, s1, s2, [(math.log(limit), at) for limit, at, _ in found])
    total, out = n + sum(at for _, at, _ in found), []
    for limit, at, near in found:
        z = (math.log(limit) - mean) / sd
        expected = max(total * math.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi) * limit), near, BY_ITSELF)
        chance = math.exp(min(_log_tail(at, expected) + math.log(sizes), 50.0))
        out.append(max(0.0, 1 - expected / at) / (1 + chance))
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _posteriors(n: pd.Series, s1: pd.Series, s2: pd.Series, size: pd.Series, at: pd.Series, near: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([cut_shares(float(a), float(b), float(c), list(zip(x, y, z)), float(k)) for a, b, c, x, y, z, k in zip(n, s1, s2, size, at, near, sizes)], dtype=object)


def limits(ends: DataFrame) -> DataFrame:
    """(source, unit, limit, posterior) of each candidate limit of each source and unit; copies of a text count once."""
    size = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size"))))
    counts = ends.select("source", "chars", "bytes", "hash").distinct().select("source", size.alias("x")).groupBy("source", "x.unit", "x.size").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("source", "unit")
    log, total = F.log(F.col("size").cast("double")), F.sum("n").over(by)
    mean = F.sum(F.col("n") * log).over(by) / total
    spread = F.sqrt(F.greatest(F.sum(F.col("n") * log * log).over(by) / total - mean * mean, F.lit(1e-4)))
    aside = lambda a, b: F.coalesce(F.sum("n").over(by.orderBy("size").rangeBetween(a, b)), F.lit(0))
    near = (aside(-FAR, -NEAR) + aside(NEAR, FAR)) / F.lit(2.0 * (FAR - NEAR + 1))
    first = total * F.exp(-(((log - mean) / spread) ** 2) / 2) / (spread * math.sqrt(2 * math.pi) * F.col("size"))
    marked = counts.select("source", "unit", "size", "n", near.alias("near"), first.alias("first"), log.alias("log"))
    is_limit = (F.col("n") >= MIN_AT_LIMIT) & (F.col("n") >= TIMES * F.greatest("near", "first"))
    marked = marked.withColumn("limit", is_limit)
    whole, k = F.when(~F.col("limit"), F.col("n")).otherwise(0), F.struct("size", F.col("n").cast("double").alias("at"), "near")
    sums = marked.groupBy("source", "unit").agg(F.sum(whole).alias("n"), F.sum(whole * F.col("log")).alias("s1"), F.sum(whole * F.col("log") ** 2).alias("s2"), F.array_sort(F.collect_list(F.when(F.col("limit"), k))).alias("found"), F.count(F.lit(1)).alias("sizes"))
    sums = sums.where(F.size("found") > 0)
    got = sums.select("source", "unit", "found", _posteriors("n", "s1", "s2", F.col("found.size"), F.col("found.at"), F.col("found.near"), "sizes").alias("p"))
    each = got.select("source", "unit", F.explode(F.arrays_zip("found", "p")).alias("x"))
    return each.select("source", "unit", F.col("x.found.size").alias("limit"), F.col("x.p").alias("posterior")).where("posterior > 0")


def _odds(p):
    return F.log((p + 1e-3) / (1 - p + 1e-3))


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, source, score): the log-odds that the text was cut. Null, empty and blank texts have no row.

    A null source is a source of its own; texts of any length are read whole; repeated rows each have a score.
    """
    ends = checkpointed(_endings(docs))
    found = checkpointed(limits(ends))
    chars = small(found.where("unit = 'chars'").select(F.col("source").alias("cs"), F.col("limit").alias("chars_at"), F.col("posterior").alias("by_chars")))
    # A cut by bytes never splits a character, so up to three bytes may be missing.
    spare = found.where("unit = 'bytes'").select(F.col("source").alias("bs"), F.explode(F.sequence(F.col("limit") - 3, F.col("limit"))).alias("bytes_at"), "posterior")
    spare = small(spare.groupBy("bs", "bytes_at").agg(F.max("posterior").alias("by_bytes")))
    e = ends.join(chars, F.col("source").eqNullSafe(F.col("cs")) & (F.col("chars") == F.col("chars_at")), "left")
    e = e.join(spare, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bytes") == F.col("bytes_at")), "left").select(*ends.columns, F.greatest("by_chars", "by_bytes").alias("posterior"))
    counts = small(checkpointed(piece_counts(docs)))
    share = F.col("hits") / F.col("n")
    first = counts.where("kind = 'first'").select(F.col("key").alias("opener"), share.alias("p_first"))
    part = counts.where("kind = 'part'").select(F.col("key").alias("opener"), F.lit(True).alias("alone"), share.alias("p_part"))
    last = counts.where("kind = 'last'").select(F.col("key").alias("last"), F.col("n").alias("last_n"), F.col("hits").alias("last_hits"))
    e = e.join(first, "opener", "left").join(part, ["opener", "alone"], "left").join(last, "last", "left")
    length = F.coalesce(F.greatest(_odds(F.col("posterior")), F.lit(TRANSFER)), F.lit(TRANSFER))
    opens = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), _odds(F.coalesce("p_first", "p_part", F.lit(0.1)))))
    never_last = F.col("last_n").isNull() | (F.col("last_hits") == 0)
    marked = F.when(F.col("omission") & (F.coalesce("posterior", F.lit(0.0)) < 0.5) & ~never_last, OMISSION).otherwise(0.0)
    score = F.when(F.col("state") == "broken", 12.0).when(F.col("state") == "open", length + opens + marked).otherwise(-9.0 + F.greatest(length, F.lit(0.0)))
    return e.select("doc_id", "source", score.alias("score"))


def cut(docs: DataFrame) -> DataFrame:
    """doc_id of every text that was cut off inside a sentence or word."""
    return scored(docs).where("score > 0").select("doc_id")


def cut_share(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, cut_ppm): how many texts of each source were cut; blank and null texts count as not cut."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    c = scored(docs).where("score > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    j = n.alias("n").join(c.alias("c"), F.col("n.source").eqNullSafe(F.col("c.source")), "left")
    cuts = F.coalesce("n_cut", F.lit(0))
    return j.select("n.source", "n_docs", cuts.alias("n_cut"), F.round(cuts * 1_000_000 / F.col("n_docs")).cast("long").alias("cut_ppm"))
