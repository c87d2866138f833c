"""Freely typed names mapped to the entries of a reference list, or to none.

Tokens first: every distinct token is joined to the vocabulary, the words of the reference list and the words common among
the typed names, on the strings left when one or two letters are dropped, and verified by edit distance. A rare token close
to a far more common one is replaced by it. So "vavle" becomes "valve" and stays foreign to the reference list.

Then whole names: the repaired tokens are compared with all entries by soft TF-IDF, in which an abbreviation (a part of the
letters of a word, in order, from the first one) stands for the word; names run together are compared as strings. The best
entry is taken if it explains enough of the name and the name enough of it.

The reference list is the dictionary and all names already mapped by hand, each once. Names equal to an entry are joined to it; the
rest are ranked against every entry, LABELLED entries at a time.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import log, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from griddoc.operators.packed import is_nothing, stripped, unpack
from griddoc.session import checkpointed, small

#: Entries that a worker holds at once; a longer reference list is ranked in several passes, of which the best counts.
LABELLED = 20_000
#: Share of the name and of the entry, by weight, that must be explained.
OF_NAME, OF_ENTRY = 0.74, 0.5
#: Words that name no quantity, words of little weight, and abbreviations that are no part of their word.
NOISE = {"max", "min", "maximum", "minimum", "nominal", "nom", "rated", "typ", "typical", "measured", "value", "range", "see", "note", "approx", "actual"}
SMALL_WORDS = {"of", "in", "at", "to", "the", "a", "an", "for", "and", "or", "on", "per", "by", "with"}
SHORT = {"xfmr": "transformer", "trafo": "transformer", "tx": "transformer", "trf": "transformer", "qty": "quantity", "no": "number", "wt": "weight", "pwr": "power"}


def tokens(name: str | None) -> list[str]:
    """Lower-case words of a name; written-together words are parted at capitals, lone figures dropped."""
    if not name:
        return []
    t = re.sub(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ][a-zäöüß])", " ", name)
    t = re.sub(r"\b\d+\)|[-–]\s*see note\b", " ", t, flags=re.I)
    return [w for w in re.findall(r"[^\W_]+", t.lower()) if not w.isdigit()]


def drops(word: str, n: int) -> set[str]:
    """The word with up to n letters dropped."""
    out = {word}
    for _ in range(n):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def reach(word: str) -> int:
    """Edits within which a word may be mended."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) between a and b, most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


@lru_cache(100_000)
def shortens(short: str, word: str) -> bool:
    """Whether short abbreviates word: a beginning of it, or its letters in order from the first one, ending late."""
    if short == word or len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return len(short) >= 3 or len(word) >= 6
    it = iter(word)
    return len(word) >= 5 and all(c in it for c in short) and len(short) >= 3 and not any(c in "aeiou" and c != short[0] for c in short[1:-1] if len(short) < 4)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(names: pd.Series) -> pd.Series:
    return names.map(tokens)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _drops(words: pd.Series) -> pd.Series:
    return words.map(lambda w: sorted(drops(w, reach(w)) | (drops(w, 2) if len(w) == 5 else set())))


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y, 2) for x, y in zip(a, b)], dtype="int32")


def repairs(words: DataFrame, known: DataFrame) -> DataFrame:
    """(token, repaired) of tokens to be replaced. words: token, n; known: token - the words of the reference list."""
    k = small(known.withColumn("known", F.lit(True)))
    all_words = known.select("token", F.lit(0).cast("long").alias("n")).unionByName(words.select("token", "n")).groupBy("token").agg(F.sum("n").alias("n"))
    all_words = checkpointed(all_words.join(k, "token", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    keyed = all_words.where(F.length("token") >= 3).withColumn("key", F.explode(_drops("token")))
    # Of the words under one key only those that could be the common one of a pair are looked up.
    rare = keyed.where("not known").select(F.col("token"), F.col("n"), "key")
    common = keyed.where("known or n >= 3").select(F.col("token").alias("c"), F.col("n").alias("cn"), F.col("known").alias("ck"), "key")
    weight = F.col("cn") + F.when(F.col("ck"), 3).otherwise(0)
    enough = F.when(F.col("ck") | (F.col("n") <= 2), weight >= 3 * F.col("n")).otherwise(weight >= 8 * F.col("n"))
    figures = [F.regexp_replace(c, "[^0-9]+", "") for c in ("token", "c")]
    pairs = rare.join(common, "key").where((F.col("token") != F.col("c")) & (figures[0] == figures[1]) & enough).select("token", "c", "cn", "ck").distinct()
    size = F.length("token")
    allowed = F.when(size < 4, 0).when(size < 6, 1).otherwise(2)
    near = pairs.withColumn("d", _distance("token", "c")).where(F.col("d") <= allowed)
    noise = F.col("c").isin(sorted(NOISE))
    best = W.partitionBy("token").orderBy("d", noise, F.col("ck").desc(), F.col("cn").desc(), "c")
    return near.withColumn("r", F.row_number().over(best)).where("r = 1").select("token", F.col("c").alias("repaired"))


#: Orders of a name equal to an entry and of one without any; between them lie scores, above zero, and near strings, below.
EQUAL, NONE = 1e9, -1e9


def forms(name: list[str]) -> list[str]:
    """The strings under which a name may equal an entry, best first: as it is, and each rotation without noise."""
    ws = [w for w in name if w not in NOISE] or name
    return list(dict.fromkeys("".join(f) for f in (name, *(ws[k:] + ws[:k] for k in range(len(ws))))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _forms(names: pd.Series) -> pd.Series:
    return names.map(lambda ws: forms(list(ws)))


class Ranker:
    """Soft TF-IDF over the entries (metric_id, tokens), which may be a part of the list.

    df: in how many metrics' entries each word of the whole list stands, and metrics: how many metrics it has; both are counted among
    the entries if not given.
    """

    def __init__(self, entries: list[tuple[str, list[str]]], df: dict[str, int] | None = None, metrics: int = 0):
        self.entries = [(m, [w for w in ws if w not in NOISE] or ws) for m, ws in entries if ws]
        if df is None:
            metrics = len({m for m, _ in self.entries})
            df = Counter(w for w, _ in {(w, m) for m, ws in self.entries for w in ws})
        self.most = log(1 + metrics)
        self.idf = {w: (0.15 if w in SMALL_WORDS else 1.0) * log(1 + metrics / n) for w, n in df.items()}
        self.by_word: dict[str, list[int]] = defaultdict(list)
        self.by_first: dict[str, list[str]] = defaultdict(list)
        for i, (_, ws) in enumerate(self.entries):
            for w in set(ws):
                self.by_word[w].append(i)
        for w in self.idf:
            self.by_first[w[0]].append(w)
        self.joined: dict[str, str] = {}
        self.grams: dict[str, set[str]] = defaultdict(set)
        for m, ws in self.entries:
            j = "".join(ws)
            self.joined.setdefault(j, m)
            for g in {j[k : k + 3] for k in range(len(j) - 2)}:
                self.grams[g].add(j)

    @lru_cache(50_000)
    def near(self, word: str) -> tuple[tuple[str, float], ...]:
        """Words of the entries that the token may stand for."""
        found = [(word, 1.0)] if word in self.idf else []
        if word in SHORT:
            found.append((SHORT[word], 0.95))
        found += [(w, 0.93) for w in self.by_first.get(word[0], ()) if shortens(word, w)]
        return tuple(found or [(w, 0.9) for w in self.by_first.get(word[0], ()) if reach(word) and distance(word, w, 1) <= 1])

    @lru_cache(50_000)
    def parts(self, word: str) -> tuple[str, ...]:
        """A word run together from words of the entries, the last perhaps abbreviated; itself if it is no such word."""
        if len(word) < 7 or word in self.idf:
            return (word,)
        best: list[tuple[str, ...] | None] = [(), *[None] * len(word)]
        for end in range(2, len(word) + 1):
            for start in range(max(0, end - 16), end - 1):
                piece = word[start:end]
                if best[start] is not None and (piece in self.idf or end == len(word) and start and len(piece) > 2 and any(shortens(piece, w) for w in self.by_first.get(piece[0], ()))):
                    if best[end] is None or len(best[start]) + 1 < len(best[end]):
                        best[end] = (*best[start], piece)
        return best[-1] or (word,)

    def _as_string(self, ws: list[str]) -> tuple[str, int] | None:
        """The metric of the entry that equals the name as a string, or nearly so, and how far it is: rotation first, then edits."""
        most = min(3, sum(map(len, ws)) // 7)
        if not most or len(ws) > 3:
            return None
        for k in range(len(ws)):
            if (m := self._near_string("".join(ws[k:] + ws[:k]), most)) is not None:
                return m[0], 10 * k + m[1]
        return None

    def _near_string(self, j: str, most: int) -> tuple[str, int] | None:
        hits = Counter(x for k in range(len(j) - 2) for x in self.grams.get(j[k : k + 3], ()))
        # An edit touches at most four of the name's trigrams (a swap of neighbours does), so no entry within reach has fewer.
        fewest = len(j) - 2 - 4 * most
        close = sorted((d, x) for x, n in hits.items() if n >= fewest and abs(len(j) - len(x)) <= most and (d := distance(j, x, most)) <= most)
        return (self.joined[close[0][1]], close[0][0]) if close else None

    def rank(self, name: list[str]) -> tuple[str, float]:
        """(metric_id, score), metric_id empty if no entry fits."""
        return self.ranked(name)[:2]

    def ranked(self, name: list[str]) -> tuple[str, float, float]:
        """(metric_id, score, order): of several parts of the list, the one of greatest order decides."""
        ws = [w for w in name if w not in NOISE] or name
        if not ws:
            return "", 0.0, NONE
        # "Temperature, Top Oil" is the same name as "Top Oil Temperature", and "hots-pot" as "hot spot".
        for k, form in enumerate(forms(name)):
            if (m := self.joined.get(form)) is not None:
                return m, 1.0, EQUAL - k
        ws = [x for w in ws for x in self.parts(w)]
        near = [self.near(w) for w in ws]
        weight = [max((self.idf[v] for v, _ in n if v in self.idf), default=self.most) if n else (0.1 if w in SMALL_WORDS else self.most) for w, n in zip(ws, near)]
        hits: dict[int, dict[str, tuple[float, int]]] = defaultdict(dict)
        for k, n in enumerate(near):
            for v, s in n:
                for e in self.by_word.get(v, ()):
                    if s > hits[e].get(v, (0.0, 0))[0]:
                        hits[e][v] = s, k
        best = ("", 0.0)
        of_name = sum(weight)
        for e, got in hits.items():
            m, entry = self.entries[e]
            total = sum(self.idf[v] for v in set(entry))
            used: dict[int, float] = {}
            for v, (s, k) in got.items():
                used[k] = max(used.get(k, 0.0), s * weight[k])
            mine = sum(used.values()) / of_name
            its = sum(s * self.idf[v] for v, (s, _) in got.items()) / total
            if mine >= OF_NAME and its >= OF_ENTRY and (score := sqrt(mine * its)) > best[1]:
                best = m, score
        if not best[0] and len(ws) <= 3 and (m := self._as_string(ws)) is not None:
            return m[0], 0.7, -float(m[1])
        return *best, best[1] if best[0] else NONE


def entries(metrics: DataFrame, mapped: DataFrame) -> DataFrame:
    """(metric_id, name, labelled, n): standard names, synonyms and names mapped by hand, each once, and how often it is given."""
    named = metrics.select("metric_id", F.col("standard_name").alias("name"), F.lit(False).alias("labelled"))
    packed = unpack(metrics, "row_ord", "synonyms").join(metrics.select("row_ord", "metric_id"), "row_ord").select("metric_id", F.col("val").alias("name"), F.lit(False).alias("labelled"))
    hand = mapped.where(~is_nothing(F.col("raw_term")) & ~is_nothing(F.col("metric_id")))
    hand = hand.select(stripped(F.col("metric_id")).alias("metric_id"), F.col("raw_term").alias("name"), F.lit(True).alias("labelled"))
    return named.unionByName(packed).unionByName(hand).groupBy("metric_id", "name", "labelled").agg(F.count(F.lit(1)).alias("n"))


def map_names(names: DataFrame, metrics: DataFrame, mapped: DataFrame) -> DataFrame:
    """(name, metric_id, score) of each distinct name; metric_id is empty where no metric is meant."""
    listed = checkpointed(entries(metrics, mapped).withColumn("ws", _tokens("name")))
    typed = checkpointed(names.select("name").where(F.col("name").isNotNull()).distinct().withColumn("ws", _tokens("name")))
    known = listed.where("not labelled").select(F.explode("ws").alias("token")).distinct()
    every = typed.select(F.explode("ws").alias("token"), F.lit(1).cast("long").alias("n")).unionByName(listed.where("labelled").select(F.explode("ws").alias("token"), "n"))
    words = every.groupBy("token").agg(F.sum("n").alias("n"))
    mend = checkpointed(repairs(words, known))

    def mended(rows: DataFrame, by: list[str]) -> DataFrame:
        one = rows.select(*by, F.posexplode("ws").alias("pos", "token")).join(small(mend), "token", "left")
        word = F.coalesce("repaired", "token")
        return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))), lambda x: x["w"]).alias("ws"))

    # A name given to several metrics by hand counts for the one it has most often; the dictionary comes before.
    votes = mended(listed, ["metric_id", "name", "labelled", "n"]).groupBy("ws", "metric_id").agg(F.sum(F.col("n") + F.when(F.col("labelled"), 0).otherwise(1_000_000)).alias("n"))
    strong = F.filter("ws", lambda w: ~w.isin(sorted(NOISE)))
    chosen = votes.groupBy("ws").agg(F.min_by("metric_id", F.struct(-F.col("n"), F.col("metric_id"))).alias("metric_id"))
    chosen = checkpointed(chosen.withColumn("core", F.when(F.size(strong) > 0, strong).otherwise(F.col("ws"))))
    # Names equal to an entry, whatever the length of the list.
    equal = chosen.groupBy(F.array_join("core", "").alias("form")).agg(F.min_by("metric_id", F.struct("metric_id", "ws")).alias("metric_id"))
    asked = checkpointed(mended(typed, ["name"]))
    same = asked.select("name", F.posexplode(_forms("ws")).alias("k", "form")).join(small(equal), "form").groupBy("name").agg(F.min_by("metric_id", "k").alias("metric_id"))
    same = checkpointed(same.withColumn("score", F.lit(1.0)))
    rest = checkpointed(asked.join(same, "name", "left_anti"))
    # The others, against the whole list in parts of LABELLED entries; the words' weights are those of the whole list.
    df = {r["w"]: r["n"] for r in chosen.select("metric_id", F.explode("core").alias("w")).groupBy("w").agg(F.count_distinct("metric_id").alias("n")).collect()}
    total = chosen.agg(F.count_distinct("metric_id").alias("n")).first()["n"]
    weights = names.sparkSession.sparkContext.broadcast((df, total))
    found, last = [], None
    while part := _part(chosen, last):
        last = part[-1]
        found.append(_ranked(rest, weights, part, len(found)))
    if not found:
        return same.unionByName(rest.select("name", F.lit("").alias("metric_id"), F.lit(0.0).alias("score")))
    if len(found) == 1:
        return same.unionByName(found[0].select("name", "metric_id", "score"))
    by = F.struct("rank", -F.col("part"))
    best = reduce(DataFrame.unionByName, map(checkpointed, found)).groupBy("name").agg(F.max_by(F.struct("metric_id", "score"), by).alias("b"))
    return same.unionByName(best.select("name", "b.metric_id", "b.score"))


def _part(chosen: DataFrame, after: tuple[str, list[str]] | None) -> list[tuple[str, list[str]]]:
    """The next LABELLED entries (metric_id, tokens) in their order."""
    key = F.struct("metric_id", "ws")
    rows = chosen if after is None else chosen.where(key > F.struct(F.lit(after[0]).alias("metric_id"), F.array(*map(F.lit, after[1])).alias("ws")))
    return [(r["metric_id"], list(r["ws"])) for r in rows.orderBy("metric_id", "ws").limit(LABELLED).select("metric_id", "ws").collect()]


def _ranked(rest: DataFrame, weights, part: list[tuple[str, list[str]]], number: int) -> DataFrame:
    """(name, metric_id, score, rank, part) of each name among one part of the entries."""
    shared = rest.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(shared.value, *weights.value)
        for b in batches:
            ranked = [ranker.ranked(ws) for ws in b.column(1).to_pylist()]
            columns = [pa.array([x[k] for x in ranked], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array([number] * len(ranked), pa.int32())], ["name", "metric_id", "score", "rank", "part"])

    return rest.select("name", "ws").mapInArrow(run, "name string, metric_id string, score double, rank double, part int")


def match(mapping: DataFrame, unmapped: DataFrame, metrics: DataFrame) -> DataFrame:
    """(tab, row_ord, metric_id) of every unmapped row; metric_id is the empty string if no metric is meant.

    synonym_mapping rows without a name or with a metric have no row. Of a parameter's two names the better explained one
    decides; a row without any name gets the empty string. Repeated rows each have a row, empty tables none.
    """
    a = mapping.where(~is_nothing(F.col("raw_term")) & (F.col("metric_id").isNull() | (stripped(F.col("metric_id")) == "")))
    a = a.select(F.lit("synonym_mapping").alias("tab"), "row_ord", F.array(F.col("raw_term")).alias("names"))
    b = unmapped.select(F.lit("unmapped_parameter").alias("tab"), "row_ord", F.array(*(F.when(~is_nothing(F.col(c)), F.col(c)) for c in ("proposed_metric_name", "parameter_name"))).alias("names"))
    one = checkpointed(a.unionByName(b).select("tab", "row_ord", F.explode("names").alias("name")))
    found = map_names(one, metrics, mapping)
    best = F.max_by(F.coalesce("metric_id", F.lit("")), F.struct(F.coalesce("score", F.lit(-1.0)).alias("s"), F.col("metric_id")))
    return one.join(found, "name", "left").groupBy("tab", "row_ord").agg(best.alias("metric_id")).select("tab", "row_ord", "metric_id")
