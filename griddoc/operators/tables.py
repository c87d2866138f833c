"""Maintenance of keyed tables whose rows have an order: merges, overlays, firsts and lasts.

Every "first" is explicit: rows carry an order column and ties end with it. Keys that are null are a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from griddoc.functions.text import normal_key


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return cond


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. Partial sorts per key; Spark keeps one row per key before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def last_value_first_place(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's last row in the place of its first: what writing rows into an ordered dictionary leaves."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    g = rows.groupBy(*keys).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), F.col(order)).alias("_v"))
    return g.select(*keys, order, "_v.*")


def upsert(old: DataFrame, new: DataFrame, key: Column, keep: list[str], order: str) -> DataFrame:
    """new wins over old where key, taken of both, is equal, but old's columns in keep stay; other rows of both are kept.

    Of several new rows of one key the last counts.
    """
    n = first_per_key(new.withColumn("_k", key), ["_k"], [F.col(order).desc()]).alias("n")
    o = old.withColumn("_k", key).alias("o")
    both = o.join(n, F.col("o._k").eqNullSafe(F.col("n._k")), "full_outer")
    has_new, has_old = F.col(f"n.{order}").isNotNull(), F.col(f"o.{order}").isNotNull()
    pick = [F.when(has_old & (F.lit(c in keep) | ~has_new), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns]
    return both.select(*pick)


def replace_by_key(old: DataFrame, new: DataFrame, key: str, identity: list[str], order: list) -> DataFrame:
    """All rows of old but those of keys that new touches, and new without repeated rows (equal in identity; the first counts)."""
    kept = old.alias("a").join(new.select(key).distinct().alias("b"), _same(old, new, [key]), "left_anti")
    return kept.unionByName(first_per_key(new, identity, order))


def insert_if_absent(old: DataFrame, new: DataFrame, key: Column, order: str) -> DataFrame:
    """old and those rows of new, the first of each key, whose key old has not."""
    n = first_per_key(new.withColumn("_k", key), ["_k"], [order]).alias("b")
    added = n.join(old.select(key.alias("_k")).distinct().alias("a"), F.col("a._k").eqNullSafe(F.col("b._k")), "left_anti").drop("_k")
    return old.unionByName(added)


def union_aligned(master: DataFrame, rows: DataFrame) -> DataFrame:
    """rows under the columns of master: by name, missing ones null, further ones dropped."""
    return master.unionByName(rows.select(*(c for c in rows.columns if c in master.columns)), allowMissingColumns=True)


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of first, and the rows of second whose keys first has not."""
    return first.unionByName(second.alias("a").join(first.select(*keys).distinct().alias("b"), _same(second, first, keys), "left_anti"))


def fill_missing(rows: DataFrame, other: DataFrame, keys: list[str], fill: str, best: str) -> DataFrame:
    """Full outer merge on keys: fill from other where rows has none or an empty one, the greater of best; other's new keys are added."""
    a, b = rows.alias("a"), other.alias("b")
    j = a.join(b, _same(rows, other, keys), "full_outer")
    key = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    mine = F.col(f"a.{fill}")
    return j.select(*key, F.when(mine.isNotNull() & (mine != ""), mine).otherwise(F.col(f"b.{fill}")).alias(fill), F.greatest(F.col(f"a.{best}"), F.col(f"b.{best}")).alias(best))


def overlay(rows: DataFrame, edits: DataFrame, key: str, columns: list[str], deleted: str = "deleted") -> DataFrame:
    """rows with the non-empty cells of their edit, without those the edit deletes. edits has one row per key."""
    e = edits.select(key, deleted, *(F.col(c).alias(f"_{c}") for c in columns))
    j = rows.join(e, key, "left").where(~F.coalesce(F.col(deleted), F.lit(False)))
    changed = {c: F.when(F.col(f"_{c}").isNotNull() & (F.col(f"_{c}").cast("string") != ""), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return j.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns))


def numbered_suffix(rows: DataFrame, within: list[str], name: str, order: str) -> DataFrame:
    """name made unique within a group: the second gets _2, the third _3."""
    n = F.row_number().over(W.partitionBy(*within, name).orderBy(order))
    return rows.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string"))))


def carried(rows: DataFrame, within: list[str], column: str, order: str, to: str) -> DataFrame:
    """The last value of column so far, carried forward over rows without one."""
    w = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(to, F.last(column, ignorenulls=True).over(w))


def distinct_by_hash(rows: DataFrame, digest: Column, order: list) -> DataFrame:
    """One row per content hash, the first; rows without a hash all stay."""
    d = rows.withColumn("_h", digest)
    with_hash = first_per_key(d.where("_h is not null and _h <> ''"), ["_h"], order)
    return with_hash.unionByName(d.where("_h is null or _h = ''")).drop("_h")


def first_seen_mode(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first seen."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value), F.max("n").alias("n"))


def latest(rows: DataFrame, keys: list[str], at: Column, most: int, within: list[str]) -> DataFrame:
    """A history: one row per key, the newest, and of these the most newest within a group."""
    one = first_per_key(rows.withColumn("_t", at), [*within, *keys], [F.col("_t").desc()])
    return one.withColumn("_r", F.row_number().over(W.partitionBy(*within).orderBy(F.col("_t").desc(), *keys))).where(F.col("_r") <= most).drop("_r", "_t")


def appended_value(column: Column, value: Column) -> Column:
    """The list with the value added at its end, unless it is there."""
    return F.when(F.array_contains(column, value), column).otherwise(F.concat(F.coalesce(column, F.array().cast("array<string>")), F.array(value)))


def noted_once(notes: Column, note: str) -> Column:
    """The notes with the note added, unless they hold it."""
    have = F.coalesce(notes, F.lit(""))
    return F.when(F.contains(have, F.lit(note)), have).when(have == "", F.lit(note)).otherwise(F.concat(have, F.lit(" "), F.lit(note)))


def to_canonical(rows: DataFrame, name: str, synonyms: DataFrame) -> DataFrame:
    """Inner join of rows to (synonym, canonical) on the squeezed, lower-case name."""
    s = synonyms.select(normal_key(F.col("synonym")).alias("_k"), "canonical").distinct()
    return rows.withColumn("_k", normal_key(F.col(name))).join(s, "_k").drop("_k")


def difference(a: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct rows of a that none of the others has."""
    out = a.distinct()
    for o in others:
        out = out.subtract(o)
    return out


def status_pivot(rows: DataFrame, kind: str, status: str, values: list[str]) -> DataFrame:
    """Counts of each kind by status, and in all."""
    counts = [F.count_if(F.col(status) == v).alias(v.lower()) for v in values]
    return rows.groupBy(kind).agg(*counts, F.count(F.lit(1)).alias("total"))


def ranked_urls(rows: DataFrame, within: list[str], url: str, domain: Column, most: int = 4) -> DataFrame:
    """The best distinct URLs of each group: one point for the domain, half a point for a datasheet or product page."""
    u = F.lower(F.col(url))
    score = F.when(F.contains(u, domain), F.lit("1.0").cast("decimal(3,1)")).otherwise(F.lit("0").cast("decimal(3,1)")) + F.when(u.rlike("pdf|datasheet|product"), F.lit("0.5").cast("decimal(3,1)")).otherwise(F.lit("0").cast("decimal(3,1)"))
    one = rows.where(F.col(url).isNotNull() & (F.col(url) != "")).select(*within, url, score.alias("score")).distinct()
    w = W.partitionBy(*within).orderBy(F.col("score").desc(), url)
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
