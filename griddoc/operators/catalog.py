"""Look-ups between controlled tables, and between these and texts.

List cells become rows before they are joined, so membership is an equi-join; "first" always names its order; containment of
many terms in many texts is one automaton pass, never a join of all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from griddoc.operators.match import contained
from griddoc.operators.packed import is_nothing, unpack
from griddoc.operators.tables import first_per_key
from griddoc.session import checkpointed, small

#: Words of metric names that tell no template apart.
GENERIC = ["count", "number", "level", "type", "value", "rating", "class", "list", "point", "points"]
#: Weight of a requirement by its type, and rank of a product by its status.
WEIGHTS = {"Must-have": 3.0, "Preferred": 1.0, "Quantity Basis": 1.0, "Reference": 0.5}
STATUS = {"verified": 0, "candidate": 1}


def members(rows: DataFrame, key: str, cell: str, to: str, ids: bool = True) -> DataFrame:
    """(key, to, pos): one row for each member of a list cell, once per row."""
    one = unpack(rows, key, cell, ids).select(F.col(key), F.col("val").alias(to), "pos")
    return one.groupBy(key, to).agg(F.min("pos").alias("pos"))


def of_member(rows: DataFrame, order: str, cell: str, to: str, columns: list[str]) -> DataFrame:
    """(to, order, columns): the rows that list a member, in their order."""
    return members(rows, order, cell, to).join(rows.select(order, *columns), order).select(to, order, *columns)


def first_of_member(rows: DataFrame, order: str, cell: str, to: str, column: str) -> DataFrame:
    """(to, column): the value of the first row that lists a member."""
    return of_member(rows, order, cell, to, [column]).groupBy(to).agg(F.min_by(column, order).alias(column))


def candidates(families: DataFrame, products: DataFrame, most: int = 14) -> DataFrame:
    """(scenario_id, product_id, rank): products of the families that list a scenario, each once, in the order of families and products.

    families: row_ord, family_id, applicable_scenarios; products: row_ord, product_id, family_id.
    """
    f = of_member(families.select("row_ord", "family_id", "applicable_scenarios"), "row_ord", "applicable_scenarios", "scenario_id", ["family_id"])
    f = f.groupBy("scenario_id", "family_id").agg(F.min("row_ord").alias("f"))
    p = products.groupBy("family_id", "product_id").agg(F.min("row_ord").alias("p"))
    one = f.join(p, "family_id").groupBy("scenario_id", "product_id").agg(F.min(F.struct("f", "p")).alias("at"))
    rank = F.row_number().over(W.partitionBy("scenario_id").orderBy("at", "product_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select("scenario_id", "product_id", "rank")


def own_or_inherited(rows: DataFrame, order: str, cell: str, parents: DataFrame, link: str, parent_order: str, to: str) -> DataFrame:
    """(order, to): members of each row's own list, or, where that is empty, of its first parent's (joined on link)."""
    own = members(rows, order, cell, to).select(order, to)
    bare = rows.where(is_nothing(F.col(cell))).select(order, link)
    first = first_per_key(parents.select(link, parent_order, cell), [link], [parent_order])
    inherited = bare.join(members(first, parent_order, cell, to).join(first.select(parent_order, link), parent_order).select(link, to), link).select(order, to)
    return own.unionByName(inherited)


def coalesced_lookup(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """rows with column from first, joined on its other column, else from second; both have one row per key."""
    f, s = (x.withColumnRenamed(column, f"_{n}") for n, x in (("f", first), ("s", second)))
    on = lambda x: next(c for c in x.columns if c not in ("_f", "_s"))
    blank = lambda c: F.when(~is_nothing(F.col(c)), F.col(c))
    return rows.join(f, on(f), "left").join(s, on(s), "left").select(key, F.coalesce(blank("_f"), blank("_s")).alias(column))


def first_containing(rows: DataFrame, within: list[str], order: str, text: Column, terms: DataFrame) -> DataFrame:
    """(within, term_ord, order): the first row of each group whose text contains a term."""
    hits = contained(rows.select(order, text.alias("_text")), order, "_text", terms)
    return hits.join(rows.select(order, *within), order).groupBy(*within, "term_ord").agg(F.min(order).alias(order))


def best_template(templates: DataFrame, order: str, item: str, names: DataFrame) -> DataFrame:
    """(name_ord, order): for each name (name_ord, name) the first template whose item contains it or a telling word of it.

    Telling are words of more than three letters that GENERIC does not list.
    """
    words = F.filter(F.split(F.lower("name"), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(GENERIC))
    asked = names.select("name_ord", F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), words))).alias("term")).where("term <> ''")
    terms = asked.select("term").distinct().withColumn("term_ord", F.xxhash64("term"))
    first = contained(templates.select(order, item), order, item, terms).groupBy("term_ord").agg(F.min(order).alias(order))
    return asked.join(first.join(terms, "term_ord"), "term").groupBy("name_ord").agg(F.min(order).alias(order))


def relevant_metrics(synonyms: DataFrame, interest: DataFrame, metrics: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(scenario_id, metric_id, rank): metrics of each scenario in order: those its synonyms map, its count metric, those named in its text.

    synonyms: row_ord, scenario_id, metric_id; counted: scenario_id, metric_id; interest: scenario_id, text; metrics: row_ord,
    metric_id, standard_name. A metric that comes in several ways has its first place.
    """
    filled = lambda d: d.where(~is_nothing(F.col("scenario_id")) & ~is_nothing(F.col("metric_id")))
    place = lambda way, at: F.struct(F.lit(way).alias("way"), at.cast("long").alias("at")).alias("p")
    ways = [filled(synonyms).select("scenario_id", "metric_id", place(0, F.col("row_ord")))]
    if counted is not None:
        ways.append(filled(counted).select("scenario_id", "metric_id", place(1, F.lit(0))))
    named = contained(interest.where(~is_nothing(F.col("scenario_id"))), "scenario_id", "text", metrics.select(F.col("row_ord").alias("term_ord"), F.col("standard_name").alias("term")))
    ways.append(named.join(metrics.select(F.col("row_ord").alias("term_ord"), "metric_id"), "term_ord").select("scenario_id", "metric_id", place(2, F.col("term_ord"))))
    every = ways[0]
    for w in ways[1:]:
        every = every.unionByName(w)
    one = every.groupBy("scenario_id", "metric_id").agg(F.min("p").alias("p"))
    return one.select("scenario_id", "metric_id", F.row_number().over(W.partitionBy("scenario_id").orderBy("p")).alias("rank"))


def requirement_type(metric_id: Column, required: Column, counts: list[str], always: list[str]) -> Column:
    """Kind of requirement that a metric makes: counts, those that are always needed, else what its cell says."""
    r = F.lower(F.coalesce(required, F.lit("")))
    return F.when(metric_id.isin(counts), "Quantity Basis").when(metric_id.isin(always) | F.contains(r, F.lit("yes")), "Must-have").when(F.contains(r, F.lit("preferred")), "Preferred").otherwise("Reference")


def fit(requirements: DataFrame, parameters: DataFrame, verdict: Column) -> DataFrame:
    """(product_id, requirement_id, verdict): how each product that states a required metric meets it.

    A range join: requirements (requirement_id, metric_id, value) meet the parameters of their metric, and verdict, a column over
    both, tells whether the value lies within. Of several parameters of a metric the best verdict counts.
    """
    p = parameters.select("product_id", "metric_id", "min_value", "max_value", "supported_value").distinct()
    j = p.join(small(checkpointed(requirements)), "metric_id")
    order = F.when(verdict == "pass", 0).when(verdict == "unknown", 1).otherwise(2)
    best = j.groupBy("product_id", "requirement_id").agg(F.min(order).alias("v"))
    return best.select("product_id", "requirement_id", F.element_at(F.array(*map(F.lit, ("pass", "unknown", "fail"))), F.col("v") + 1).alias("verdict"))


def best_products(products: DataFrame, fits: DataFrame, requirements: DataFrame, within: list[str]) -> DataFrame:
    """The best product of each group: none that fails a must-have first, then by status, then by points, then as listed.

    products: row_ord, product_id, status; fits as fit() gives them; requirements: requirement_id, kind, value.
    """
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    w = F.coalesce(F.element_at(weight, F.col("kind")), F.lit(0.5))
    points = F.when(F.col("verdict") == "pass", w).when(F.col("verdict") == "fail", -1.5 * w).otherwise(0.0)
    scored = fits.join(small(checkpointed(requirements.select("requirement_id", "kind"))), "requirement_id").groupBy("product_id").agg(
        F.sum(points).alias("points"), F.max((F.col("verdict") == "fail") & (F.col("kind") == "Must-have")).alias("violated")
    )
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), status), F.lit(2))
    one = products.join(scored, "product_id", "left").withColumns({"points": F.round(F.coalesce("points", F.lit(0.0)) + F.when(status == "verified", 0.5).otherwise(0.0), 2), "violated": F.coalesce("violated", F.lit(False)), "_status": rank})
    return first_per_key(one, within, ["violated", "_status", F.col("points").desc(), "row_ord"]).drop("_status")


def merge_scoped(rules: DataFrame, refined: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of a full outer merge: key, confidence (refined before rules), origin; what refined calls out of scope is dropped.

    rules: key, confidence; refined: key, confidence, in_scope.
    """
    r = refined.select(F.col(key).alias("_k"), F.col("confidence").alias("_c"), "in_scope")
    j = rules.join(r, F.col(key) == F.col("_k"), "full_outer")
    origin = F.when(F.col("_k").isNull(), "rules").when(F.col(key).isNull(), "refined").otherwise("both")
    every = j.select(F.coalesce(key, "_k").alias(key), F.coalesce("_c", "confidence").alias("confidence"), origin.alias("origin"), F.coalesce("in_scope", F.lit(True)).alias("in_scope"))
    return every.where("in_scope").drop("in_scope"), every.where("not in_scope").drop("in_scope")


def of_documents(rows: DataFrame, kinds: DataFrame, wanted: str) -> DataFrame:
    """rows of documents of the wanted kind, or all rows where no document is of that kind. rows: file_name; kinds: file_name, doc_type."""
    of_kind = kinds.where(F.col("doc_type") == wanted).select("file_name").distinct()
    return rows.join(of_kind, "file_name", "left_semi") if of_kind.limit(1).count() else rows


def rollup(rows: DataFrame, group: Column, order: str, share: tuple[str, str]) -> DataFrame:
    """(name, n, part, whole, ratio, first): sums of two columns by group and the ratio of the sums; blank groups are "Unassigned"; first tells the order in which they were seen."""
    name = F.when(is_nothing(group), "Unassigned").otherwise(F.trim(group))
    part, whole = (F.sum(c).alias(n) for c, n in zip(share, ("part", "whole")))
    g = rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), part, whole, F.min(order).alias("first"))
    ratio = F.when(F.col("whole") > 0, F.col("part") / F.col("whole")).otherwise(0.0)
    return g.select("name", "n", "part", "whole", ratio.alias("ratio"), "first")
