"""Assets named on drawings, counted from their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from griddoc.functions import text as X
from griddoc.operators.tables import first_seen_mode
from griddoc.session import checkpointed

#: Asset type of each kind of label, labels of feeders, and the bay labels that are no feeder bays.
TYPES = {"breaker": "Circuit Breaker", "transformer": "Power Transformer", "bus": "Bus", "coupling": "PCC"}
FEEDER = r"\b[HFLDJK]\d{2,3}\b"
GENERAL_BAYS = ["=C00", "=C01", "=C02"]
OUT_OF_SCOPE = ["Future", "Provision"]
_ANY_LABEL = "(?i)" + "|".join(X.TAGS[k].removeprefix("(?i)") for k in TYPES)


def _commonest(values):
    """The most frequent value of a list, of equals the first; null for an empty one."""
    each = F.transform(F.array_distinct(values), lambda x: F.named_struct(F.lit("n"), F.size(F.filter(values, lambda y: y == x)), F.lit("p"), -F.array_position(values, x), F.lit("v"), x))
    return F.array_max(each)["v"]


def labelled(segments: DataFrame) -> DataFrame:
    """(file_name, asset_type, status, kv, area, quantity, tags): labels of each drawing by type, scope and voltage.

    A label's scope and voltage come from the first segment that shows it; without a voltage there, from the drawing. Feeders
    count only in segments that name a voltage. segments: file_name, seg_id, seg_ord, text. Each text is read once.
    """
    none = F.array().cast("array<struct<asset_type:string,tag:string>>")
    text = F.col("text")
    typed = lambda tags, t: F.transform(tags, lambda x: F.named_struct(F.lit("asset_type"), F.lit(t), F.lit("tag"), x))
    kinds = F.flatten(F.array(*(typed(X.labels(text, k), t) for k, t in TYPES.items())))
    feeders = typed(F.array_distinct(F.regexp_extract_all(text, F.lit(FEEDER), F.lit(0))), "Feeder")
    tagged, charged = text.rlike(_ANY_LABEL), F.contains(F.lower("text"), F.lit("kv"))
    rows = segments.where(tagged | charged).select("file_name", "seg_ord", "seg_id", F.when(tagged | text.rlike(FEEDER), X.scope_status(text)).alias("status"), F.concat(F.when(tagged, kinds).otherwise(none), F.when(charged & text.rlike(X.VOLTAGE), feeders).otherwise(none)).alias("tags"), F.when(charged, X.voltages(text)).otherwise(F.array().cast("array<int>")).alias("kvs"))
    rows = checkpointed(rows.where("size(tags) > 0 or size(kvs) > 0"))
    tags = rows.withColumn("kv", _commonest(F.col("kvs"))).select("file_name", F.struct("seg_ord", "seg_id", "status", "kv").alias("at"), F.explode("tags").alias("x"))
    first = tags.groupBy("file_name", "x.asset_type", "x.tag").agg(F.min("at").alias("f"))
    kv = rows.select("file_name", "seg_ord", F.posexplode("kvs").alias("k", "kv")).withColumn("place", F.col("seg_ord").cast("long") * 100_000 + F.col("k"))
    whole = first_seen_mode(kv, ["file_name"], "kv", "place").select(F.col("file_name").alias("of"), F.col("kv").alias("whole"))
    placed = first.join(whole, F.col("file_name").eqNullSafe(F.col("of")), "left").select("file_name", "asset_type", "tag", "f.status", F.coalesce("f.kv", "whole").alias("kv"))
    placed = placed.withColumn("area", F.coalesce(F.concat(F.col("kv").cast("string"), F.lit("kV Area")), F.lit("")))
    return placed.groupBy("file_name", "asset_type", "status", "kv", "area").agg(F.count(F.lit(1)).alias("quantity"), F.array_join(F.array_sort(F.collect_set("tag")), "; ").alias("tags"))


def switchgear(segments: DataFrame) -> DataFrame:
    """(file_name, bays, sensors): distinct feeder-bay and discharge-sensor labels of drawings that name gas-insulated switchgear."""
    low = F.lower(F.coalesce("text", F.lit("")))
    bays = F.array_except(X.labels(F.col("text"), "bay"), F.array(*map(F.lit, GENERAL_BAYS)))
    one = segments.select("file_name", (F.contains(low, F.lit("gis")) | F.contains(low, F.lit("gas insulated"))).alias("gis"), bays.alias("b"), X.labels(F.col("text"), "discharge sensor").alias("s"))
    n = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    return one.groupBy("file_name").agg(F.max("gis").alias("gis"), n("b").alias("bays"), n("s").alias("sensors")).where("gis").drop("gis")


def stated_quantities(segments: DataFrame) -> DataFrame:
    """(file_name, seg_id, quantity): the largest number of each segment about gas-insulated switchgear, in documents with a table of sensor quantities."""
    low = F.lower(F.coalesce("text", F.lit("")))
    gate = F.max((F.contains(low, F.lit("sensor quantity")) | F.contains(low, F.lit("sensor qty"))).cast("int")).over(W.partitionBy("file_name"))
    numbers = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b\d{2,6}\b"), F.lit(0)), lambda x: x.cast("long"))
    rows = segments.select("file_name", "seg_id", low.alias("low"), F.array_max(numbers).alias("quantity"), gate.alias("gate"))
    return rows.where("gate = 1 and quantity is not null").where(F.contains("low", F.lit("gis"))).select("file_name", "seg_id", "quantity")


def counts(assets: DataFrame) -> DataFrame:
    """(file_name, asset_type, quantity): sums over what is in scope and not zero."""
    kept = assets.where(~F.coalesce("status", F.lit("")).isin(OUT_OF_SCOPE) & (F.col("quantity") != 0))
    return kept.groupBy("file_name", "asset_type").agg(F.sum("quantity").alias("quantity"))


def gases(segments: DataFrame) -> DataFrame:
    """(file_name, gases): gases named anywhere in a document, in fixed order; CO, O2 and N2 by formula alone only beside three others.

    All names and formulas are one alternation, so each text is read once; a name within another counts too.
    """
    parts = {x: (g, x in n.split("|")) for g, p, n, _ in X.GASES for x in (y.replace(r"\b", "") for y in p.split("|"))}
    every = "|".join(sorted((x if name else rf"\b{x}\b" for x, (_, name) in parts.items()), key=len, reverse=True))
    low = F.lower(F.coalesce("text", F.lit("")))
    seen = segments.select("file_name", F.explode_outer(F.array_distinct(F.regexp_extract_all(low, F.lit(every), F.lit(0)))).alias("x"))
    within = {x: [y for y, (_, name) in parts.items() if name and y in x] for x in parts}
    has = lambda words: F.coalesce(F.max(F.col("x").isin(words)), F.lit(False))
    shows = lambda g, names: sorted({x for x in parts for y in (x, *within[x]) if parts[y][0] == g and (parts[y][1] or not names)})
    flags = seen.groupBy("file_name").agg(*(has(shows(g, False)).alias(f"any_{g}") for g, *_ in X.GASES), *(has(shows(g, True)).alias(f"name_{g}") for g, *_ in X.GASES))
    strong = sum((F.col(f"any_{g}").cast("int") for g, _, _, a in X.GASES if not a), F.lit(0))
    shown = [F.when(F.col(f"any_{g}") & (F.lit(not a) | F.col(f"name_{g}") | (strong >= 3)), F.lit(g)) for g, _, _, a in X.GASES]
    return flags.select("file_name", F.array_compact(F.array(*shown)).alias("gases"))
