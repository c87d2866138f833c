"""Replies of a language model: asked for by a given function, parsed, and held against the controlled tables.

The model itself is outside; complete is any function from a prompt to a reply, and without one every reply is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from griddoc.functions.text import json_part
from griddoc.operators.match import locate_quotes

#: Confidence where a reply states none, and the length to which quotes are cut.
DEFAULT_CONFIDENCE, QUOTE = 0.6, 300
ITEM = "product_id string, family_id string, metric_id string, value string, unit string, requirement_type string, confidence string, evidence_quote string, rationale string, in_scope boolean"
REPLY = f"products array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>, requirements array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>"
#: Types and statuses of assets on drawings, and the mark of text read off an image.
ASSET_TYPES = ["Circuit Breaker", "Transformer", "GIS Bay", "Bus", "Feeder", "PCC", "Generator", "Motor", "Switchgear Panel", "PD Sensor", "Sensor", "Bushing", "Channel", "Measurement Point", "Reactor", "Transmission Line", "Cable", "Surge Arrester", "Instrument Transformer", "Tap Changer", "Capacitor Bank", "Cabinet", "Gas Compartment", "Gas Density Sensor", "Disconnector Switch", "Earthing Switch"]
STATUSES = ["New", "Existing", "Future", "Provision", "Unclear"]
READ_OFF = "[VLM OCR of embedded image]"
#: Kinds of requirement.
KINDS = ["Must-have", "Preferred", "Reference", "Quantity Basis"]


def ask(prompts: DataFrame, complete: Callable[[str], str] | None = None, at_once: int = 4) -> DataFrame:
    """prompts (chunk_id, prompt) with column reply; a call that fails gives an empty reply. Each task makes at_once calls at the same time."""

    def one(prompt: str) -> str:
        try:
            return complete(prompt) if complete else ""
        except Exception:  # noqa: BLE001
            return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                yield pd.DataFrame({"chunk_id": b["chunk_id"], "reply": list(pool.map(one, b["prompt"]))})

    return prompts.select("chunk_id", "prompt").mapInPandas(run, "chunk_id long, reply string")


def confidence(c: Column) -> Column:
    """A stated confidence held between 0 and 1."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), DEFAULT_CONFIDENCE).otherwise(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))


def validated(replies: DataFrame, part: str, products: DataFrame, families: DataFrame, metrics: DataFrame) -> DataFrame:
    """Items of the part 'products' or 'requirements' of each reply, with unknown ids blanked.

    A known product gives its family where none is stated. Items without any known id, and products said to be out of scope,
    are dropped. Invalid JSON gives no item.
    """
    parsed = replies.select("chunk_id", F.from_json(json_part(F.col("reply")), REPLY)[part].alias("items")).select("chunk_id", F.posexplode("items").alias("pos", "i"))
    clean = {c: F.trim(F.coalesce(F.col(f"i.{c}"), F.lit(""))).alias(c) for c in ("product_id", "family_id", "metric_id", "value", "unit", "requirement_type", "rationale")}
    rows = parsed.select("chunk_id", "pos", *clean.values(), confidence(F.col("i.confidence")).alias("confidence"), F.substring(F.trim(F.coalesce("i.evidence_quote", F.lit(""))), 1, QUOTE).alias("evidence_quote"), F.coalesce("i.in_scope", F.lit(True)).alias("in_scope"))
    p = products.select("product_id", F.col("family_id").alias("_pf")).dropDuplicates(["product_id"])
    j = rows.join(p.withColumn("_p", F.lit(True)), "product_id", "left")
    j = j.withColumn("family_id", F.when((F.col("family_id") == "") & F.col("_p"), F.col("_pf")).otherwise(F.col("family_id")))
    j = j.join(families.select("family_id", F.lit(True).alias("_f")).distinct(), "family_id", "left").join(metrics.select("metric_id", F.lit(True).alias("_m")).distinct(), "metric_id", "left")
    known = lambda c, f: F.when(F.col(f), F.col(c)).otherwise("").alias(c)
    kind = F.when(F.col("requirement_type").isin(KINDS), F.col("requirement_type")).otherwise("Reference").alias("requirement_type")
    out = j.select("chunk_id", "pos", known("product_id", "_p"), known("family_id", "_f"), known("metric_id", "_m"), "value", "unit", kind, "confidence", "evidence_quote", "rationale", "in_scope")
    if part == "products":
        return out.where("(product_id <> '' or family_id <> '') and in_scope").drop("in_scope", "metric_id", "value", "unit", "requirement_type")
    return out.where("product_id <> '' or family_id <> '' or metric_id <> ''").drop("in_scope")


def best_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Of items with equal keys (values in any case) the most confident, the first of equals."""
    by = [F.lower(F.trim(k)) if k == "value" else F.col(k) for k in keys]
    w = W.partitionBy(*by).orderBy(F.col("confidence").desc(), "chunk_id", "pos")
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def allowed(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items whose scenario and metric are one of pairs (scenario_id, metric_id)."""
    return items.join(pairs.select("scenario_id", "metric_id").distinct(), ["scenario_id", "metric_id"], "left_semi")


def located(replies: DataFrame, part: str, chunks: DataFrame, catalogue: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """The validated items of each document, the best of equal ones, with the segment that their quote stands in (null for none).

    replies: chunk_id, reply; chunks: chunk_id, file_name, seg_id, seg_ord, text - the segments that each chunk was made of.
    """
    items = validated(replies, part, *catalogue)
    of = items.join(chunks.select("chunk_id", "file_name").distinct(), "chunk_id")
    keys = [c for c in ("family_id", "product_id", "metric_id", "value") if c in of.columns]
    best = best_items(of, ["file_name", *keys]).withColumn("quote_id", F.xxhash64("file_name", *keys))
    quotes = best.select("quote_id", "file_name", F.col("evidence_quote").alias("quote"))
    return best.join(locate_quotes(quotes, chunks).select("quote_id", "seg_id"), "quote_id", "left").drop("quote_id")


def seen_assets(replies: DataFrame) -> DataFrame:
    """(chunk_id, pos, asset_tag, asset_type, voltage_level, drawing_area, status, quantity, confidence) of what a model saw on drawings.

    Unknown types are dropped, unknown statuses "Unclear", missing or invalid quantities 1; the confidence is 0.7.
    """
    schema = "assets array<struct<asset_tag:string,asset_type:string,voltage_level:string,drawing_area:string,status:string,quantity:string>>"
    rows = replies.select("chunk_id", F.posexplode(F.from_json(json_part(F.col("reply")), schema)["assets"]).alias("pos", "i"))
    cell = lambda c: F.trim(F.coalesce(F.col(f"i.{c}"), F.lit("")))
    status, n = F.initcap(cell("status")), F.col("i.quantity").try_cast("double")
    return rows.where(cell("asset_type").isin(ASSET_TYPES)).select(
        "chunk_id", "pos", *(cell(c).alias(c) for c in ("asset_tag", "asset_type", "voltage_level", "drawing_area")), F.when(status.isin(STATUSES), status).otherwise("Unclear").alias("status"),
        F.when(n.isNull() | (n == 0), 1.0).otherwise(n).alias("quantity"), F.lit(0.7).alias("confidence"),
    )


def injected(segments: DataFrame, read: DataFrame) -> DataFrame:
    """Segments (file_name, seg_ord, location, text) with text read off page images (file_name, page, text): added to its page below a
    mark, unless that has one, or as a segment of its own before the next page, at the end if there is none. seg_ord counts anew from 0."""
    page = F.lower(F.concat(F.lit("page "), F.col("page").cast("string")))
    new = read.select("file_name", "page", page.alias("place"), F.concat(F.lit(READ_OFF + "\n"), "text").alias("added"))
    first = segments.select("file_name", "seg_ord", F.lower("location").alias("place")).groupBy("file_name", "place").agg(F.min("seg_ord").alias("seg_ord"))
    there = new.join(first, ["file_name", "place"]).select("file_name", "seg_ord", "added")
    old = segments.join(there, ["file_name", "seg_ord"], "left")
    has = F.contains(F.coalesce("text", F.lit("")), F.lit(READ_OFF))
    text = F.when(F.col("added").isNull() | has, F.col("text")).otherwise(F.concat(F.rtrim(F.coalesce("text", F.lit(""))), F.lit("\n"), F.col("added")))
    old = old.select("file_name", F.col("seg_ord").cast("double").alias("at"), F.lit(0).alias("page"), "location", text.alias("text"))
    lone = new.join(first, ["file_name", "place"], "left_anti")
    number = F.regexp_extract(F.coalesce("location", F.lit("")), r"(?i)^\s*page\s+(\d+)", 1).try_cast("int")
    pages = segments.select("file_name", F.col("seg_ord").alias("next"), number.alias("n")).where("n is not null")
    place = lone.alias("l").join(pages.alias("s"), (F.col("l.file_name") == F.col("s.file_name")) & (F.col("n") > F.col("page")), "left").groupBy("l.file_name", "page", "place", "added").agg(F.min("next").alias("next"))
    fresh = place.select("file_name", F.coalesce(F.col("next") - 0.5, F.lit(1e12)).alias("at"), "page", F.col("place").alias("location"), F.col("added").alias("text"))
    order = F.row_number().over(W.partitionBy("file_name").orderBy("at", "page")) - 1
    return old.unionByName(fresh).select("file_name", order.alias("seg_ord"), "location", "text")
