"""Queries of the core: name -> (spark, sf_dir) -> DataFrame, and their DuckDB equivalents.

The tables have no rows in common with the reference's own workbooks, so each query runs an operator's semantics over the
test tables. Small literal tables (terms, requirements) are shared by both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from griddoc.functions import text as X
from griddoc.operators import assets, boxes, match, metrics, packed, regions, tables, units
from griddoc.session import table
from griddoc.streaming import logs

#: Terms of the evidence queries: scenario, term, kind, priority.
TERMS = [
    ("gas", "hydrogen content", "synonym", "High"), ("gas", "gas pressure", "synonym", "Medium"), ("gas", "h2", "keyword", ""),
    ("gas", "gas density gauge", "keyword", ""), ("thermal", "hot-spot temperature", "synonym", "High"), ("thermal", "oil flow", "keyword", ""),
    ("thermal", "top-oil temperature", "synonym", "Low"), ("thermal", "oil", "keyword", ""), ("thermal", "current", "keyword", ""),
    ("discharge", "partial discharge", "synonym", "High"), ("discharge", "discharge magnitude", "synonym", ""), ("discharge", "sensor", "keyword", ""),
    ("timing", "closing time", "synonym", "Medium"), ("timing", "clock", "keyword", ""), ("timing", "time server", "keyword", ""),
    ("switch", "relay", "keyword", ""), ("switch", "tap changer", "synonym", "High"), ("switch", "bay", "keyword", ""), ("switch", "kV", "keyword", ""),
]
_TERMS_SQL = "terms(term_ord, scenario_id, term, kind, priority) as (values " + ", ".join(f"({k}, '{s}', '{t}', '{d}', '{p}')" for k, (s, t, d, p) in enumerate(TERMS)) + ")"


def _terms(spark):
    return spark.createDataFrame([(k, *t) for k, t in enumerate(TERMS)], "term_ord long, scenario_id string, term string, kind string, priority string")


def _hits(spark, d):
    return match.evidence(table(spark, d, "doc_segment"), _terms(spark))


def p2_found(spark, d):
    cells = (("synonyms", "metric_dictionary", False), ("dependencies", "product_family", False), ("applicable_scenarios", "product_master", True))
    parts = [packed.unpack(table(spark, d, t), "row_ord", c, ids).select(F.lit(c).alias("field"), "row_ord", "pos", "val") for c, t, ids in cells]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark, d):
    return units.standardise(table(spark, d, "product_parameter"), table(spark, d, "value_hit"), table(spark, d, "metric_dictionary"))


def evidence_hits(spark, d):
    return _hits(spark, d).select("seg_id", "term_ord", F.col("at").alias("pos"), "line", "confidence", "scenario_id")


def evidence_topk(spark, d):
    return match.best_evidence(_hits(spark, d)).select("file_name", "evidence_id", "scenario_id", "seg_id", "term", "line", "confidence")


def scenario_confidence(spark, d):
    return match.scenario_confidence(match.best_evidence(_hits(spark, d)), ["file_name", "scenario_id"]).select("file_name", "scenario_id", "confidence", "evidence_count")


def evidence_by_line(spark, d):
    return match.collapse(_hits(spark, d)).select("scenario_id", "seg_id", "line", "confidence", "terms")


def term_occurrences(spark, d):
    return match.occurrences(table(spark, d, "documents"), _terms(spark)).withColumnRenamed("texts", "docs")


def contents_pages(spark, d):
    return table(spark, d, "doc_segment").select("seg_id", X.is_contents(F.col("text")).alias("contents"))


def doc_types(spark, d):
    return table(spark, d, "doc_segment").select("seg_id", X.doc_type(F.col("file_name"), F.col("text")).alias("kind"))


def running_boilerplate(spark, d):
    return regions.running_boilerplate(table(spark, d, "doc_segment"))


def spec_bounds(spark, d):
    b = X.bounds(F.col("min_value"), F.col("max_value"), F.col("supported_value"))
    return table(spark, d, "product_parameter").select("param_id", b["lo"].alias("lo"), b["hi"].alias("hi"))


def capability_verdict(spark, d):
    p = table(spark, d, "product_parameter")
    return p.select("param_id", X.verdict(F.lit("60"), F.col("min_value"), F.col("max_value"), F.col("supported_value")).alias("verdict"))


def values_near(spark, d):
    low = F.lower("text")
    s = table(spark, d, "doc_segment").select("seg_id", "text", (F.instr(low, F.lit("temperature")) - 1).alias("at")).where("at >= 0")
    return s.select("seg_id", F.posexplode(X.values_near(F.col("text"), F.col("at"))).alias("k", "v")).select("seg_id", "k", "v.raw", "v.number", "v.unit")


def _islands(spark, d):
    s = table(spark, d, "doc_segment")
    ordered = s.withColumn("seg_ord", F.row_number().over(tables.W.partitionBy("file_name").orderBy("seg_ord", "seg_id")) - 1)
    return ordered.where(F.contains(F.lower("text"), F.lit("hydrogen"))).select("file_name", "seg_ord"), s.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


def anchored_islands(spark, d):
    return regions.islands(*_islands(spark, d), 1)


def chunk_packing(spark, d):
    s = table(spark, d, "doc_segment").where(~X.is_contents(F.col("text")))
    return regions.pack(s.select("file_name", "seg_id", "seg_ord", F.length(F.trim("text")).alias("size")), 4000)


def line_offsets(spark, d):
    return regions.line_offsets(table(spark, d, "doc_segment"))


def bounded_context(spark, d):
    return regions.bounded_context(table(spark, d, "documents")).select("project_id", "doc_id", F.length("block").alias("chars"))


def drawing_labels(spark, d):
    t = F.col("text")
    return table(spark, d, "doc_segment").select("seg_id", X.scope_status(F.coalesce(t, F.lit(""))).alias("scope"), F.array_join(X.labels(t, "transformer"), ";").alias("transformers"), F.size(X.voltages(t)).alias("voltages"))


def dominant_voltage(spark, d):
    s = table(spark, d, "doc_segment").select("file_name", "seg_id", F.posexplode(X.voltages(F.col("text"))).alias("k", "kv"))
    return tables.first_seen_mode(s.withColumn("place", F.col("seg_id") * 1000 + F.col("k")), ["file_name"], "kv", "place")


def catalog_upsert(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.col("p_retailprice").cast("decimal(12,2)").alias("price"), F.col("p_partkey").alias("ord"))
    new = p.where("p_size > 30").select((F.col("p_partkey") * 2).alias("p_partkey"), "p_name", F.lit("new").alias("p_brand"), "p_size", (F.col("price") + 1).cast("decimal(12,2)").alias("price"), "ord")
    return tables.upsert(p, new, F.col("p_partkey"), ["p_partkey", "p_name"], "ord").select("p_partkey", "p_name", "p_brand", "price")


def replace_by_key(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").cast("int").alias("quantity"))
    new = li.where("l_returnflag = 'R'").withColumn("quantity", F.col("quantity") + 100)
    out = tables.replace_by_key(li, new, "l_orderkey", ["l_orderkey", "l_linenumber"], ["l_partkey", "quantity"])
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


def insert_if_absent(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    new = s.select((F.col("s_suppkey") + F.col("s_nationkey")).alias("s_suppkey"), F.upper("s_name").alias("s_name"), "s_nationkey")
    return tables.insert_if_absent(s, new, F.col("s_suppkey"), "s_name")


def prefer_first(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return tables.prefer(o.where("o_orderpriority = '1-URGENT'"), o.withColumn("n", -F.col("n")), ["o_custkey"])


def fill_missing(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise("").alias("segment"), F.col("c_nationkey").alias("rank"))
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") + 100).alias("c_custkey")).agg(F.max("o_orderpriority").alias("segment"), F.count(F.lit(1)).cast("int").alias("rank"))
    return tables.fill_missing(c, o, ["c_custkey"], "segment", "rank")


def feedback_overlay(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    e = table(spark, d, "events").where("event_type in ('error', 'view')").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("event_type").alias("c_mktsegment"), (F.count_if(F.col("event_type") == "error") > 15).alias("deleted"))
    return tables.overlay(c, e.withColumn("c_name", F.lit("")), "c_custkey", ["c_name", "c_mktsegment"])


def unique_slugs(spark, d):
    p = table(spark, d, "product_master").select("row_ord", "family_id", X.slug(F.col("model")).alias("slug"))
    return tables.numbered_suffix(p, ["family_id"], "slug", "row_ord")


def carried_forward(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("bought"))
    c = tables.carried(e, ["user_id"], "bought", "event_id", "last_bought")
    return c.select("user_id", "event_id", F.coalesce("last_bought", F.lit(-1)).alias("last_bought"))


def distinct_by_hash(spark, d):
    return tables.distinct_by_hash(table(spark, d, "documents").select("doc_id", "source", "text"), F.md5("text"), ["doc_id"]).select("doc_id", "source")


def first_seen_mode(spark, d):
    return tables.first_seen_mode(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


def newest_history(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return tables.latest(e, ["event_type"], F.struct("ts", "event_id"), 3, ["user_id"]).select("user_id", "event_type", "event_id")


def status_pivot(spark, d):
    return tables.status_pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def asset_counts(spark, d):
    status = F.when(F.col("l_linestatus") == "F", "Future").otherwise("New")
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file_name"), F.col("l_returnflag").alias("asset_type"), status.alias("status"), F.col("l_quantity").cast("long").alias("quantity"))
    return assets.counts(li)


def url_ranking(spark, d):
    p = table(spark, d, "product_master").select("family_id", "datasheet_url")
    return tables.ranked_urls(p, ["family_id"], "datasheet_url", F.lit("altimor"))


def set_difference(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return tables.difference(c.select("c_custkey"), o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderpriority like '1%'").select("o_custkey"))


def json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json(X.json_part(F.col("props")), "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("k").alias("n"))


def canonical_names(spark, d):
    m = table(spark, d, "metric_dictionary")
    syn = packed.unpack(m, "row_ord", "synonyms").join(m.select("row_ord", "metric_id"), "row_ord").select(F.col("val").alias("synonym"), F.col("metric_id").alias("canonical"))
    syn = syn.unionByName(m.select(F.col("standard_name").alias("synonym"), F.col("metric_id").alias("canonical")))
    return tables.to_canonical(table(spark, d, "unmapped_parameter").select("row_ord", "parameter_name"), "parameter_name", syn)


def scenario_products(spark, d):
    """Products of each scenario: array membership as an equi-join on the exploded cell."""
    p = table(spark, d, "product_master")
    return packed.unpack(p, "row_ord", "applicable_scenarios", True).join(p.select("row_ord", "product_id"), "row_ord").select(F.col("val").alias("scenario_id"), "product_id").distinct().groupBy("scenario_id").agg(F.count(F.lit(1)).alias("products"))


def event_windows(spark, d):
    return logs.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour")


def box_suppression(spark, d):
    li = table(spark, d, "lineitem")
    b = li.select(F.col("l_suppkey").alias("image_id"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"), (F.col("l_partkey") % 97).cast("double").alias("x"), (F.col("l_orderkey") % 89).cast("double").alias("y"), (F.col("l_quantity") + 5).alias("w"), (F.col("l_quantity") % 17 + 5).alias("h"), F.col("l_discount").alias("confidence"))
    return boxes.suppress(b).select("image_id", "type", "box_id")


def drawing_tiles(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 97 + 300).alias("width"), (F.col("p_size") * 61 + 200).alias("height"))
    return boxes.tiles(p)


def located_quotes(spark, d):
    s = table(spark, d, "doc_segment")
    q = s.where("text is not null").select(F.col("seg_id").alias("quote_id"), "file_name", F.upper(F.substring("text", 20, 120)).alias("quote")).where("quote_id % 100 = 0")
    return match.locate_quotes(q, s).select("quote_id", "seg_id", "prefix_rank")


def drawing_assets(spark, d):
    """The labels on drawings; voltage 0 where none is named."""
    return assets.labelled(table(spark, d, "doc_segment")).withColumn("kv", F.coalesce("kv", F.lit(0)))


def asset_totals(spark, d):
    return assets.counts(assets.labelled(table(spark, d, "doc_segment")))


def document_gases(spark, d):
    return assets.gases(table(spark, d, "doc_segment")).select("file_name", F.array_join("gases", ",").alias("gases"))


def feature_flags(spark, d):
    f = X.features(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in f.items()))


def metric_values(spark, d):
    m = table(spark, d, "metric_dictionary")
    names = m.select("row_ord", "metric_id", "unit", "data_type", F.col("standard_name").alias("term"), F.lit(999).alias("k"))
    syn = packed.unpack(m, "row_ord", "synonyms").join(m, "row_ord").select("row_ord", "metric_id", "unit", "data_type", F.col("val").alias("term"), F.col("pos").alias("k"))
    terms = names.unionByName(syn).withColumn("term_ord", (F.col("row_ord") * 1000 + F.col("k")).cast("long"))
    return metrics.metric_values(table(spark, d, "doc_segment"), terms)


QUERIES: dict = {
    f.__name__: f
    for f in (
        p2_found, p4_found, evidence_hits, evidence_topk, scenario_confidence, evidence_by_line, term_occurrences, contents_pages, doc_types,
        running_boilerplate, spec_bounds, capability_verdict, values_near, anchored_islands, chunk_packing, line_offsets,
        bounded_context, drawing_labels, dominant_voltage, catalog_upsert, replace_by_key, insert_if_absent, prefer_first, fill_missing,
        feedback_overlay, unique_slugs, carried_forward, distinct_by_hash, first_seen_mode, newest_history, status_pivot, asset_counts,
        url_ranking, set_difference, json_props, canonical_names, scenario_products, event_windows, box_suppression, drawing_tiles, located_quotes,
        drawing_assets, asset_totals, document_gases, feature_flags, metric_values,
    )
}

_AMBIGUOUS = ", ".join(f"'{t}'" for t in X.AMBIGUOUS)
_CUES = "|".join(X.EXCLUSION_CUES)
_CONTENTS = r"""
    body as (select seg_id, file_name, seg_ord, text, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x{2028}\x{2029}\x0b\x0c\x{85}]'), lambda x: trim(x)), lambda x: x <> '') as ls from doc_segment),
    marked as (select *, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*\d+(?:\.\d+)*\.?\s+.+?\s+\d{1,4}\s*$') or regexp_matches(x, '\.{3,}\s*\d{1,4}\s*$'))) as h from body),
    seg as (select *, len(ls) >= 6 and ((contains(lower(coalesce(text, '')), 'table of contents') and h >= 3) or (h >= 6 and h * 2 >= len(ls))) as contents from marked)"""
_HITS = rf"""
    {_TERMS_SQL}, {_CONTENTS},
    found as (
        select s.seg_id, s.file_name, s.seg_ord, s.text, t.*,
               case when length(t.term) <= 5 and regexp_full_match(replace(t.term, ' ', ''), '[\p{{L}}\p{{N}}]+')
                    then case when regexp_matches(lower(s.text), '(^|[^a-z0-9])' || lower(t.term) || '($|[^a-z0-9])')
                              then length(regexp_extract(lower(s.text), '(?s)^((?:.*?[^a-z0-9])?)' || lower(t.term) || '(?:[^a-z0-9]|$)', 1)) else -1 end
                    else instr(lower(s.text), lower(t.term)) - 1 end as hit
        from seg s, terms t where not s.contents and s.text <> ''),
    strong as (select *, sum(case when term not in ({_AMBIGUOUS}) then 1 else 0 end) over (partition by seg_id, scenario_id) as n_strong from found where hit >= 0),
    hits as (
        select scenario_id, file_name, seg_id, seg_ord, term_ord, term, hit,
               length(substring(text, 1, hit)) - length(replace(substring(text, 1, hit), chr(10), '')) + 1 as line,
               case when hit > 230 then '...' else '' end || trim(regexp_replace(substring(text, greatest(hit - 230, 0) + 1, hit + 230 - greatest(hit - 230, 0)), '\s+', ' ', 'g')) || case when hit + 230 < length(text) then '...' else '' end as snippet,
               cast(case when kind = 'synonym' then case lower(priority) when 'high' then 0.85 when 'medium' then 0.65 when 'low' then 0.5 else 0.6 end
                    else case when length(term) <= 3 then 0.45 when length(term) <= 6 then 0.52 else 0.6 end end as decimal(5,3)) as confidence
        from strong where (term not in ({_AMBIGUOUS}) or kind = 'synonym' or n_strong > 0)
          and not regexp_matches(lower(substring(text, greatest(hit - 160, 0) + 1, hit + 240 - greatest(hit - 160, 0))), '{_CUES}'))"""
_BEST = rf"""{_HITS},
    once as (select *, row_number() over (partition by scenario_id, file_name, substring(snippet, 1, 60) order by confidence desc, seg_ord, seg_id, term_ord) as r from hits),
    top as (select * exclude r, row_number() over (partition by scenario_id, file_name order by confidence desc, seg_ord, seg_id, term_ord) as r from once where r = 1),
    best as (select *, 'EVD-' || lpad(cast(row_number() over (partition by file_name order by confidence desc, scenario_id, seg_ord, seg_id, term_ord) as varchar), 4, '0') as evidence_id from top where r <= 4)"""
_NUMBERS = "list_transform(regexp_extract_all(lower(coalesce(supported_value, '')), '-?\\d+(?:,\\d{3})*(?:\\.\\d+)?'), lambda x: cast(replace(x, ',', '') as double))"
_BOUNDS = f"""
    n as (select *, {_NUMBERS} as n, regexp_matches(lower(coalesce(supported_value, '')), 'up to|upto|max|≤|<') as up, regexp_matches(lower(coalesce(supported_value, '')), 'at least|min|≥|>') as down from product_parameter),
    b as (select *, case when min_value is not null or max_value is not null then min_value when len(n) = 0 or up then null when down or len(n) >= 2 then list_min(n) end as lo,
                    case when min_value is not null or max_value is not null then max_value when len(n) = 0 then null when up then list_max(n) when down then null when len(n) >= 2 then list_max(n) else n[1] end as hi from n),
    v as (select *, case when lo is null and hi is null then 'unknown' when (lo is null or 60 >= lo) and (hi is null or 60 <= hi) then 'pass' else 'fail' end as verdict from b)"""
_MASKED, _PLAIN = "';；|,，/' || chr(10) || chr(13) || chr(9)", "chr(57601) || chr(57602) || chr(57603) || chr(57604) || chr(57605) || chr(57606) || chr(57607) || chr(57608) || chr(57609)"
#: The values of a packed cell: delimiters within spans are masked, the strongest one outside splits, spans get theirs back.
_UNPACK = rf"""
    p{{n}} as (select {{key}}, regexp_replace(trim({{cell}}, ' ' || chr(9) || chr(10) || chr(13)), '(?s)^\[(.*)\]$', '\1') as c from {{table}} where {{cell}} is not null and lower(trim({{cell}}, ' ' || chr(9) || chr(10) || chr(13))) not in ({", ".join(f"'{x}'" for x in ["", *packed.NOTHING])})),
    q{{n}} as (select {{key}}, array_to_string(list_transform(regexp_extract_all(c, '(?s)(?:^|[\s;；|,/])\x27(?:[^\x27]|\x27\x27)*\x27|"(?:[^"]|"")*"|\([^()]*\)|.'),
        lambda x: case when length(x) = 1 then x when x[1] in ('"', '(', chr(39)) then translate(x, {_MASKED}, {_PLAIN}) else x[1] || translate(x[2:], {_MASKED}, {_PLAIN}) end), '') as c from p{{n}}),
    s{{n}} as (select {{key}}, case when {{ids}} then string_split_regex(c, '(?:[\s,，;；|/&+]|\band\b)+') when regexp_matches(c, '[\n\r\t;；|]') then string_split_regex(c, '[\n\r\t;；|]+') when regexp_matches(c, '\s/\s') then string_split_regex(c, '\s+/\s+') else string_split_regex(c, '[,，]') end as v from q{{n}}),
    t{{n}} as (select {{key}}, list_filter(list_transform(v, lambda x: trim(case when regexp_full_match(trim(x), '(?s)"(?:[^"]|"")*"') then replace(trim(x)[2:-2], '""', '"') when regexp_full_match(trim(x), '(?s)\x27(?:[^\x27]|\x27\x27)*\x27') then replace(trim(x)[2:-2], chr(39) || chr(39), chr(39)) else x end, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as v from s{{n}}),
    u{{n}} as (select {{key}}, cast(generate_subscripts(v, 1) as integer) as pos, translate(unnest(v), {_PLAIN}, {_MASKED}) as val from t{{n}})"""


def _unpacked(n: int, source: str, key: str, cell: str, ids: bool) -> str:
    return _UNPACK.format(n=n, key=key, cell=cell, table=source, ids=str(ids).lower())


_SYNONYMS = _unpacked(1, "metric_dictionary", "row_ord", "synonyms", False)
_LABELS = " union all ".join(f"select file_name, seg_ord, seg_id, text, '{t}' as asset_type, upper(unnest(regexp_extract_all(text, '{X.TAGS[k]}'))) as tag from doc_segment" for k, t in assets.TYPES.items())
_ASSETS = rf"""
    l as ({_LABELS} union all select file_name, seg_ord, seg_id, text, 'Feeder', unnest(regexp_extract_all(text, '{assets.FEEDER}')) from doc_segment where regexp_matches(text, '{X.VOLTAGE}')),
    first as (select * from (select distinct * from l) qualify row_number() over (partition by file_name, asset_type, tag order by seg_ord, seg_id) = 1),
    v as (select file_name, seg_id, seg_ord, regexp_extract_all(text, '{X.VOLTAGE}', 1) as vs from doc_segment),
    w as (select file_name, seg_id, seg_ord, generate_subscripts(vs, 1) as k, cast(unnest(vs) as integer) as kv from v),
    own as (select seg_id, kv as own from (select seg_id, kv, count(*) as n, min(k) as f from w group by 1, 2) qualify row_number() over (partition by seg_id order by n desc, f) = 1),
    whole as (select file_name, kv as whole from (select file_name, kv, count(*) as n, min(seg_ord * 100000 + k) as f from w group by 1, 2) qualify row_number() over (partition by file_name order by n desc, f) = 1),
    a as (select first.file_name, asset_type, tag, coalesce(own, whole) as kv, case when regexp_matches(text, '{X.SCOPES[0][1]}') then 'Future' when regexp_matches(text, '{X.SCOPES[1][1]}') then 'Provision'
            when regexp_matches(text, '{X.SCOPES[2][1]}') then 'Existing' when regexp_matches(text, '{X.SCOPES[3][1]}') then 'New' else 'Unclear' end as status from first left join own using (seg_id) left join whole on whole.file_name is not distinct from first.file_name),
    assets as (select file_name, asset_type, status, coalesce(kv, 0) as kv, case when kv is null then '' else kv || 'kV Area' end as area, count(*) as quantity, string_agg(tag, '; ' order by tag) as tags from a group by all)"""
_NORMAL = "trim(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'))"

SQL: dict = {
    "p2_found": f"with {_unpacked(1, 'metric_dictionary', 'row_ord', 'synonyms', False).strip()}, {_unpacked(2, 'product_family', 'row_ord', 'dependencies', False)}, {_unpacked(3, 'product_master', 'row_ord', 'applicable_scenarios', True)} "
    "select 'synonyms' as field, * from u1 union all select 'dependencies', * from u2 union all select 'applicable_scenarios', * from u3",
    "canonical_names": rf"""with {_SYNONYMS.strip()}, n as (select val as synonym, metric_id as canonical from u1 join metric_dictionary using (row_ord) union select standard_name, metric_id from metric_dictionary),
        k as (select distinct trim(regexp_replace(lower(synonym), '\s+', ' ', 'g')) as k, canonical from n)
        select row_ord, parameter_name, canonical from unmapped_parameter join k on k.k = trim(regexp_replace(lower(coalesce(parameter_name, '')), '\s+', ' ', 'g'))""",
    "drawing_assets": f"with {_ASSETS.strip()} select * from assets",
    "asset_totals": f"with {_ASSETS.strip()} select file_name, asset_type, cast(sum(quantity) as bigint) as quantity from assets where status not in ('Future', 'Provision') group by 1, 2",
    "box_suppression": """with b as (select l_suppkey as image_id, l_returnflag as type, l_orderkey * 10 + l_linenumber as box_id, cast(l_partkey % 97 as double) as x, cast(l_orderkey % 89 as double) as y, l_quantity + 5 as w, l_quantity % 17 + 5 as h, l_discount as c from lineitem),
        g as (select image_id, type, list([struct_pack(i := box_id, x := x, y := y, w := w, h := h)] order by c desc, box_id) as bs from b group by 1, 2),
        k as (select image_id, type, list_reduce(bs, lambda a, n: case when len(list_filter(a, lambda p: least(p.x + p.w, n[1].x + n[1].w) > greatest(p.x, n[1].x) and least(p.y + p.h, n[1].y + n[1].h) > greatest(p.y, n[1].y) and
            (least(p.x + p.w, n[1].x + n[1].w) - greatest(p.x, n[1].x)) * (least(p.y + p.h, n[1].y + n[1].h) - greatest(p.y, n[1].y)) >
            0.4 * (p.w * p.h + n[1].w * n[1].h - (least(p.x + p.w, n[1].x + n[1].w) - greatest(p.x, n[1].x)) * (least(p.y + p.h, n[1].y + n[1].h) - greatest(p.y, n[1].y))))) > 0 then a else list_concat(a, n) end) as ks from g)
        select image_id, type, unnest(ks).i as box_id from k""",
    "metric_values": rf"""with {_SYNONYMS.strip()},
        m as (select row_ord, metric_id, unit, data_type, standard_name as term, 999 as k from metric_dictionary union all select row_ord, metric_id, unit, data_type, val, pos from u1 join metric_dictionary using (row_ord)),
        t as (select metric_id, row_ord * 1000 + k as term_ord, trim(regexp_replace(term, '\s+', ' ', 'g')) as word, trim(regexp_replace(lower(term), '\s+', ' ', 'g')) as low, list_filter(regexp_split_to_array(lower(coalesce(unit, '')), '[^a-z0-9]+'), lambda x: x <> '') as units,
                     coalesce(regexp_matches(lower(coalesce(data_type, '')), 'text|list') or lower(trim(unit)) = 'text', false) as wordy from m),
        f as (select file_name, seg_id, seg_ord, text, t.*, case when length(low) <= 5 and regexp_full_match(replace(low, ' ', ''), '[\p{{L}}\p{{N}}]+')
                then case when regexp_matches(lower(text), '(^|[^a-z0-9])' || low || '($|[^a-z0-9])') then length(regexp_extract(lower(text), '(?s)^((?:.*?[^a-z0-9])?)' || low || '(?:[^a-z0-9]|$)', 1)) else -1 end
                else instr(lower(text), low) - 1 end as hit from doc_segment, t where text <> ''),
        n as (select *, substring(text, greatest(hit - 60, 0) + 1, hit + 60 - greatest(hit - 60, 0)) as near from f where hit >= 0),
        z as (select *, list_filter(list_filter(list_zip(regexp_extract_all(near, '{X.VALUE_UNIT}', 1), regexp_extract_all(near, '{X.VALUE_UNIT}', 2)), lambda x: coalesce(x[2], '') <> '' or length(x[1]) > 1),
                lambda x: case when len(units) = 0 then regexp_replace(lower(coalesce(x[2], '')), '\.+$', '') <> '' else list_contains(units, regexp_replace(lower(coalesce(x[2], '')), '\.+$', '')) end) as vs from n),
        r as (select *, case when wordy then word else vs[1][1] end as number, case when wordy then '' else coalesce(vs[1][2], '') end as u, not wordy and len(vs) = 0 as none from z)
        select file_name, metric_id, coalesce(number, '') as value, case when none then '' else u end as unit, seg_id, not none as has_value from r qualify row_number() over (partition by file_name, metric_id order by none, seg_ord, seg_id, term_ord, number, u) = 1""",
    "evidence_hits": f"with {_HITS} select seg_id, term_ord, hit as pos, line, confidence, scenario_id from hits",
    "evidence_topk": f"with {_BEST} select file_name, evidence_id, scenario_id, seg_id, term, line, confidence from best",
    "scenario_confidence": f"with {_BEST} select file_name, scenario_id, cast(least(0.97, max(confidence) + least(0.1, 0.02 * (count(*) - 1))) as decimal(5,3)) as confidence, count(*) as evidence_count from best group by 1, 2",
    "evidence_by_line": f"with {_HITS} select scenario_id, seg_id, line, max(confidence) as confidence, string_agg(term, '; ' order by term_ord) as terms from hits group by scenario_id, file_name, seg_id, line",
    "term_occurrences": rf"""with {_TERMS_SQL}, c as (
            select term, case when length(term) <= 5 and regexp_full_match(replace(term, ' ', ''), '[\p{{L}}\p{{N}}]+')
                then len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x = lower(term)))
                else (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), lower(term), ''))) // length(term) end as n from documents, terms)
        select term, cast(sum(n) as bigint) as n, count(*) filter (n > 0) as docs from c group by 1""",
    "contents_pages": f"with {_CONTENTS} select seg_id, contents from seg",
    "doc_types": r"""with s as (select seg_id, lower(coalesce(file_name, '')) as n, lower(coalesce(text, '')) as t from doc_segment)
        select seg_id, case when regexp_matches(n, 'sld|gsld|drawing|diagram|_dwg') then 'Drawing / SLD'
            when regexp_matches(n, '\.(eml|msg)$|raw email') or contains(substring(t, 1, 500), 'from:') then 'Raw Email'
            when regexp_matches(n, 'spec|tender|scope|requirement') then 'Project Specification'
            when regexp_matches(n, 'boq|quantity|schedule') then 'Equipment List / BOQ'
            when regexp_matches(n, '\.pdf$') and regexp_matches(t, 'single line diagram|legend|circuit breaker') then 'Drawing / SLD'
            else 'Supporting' end as kind from s""",
    "running_boilerplate": r"""with p as (select * from doc_segment where lower(coalesce(location, '')) like 'page %'),
        n as (select file_name, count(*) as n_pages from p group by 1 having count(*) >= 5),
        l as (select file_name, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))))) as line from p),
        c as (select file_name, line, count(*) as n from l where line <> '' and length(line) <= 100 group by 1, 2 having count(*) >= 4)
        select file_name, line, n, n_pages from c join n using (file_name) where n >= greatest(4, n_pages // 2)""",
    "spec_bounds": f"with {_BOUNDS} select param_id, lo, hi from b",
    "capability_verdict": f"with {_BOUNDS} select param_id, verdict from v",
    "values_near": rf"""with s as (select seg_id, text, instr(lower(text), 'temperature') - 1 as hit from doc_segment where contains(lower(text), 'temperature')),
        w as (select seg_id, substring(text, greatest(hit - 60, 0) + 1, hit + 60 - greatest(hit - 60, 0)) as near from s),
        m as (select seg_id, list_filter(list_zip(regexp_extract_all(near, '{X.VALUE_UNIT}', 0), regexp_extract_all(near, '{X.VALUE_UNIT}', 1), regexp_extract_all(near, '{X.VALUE_UNIT}', 2)), lambda x: coalesce(x[3], '') <> '' or length(x[2]) > 1) as v from w),
        u as (select seg_id, unnest(v) as x, generate_subscripts(v, 1) - 1 as k from m)
        select seg_id, k, trim(regexp_replace(x[1], '\s+', ' ', 'g')) as raw, x[2] as number, coalesce(x[3], '') as unit from u""",
    "anchored_islands": """with o as (select file_name, text, row_number() over (partition by file_name order by seg_ord, seg_id) - 1 as i, count(*) over (partition by file_name) as n from doc_segment),
        s as (select file_name, greatest(i - 1, 0) as lo, least(i + 1, n - 1) as hi from o where contains(lower(text), 'hydrogen')),
        f as (select *, max(hi) over (partition by file_name order by lo, hi rows between unbounded preceding and 1 preceding) as ahead from s),
        g as (select *, sum(case when ahead is null or lo > ahead + 1 then 1 else 0 end) over (partition by file_name order by lo, hi rows unbounded preceding) as g from f)
        select file_name, min(lo) as lo, max(hi) as hi from g group by file_name, g""",
    "chunk_packing": f"""with recursive {_CONTENTS},
        s as (select file_name, seg_id, length(trim(text)) as size, row_number() over (partition by file_name order by seg_ord, seg_id) as p from seg where not contents and length(trim(text)) > 0),
        r as (select file_name, seg_id, p, 0 as chunk, size + 1 as used from s where p = 1
              union all select s.file_name, s.seg_id, s.p, case when r.used + s.size > 4000 then r.chunk + 1 else r.chunk end, case when r.used + s.size > 4000 then s.size + 1 else r.used + s.size + 1 end
              from r join s on s.file_name = r.file_name and s.p = r.p + 1)
        select file_name, seg_id, chunk from r""",
    "located_quotes": f"""with {_CONTENTS},
        s as (select file_name, seg_id, seg_ord, {_NORMAL.format("text")} as t from seg where not contents),
        q as (select seg_id as quote_id, file_name, {_NORMAL.format("upper(substring(text, 20, 120))")} as q from doc_segment where text is not null and seg_id % 100 = 0),
        p as (select quote_id, file_name, q, unnest([10000, 160, 100, 60, 40]) as n, unnest([0, 1, 2, 3, 4]) as prefix_rank from q where q <> ''),
        f as (select quote_id, s.seg_id, seg_ord, prefix_rank from p join s using (file_name) where contains(t, substring(q, 1, n)))
        select quote_id, seg_id, prefix_rank from (select *, row_number() over (partition by quote_id order by prefix_rank, seg_ord, seg_id) as r from f) where r = 1""",
    "line_offsets": """with l as (select file_name, seg_id, seg_ord, len(string_split(coalesce(text, ''), chr(10))) as n from doc_segment),
        w as (select *, cast(sum(n) over (partition by file_name order by seg_ord, seg_id rows unbounded preceding) as bigint) as last_line from l)
        select file_name, seg_id, last_line - n + 1 as first_line, last_line from w""",
    "bounded_context": """with b as (select project_id, doc_id, coalesce(doc_type = 'Drawing / SLD', false) as drawing, coalesce(text, '') as t from documents),
        c as (select project_id, doc_id, drawing, length(substring(t, 1, case when drawing then 1500 else 4000 end)) as chars from b),
        w as (select *, coalesce(sum(chars) over (partition by project_id order by drawing, doc_id rows between unbounded preceding and 1 preceding), 0) as used from c)
        select project_id, doc_id, chars from w where used < 9000""",
    "drawing_labels": rf"""select seg_id, case when regexp_matches(t, '{X.SCOPES[0][1]}') then 'Future' when regexp_matches(t, '{X.SCOPES[1][1]}') then 'Provision'
            when regexp_matches(t, '{X.SCOPES[2][1]}') then 'Existing' when regexp_matches(t, '{X.SCOPES[3][1]}') then 'New' else 'Unclear' end as scope,
            array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '{X.TAGS["transformer"]}'), lambda x: upper(x)))), ';') as transformers,
            cast(len(regexp_extract_all(t, '{X.VOLTAGE}')) as integer) as voltages from (select seg_id, coalesce(text, '') as t from doc_segment)""",
    "dominant_voltage": rf"""with v as (select file_name, seg_id, regexp_extract_all(coalesce(text, ''), '{X.VOLTAGE}', 1) as l from doc_segment),
        u as (select file_name, seg_id * 1000 + generate_subscripts(l, 1) as place, cast(unnest(l) as integer) as kv from v),
        c as (select file_name, kv, count(*) as n, min(place) as f from u group by 1, 2)
        select file_name, kv, n from (select *, row_number() over (partition by file_name order by n desc, f) as r from c) where r = 1""",
    "catalog_upsert": """with p as (select p_partkey, p_name, p_brand, p_size, cast(p_retailprice as decimal(12,2)) as price from part),
        n as (select p_partkey * 2 as k, p_name, 'new' as p_brand, cast(price + 1 as decimal(12,2)) as price from p where p_size > 30)
        select coalesce(p.p_partkey, n.k) as p_partkey, case when p.p_partkey is not null then p.p_name else n.p_name end as p_name, coalesce(n.p_brand, p.p_brand) as p_brand, coalesce(n.price, p.price) as price from p full join n on p.p_partkey = n.k""",
    "replace_by_key": """with li as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, cast(l_quantity as integer) as quantity from lineitem),
        n as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, quantity) as r from li where l_returnflag = 'R'),
        u as (select l_orderkey, quantity from li where l_orderkey not in (select l_orderkey from n) union all select l_orderkey, quantity + 100 from n where r = 1)
        select l_orderkey, count(*) as n, cast(sum(quantity) as bigint) as quantity from u group by 1""",
    "insert_if_absent": """with n as (select s_suppkey + s_nationkey as k, upper(s_name) as s_name, s_nationkey, row_number() over (partition by s_suppkey + s_nationkey order by upper(s_name)) as r from supplier)
        select s_suppkey, s_name, s_nationkey from supplier union all select k, s_name, s_nationkey from n where r = 1 and k not in (select s_suppkey from supplier)""",
    "prefer_first": """with o as (select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2)
        select * from o where o_orderpriority = '1-URGENT' union all select o_custkey, o_orderpriority, -n from o where o_custkey not in (select o_custkey from o where o_orderpriority = '1-URGENT')""",
    "fill_missing": """with c as (select c_custkey, case when c_acctbal >= 0 then c_mktsegment else '' end as segment, c_nationkey as rank from customer),
        o as (select o_custkey + 100 as c_custkey, max(o_orderpriority) as segment, cast(count(*) as integer) as rank from orders group by 1)
        select coalesce(c.c_custkey, o.c_custkey) as c_custkey, case when c.segment <> '' then c.segment else o.segment end as segment, greatest(c.rank, o.rank) as rank from c full join o on c.c_custkey = o.c_custkey""",
    "feedback_overlay": """with e as (select user_id, max(event_type) as t, count(*) filter (event_type = 'error') > 15 as deleted from events where event_type in ('error', 'view') group by 1)
        select c_custkey, c_name, coalesce(e.t, c_mktsegment) as c_mktsegment from customer left join e on e.user_id = c_custkey where not coalesce(deleted, false)""",
    "unique_slugs": r"""with s as (select row_ord, family_id, upper(regexp_replace(regexp_replace(coalesce(model, ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as s from product_master),
        d as (select row_ord, family_id, case when s = '' then 'MODEL' else s end as s from s), n as (select *, row_number() over (partition by family_id, s order by row_ord) as n from d)
        select row_ord, family_id, case when n = 1 then s else s || '_' || n end as slug from n""",
    "carried_forward": """with e as (select user_id, event_id, case when event_type = 'purchase' then event_id end as bought from events)
        select user_id, event_id, coalesce(last_value(bought ignore nulls) over (partition by user_id order by event_id rows unbounded preceding), -1) as last_bought from e""",
    "distinct_by_hash": "select doc_id, source from (select *, row_number() over (partition by md5(text) order by doc_id) as r from documents) where r = 1 or text is null",
    "first_seen_mode": """with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by 1, 2)
        select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, f) as r from c) where r = 1""",
    "newest_history": """with o as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events)
        select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from o where r = 1) where k <= 3""",
    "status_pivot": "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p, count(*) as total from orders group by 1",
    "asset_counts": "select l_suppkey as file_name, l_returnflag as asset_type, cast(sum(l_quantity) as bigint) as quantity from lineitem where l_linestatus <> 'F' and l_quantity <> 0 group by 1, 2",
    "url_ranking": r"""with u as (select distinct family_id, datasheet_url, cast(case when contains(lower(datasheet_url), 'altimor') then 1.0 else 0 end + case when regexp_matches(lower(datasheet_url), 'pdf|datasheet|product') then 0.5 else 0 end as decimal(4,1)) as score from product_master where datasheet_url <> '')
        select * from (select *, cast(row_number() over (partition by family_id order by score desc, datasheet_url) as integer) as rank from u) where rank <= 4""",
    "set_difference": "select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderpriority like '1%'",
    "document_gases": "with f as (select file_name, " + ", ".join(f"bool_or(regexp_matches(lower(coalesce(text, '')), '{p}')) as any_{g}, bool_or(regexp_matches(lower(coalesce(text, '')), '{n}')) as name_{g}" for g, p, n, _ in X.GASES)
    + " from doc_segment group by 1), s as (select *, " + " + ".join(f"cast(any_{g} as int)" for g, _, _, a in X.GASES if not a) + " as strong from f) select file_name, concat_ws(',', "
    + ", ".join(f"case when any_{g} and ({not a} or name_{g} or strong >= 3) then '{g}' end" for g, _, _, a in X.GASES) + ") as gases from s",
    "feature_flags": "select doc_id, " + ", ".join("(" + " or ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws) + f") as {n}" for n, ws in X.FEATURES.items()) + " from documents",
    "json_props": "select event_type, cast(sum(cast(json_extract(props, '$.k') as integer)) as bigint) as k, count(json_extract(props, '$.k')) as n from events group by 1",
    "scenario_products": r"with u as (select product_id, unnest(regexp_extract_all(applicable_scenarios, '[A-Z]{3}_[A-Z]{3}_[0-9]{3}')) as scenario_id from product_master) select scenario_id, count(distinct product_id) as products from u group by 1",
    "event_windows": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2",
    "drawing_tiles": """with p as (select p_partkey as image_id, p_size * 97 + 300 as width, p_size * 61 + 200 as height from part),
        x as (select *, unnest(generate_series(0, greatest(width - 251, 0), 1150)) as x from p), y as (select *, unnest(generate_series(0, greatest(height - 251, 0), 1150)) as y from x)
        select image_id, cast(x as integer) as x, cast(y as integer) as y, cast(least(1400, width - x) as integer) as w, cast(least(1400, height - y) as integer) as h from y""",
}
