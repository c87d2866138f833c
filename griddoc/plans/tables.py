"""Queries over the controlled tables and over files written from the test tables, and their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from griddoc.functions import text as X
from griddoc.operators import anchors, catalog, match, packed, replies, tables
from griddoc.operators.running import running_sum
from griddoc.plans import core
from griddoc.session import shared_folder, table
from griddoc.sources import documents, sheets, sinks


def _fresh(spark, name):
    """A folder of its own for what a query writes, below the folder that all executors share."""
    return f"{shared_folder(spark)}/written/{name}-{uuid.uuid4().hex}"


def _scenarios(spark, d):
    return table(spark, d, "product_family").select("row_ord", "family_id", "family_name", "product_line", "applicable_scenarios", "default_quantity_rule_id", "primary_asset_type")


def _detected(spark, d):
    """Scenarios named by synonyms, with a confidence that grows with their number."""
    s = table(spark, d, "synonym_mapping").where(~packed.is_nothing(F.col("scenario_id")))
    return s.groupBy("scenario_id").agg(F.least(F.lit(97), F.count(F.lit(1)) * 20).alias("confidence"))


def scenario_families(spark, d):
    return catalog.of_member(_scenarios(spark, d), "row_ord", "applicable_scenarios", "scenario_id", ["family_id"])


def first_rules(spark, d):
    return catalog.first_of_member(_scenarios(spark, d), "row_ord", "applicable_scenarios", "scenario_id", "default_quantity_rule_id")


def scenario_candidates(spark, d):
    return catalog.candidates(_scenarios(spark, d), table(spark, d, "product_master"))


def own_scenarios(spark, d):
    return catalog.own_or_inherited(table(spark, d, "product_master"), "row_ord", "applicable_scenarios", _scenarios(spark, d).withColumnRenamed("row_ord", "f_ord"), "family_id", "f_ord", "scenario_id")


def product_rules(spark, d):
    """Each product's quantity rule: that of its family, else that of the first scenario it lists."""
    p = table(spark, d, "product_master").select("row_ord", "family_id", "applicable_scenarios")
    first = catalog.members(p, "row_ord", "applicable_scenarios", "scenario_id").groupBy("row_ord").agg(F.min_by("scenario_id", "pos").alias("scenario_id"))
    family = tables.first_per_key(_scenarios(spark, d).select("family_id", "row_ord", "default_quantity_rule_id"), ["family_id"], ["row_ord"]).drop("row_ord")
    return catalog.coalesced_lookup(p.select("row_ord", "family_id").join(first, "row_ord", "left"), "row_ord", family, first_rules(spark, d), "default_quantity_rule_id")


KINDS = ["retrofit kit", "sensor head", "wall unit"]


def first_product_with(spark, d):
    terms = spark.createDataFrame(list(enumerate(KINDS)), "term_ord long, term string")
    return catalog.first_containing(table(spark, d, "product_master"), ["family_id"], "row_ord", F.concat_ws(" ", "model", "description"), terms)


def metric_templates(spark, d):
    names = table(spark, d, "metric_dictionary").select(F.col("row_ord").alias("name_ord"), F.col("standard_name").alias("name"))
    return catalog.best_template(table(spark, d, "unmapped_parameter"), "row_ord", "parameter_name", names)


def scenario_metrics(spark, d):
    syn, m = table(spark, d, "synonym_mapping"), table(spark, d, "metric_dictionary").select("row_ord", "metric_id", "standard_name")
    counted = syn.where(F.contains("scenario_id", F.lit("FLT"))).select("scenario_id", F.lit("MET_107").alias("metric_id")).distinct()
    return catalog.relevant_metrics(syn, syn.select("scenario_id", F.col("raw_term").alias("text")), m, counted)


def _requirements(spark, d):
    """One requirement for each metric: the plain number that its first hit in the documents states."""
    plain = table(spark, d, "value_hit").where(F.col("number").rlike(r"^\d+(\.\d+)?$"))
    first = plain.groupBy("metric_id").agg(F.min_by("number", "hit_id").alias("value"))
    m = table(spark, d, "metric_dictionary")
    kind = catalog.requirement_type(F.col("metric_id"), F.col("required_for_matching"), ["MET_107", "MET_114"], ["MET_101"])
    return m.join(first, "metric_id").select(F.col("row_ord").alias("requirement_id"), "metric_id", "value", kind.alias("kind"))


def requirement_kinds(spark, d):
    return _requirements(spark, d)


def _fits(spark, d):
    verdict = X.verdict(F.col("value"), F.col("min_value"), F.col("max_value"), F.col("supported_value"))
    return catalog.fit(_requirements(spark, d), table(spark, d, "product_parameter"), verdict)


def requirement_fits(spark, d):
    return _fits(spark, d)


def best_products(spark, d):
    products = tables.first_per_key(table(spark, d, "product_master").select("row_ord", "product_id", "family_id", "status"), ["product_id"], ["row_ord"])
    return catalog.best_products(products, _fits(spark, d), _requirements(spark, d), ["family_id"]).select("family_id", "product_id", "points", "violated")


def kept_rows(spark, d):
    """Parameters whose family was not removed: removed are families without a verified product."""
    p = table(spark, d, "product_master")
    removed = tables.difference(table(spark, d, "product_family").select("family_id"), p.where(F.lower(F.trim("status")) == "verified").select("family_id"))
    return table(spark, d, "product_parameter").select("param_id", "family_id").join(removed, "family_id", "left_anti").select("param_id")


def in_scope_parameters(spark, d):
    needed = table(spark, d, "metric_dictionary").where(F.lower("required_for_matching") == "yes").select("metric_id")
    return table(spark, d, "product_parameter").select("param_id", "metric_id").join(needed, "metric_id", "left_semi").select("param_id")


def seeded_values(spark, d):
    """The largest stated maximum of each product and metric, or where none is stated the largest number that begins a text."""
    p = table(spark, d, "product_parameter").where("product_id is not null and metric_id is not null")
    stated = p.where("max_value is not null").groupBy("product_id", "metric_id").agg(F.max("max_value").alias("value"))
    read = p.select("product_id", "metric_id", X.leading_number(F.col("supported_value")).alias("value")).where("value is not null").groupBy("product_id", "metric_id").agg(F.max("value").alias("value"))
    return tables.prefer(stated, read, ["product_id", "metric_id"])


def merged_scenarios(spark, d):
    rules = catalog.members(_scenarios(spark, d), "row_ord", "applicable_scenarios", "scenario_id").groupBy("scenario_id").agg(F.least(F.lit(97), F.count(F.lit(1)) * 5).alias("confidence"))
    refined = _detected(spark, d).withColumn("in_scope", F.col("confidence") > 20)
    kept, dropped = catalog.merge_scoped(rules, refined, "scenario_id")
    return kept.withColumn("state", F.lit("kept")).unionByName(dropped.withColumn("state", F.lit("dropped")))


def line_edits(spark, d):
    """Suppliers under the edits of customers of the same number; edits of unknown lines are added, deleted ones are not."""
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("line"), F.col("s_name").alias("name"))
    edits = table(spark, d, "customer").select(F.col("c_custkey").alias("line"), F.when(F.col("c_nationkey") > 5, F.col("c_name")).otherwise("").alias("name"), (F.col("c_acctbal") < 0).alias("deleted"))
    return tables.prefer(tables.overlay(lines, edits, "line", ["name"]), edits.where("not deleted").join(lines.select("line"), "line", "left_anti").select("line", "name"), ["line"])


def restored_feedback(spark, d):
    """Rows with the decision stored under L and their number."""
    stored = table(spark, d, "events").groupBy(F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("key")).agg(F.max("event_type").alias("decision"))
    lines = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("key"))
    return lines.join(stored, "key", "left").select("c_custkey", F.coalesce("decision", F.lit("")).alias("decision"))


def _first_defaults(parameters):
    return tables.first_per_key(parameters.where("match_type <> ''").select("metric_id", "param_id", "match_type", "match_priority"), ["metric_id"], ["param_id"])


def first_defaults(spark, d):
    return _first_defaults(table(spark, d, "product_parameter")).select("metric_id", "match_type", "match_priority")


def appended_products(spark, d):
    """Parameters of products that the master has not, their blank match types filled as the master first has them."""
    p = table(spark, d, "product_master").select("product_id", "status")
    have = p.where(F.lower(F.trim("status")) == "verified").select("product_id").distinct()
    params = table(spark, d, "product_parameter").select("param_id", "product_id", "metric_id", "match_type", "match_priority")
    defaults = _first_defaults(params.join(have, "product_id", "left_semi")).select("metric_id", F.col("match_type").alias("_t"))
    new = params.join(p.select("product_id").distinct().join(have, "product_id", "left_anti"), "product_id", "left_semi")
    blank = packed.is_nothing(F.col("match_type"))
    return new.join(defaults, "metric_id", "left").select("param_id", "product_id", F.when(blank, F.col("_t")).otherwise(F.col("match_type")).alias("match_type"))


def first_file_wins(spark, d):
    """Records of two lists by model and family in any case; the first list wins, then the first row."""
    a = table(spark, d, "product_master").select(F.lit(0).alias("file"), F.lpad(F.col("row_ord").cast("string"), 12, "0").alias("row"), "model", "family_id")
    b = table(spark, d, "datasheet_product").select(F.lit(1).alias("file"), F.col("cand_id").alias("row"), "model", "family_id")
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    every = a.unionByName(b).select("file", "row", key(F.col("model")).alias("model"), key(F.col("family_id")).alias("family_id"))
    return tables.first_per_key(every, ["model", "family_id"], ["file", "row"])


def future_families(spark, d):
    """Asset types of metrics that no product is made for as they stand, and the first three families that name them."""
    m = table(spark, d, "metric_dictionary").select(F.lower(F.element_at(F.split("applies_to", " "), -1)).alias("asset_type"), F.lit(False).alias("v"))
    p = table(spark, d, "product_master").select(F.lower("primary_asset_type").alias("asset_type"), F.lit(True).alias("v")).unionByName(m).where("asset_type <> ''")
    only = p.groupBy("asset_type").agg(F.max(F.coalesce("v", F.lit(False))).alias("v")).where("not v").select("asset_type", F.xxhash64("asset_type").alias("term_ord"))
    f = _scenarios(spark, d)
    hits = catalog.contained(f, "row_ord", "primary_asset_type", only.select("term_ord", F.col("asset_type").alias("term"))).join(f.select("row_ord", "family_name"), "row_ord")
    rank = F.row_number().over(tables.W.partitionBy("term_ord").orderBy("row_ord"))
    three = hits.withColumn("r", rank).where("r <= 3").groupBy("term_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "family_name"))), lambda x: x["family_name"]), ", ").alias("families"))
    return only.join(three, "term_ord", "left").select("asset_type", F.coalesce("families", F.lit("")).alias("families"))


def spec_scenarios(spark, d):
    s = table(spark, d, "doc_segment")
    hits = catalog.of_documents(core._hits(spark, d), s.select("file_name", "doc_type"), "Project Specification")
    return hits.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


def included_scenarios(spark, d):
    """Scenarios detected, and at confidence 50 those that families of a line list besides."""
    found = _detected(spark, d)
    asked = catalog.members(_scenarios(spark, d).where("product_line = 'PQ'"), "row_ord", "applicable_scenarios", "scenario_id").select("scenario_id").distinct()
    return tables.prefer(found, asked.withColumn("confidence", F.lit(50).cast("long")), ["scenario_id"])


def family_scenario(spark, d):
    """The most certain scenario that each family lists; of equals the first by name."""
    f = catalog.of_member(_scenarios(spark, d), "row_ord", "applicable_scenarios", "scenario_id", ["family_id"]).join(_detected(spark, d), "scenario_id")
    return f.groupBy("family_id").agg(F.min_by("scenario_id", F.struct(-F.col("confidence"), F.col("scenario_id"))).alias("scenario_id"))


def mean_confidence(spark, d):
    """Mean confidence of each document's evidence, and of what exceeds one half (0 for none), in millionths."""
    c = (F.col("confidence") * 1000).cast("long")
    mean = lambda on: F.coalesce(F.floor(F.sum(F.when(on, c)) * 1000 / F.count_if(on)), F.lit(0))
    return core._hits(spark, d).groupBy("file_name").agg(mean(F.lit(True)).alias("mean"), mean(F.col("confidence") > 0.5).alias("mean_high"))


def review_counts(spark, d):
    s = F.lower(F.trim("status"))
    return table(spark, d, "product_master").groupBy("family_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "verified").alias("verified"), F.count_if(s == "candidate").alias("candidate"))


def scenario_best(spark, d):
    order = F.struct(-F.col("confidence"), F.col("file_name"), F.col("seg_ord"), F.col("seg_id"), F.col("term_ord"))
    return core._hits(spark, d).where("file_name is not null").groupBy("scenario_id").agg(F.min_by(F.struct("seg_id", "term_ord"), order).alias("b")).select("scenario_id", "b.seg_id", "b.term_ord")


def first_snippets(spark, d):
    """The first three snippets of each scenario and document, cut to 300 characters."""
    n = F.row_number().over(tables.W.partitionBy("scenario_id", "file_name").orderBy("seg_ord", "seg_id", "term_ord"))
    return core._hits(spark, d).withColumn("n", n).where("n <= 3").select("scenario_id", "file_name", "n", "seg_id", F.length(F.substring("snippet", 1, 300)).alias("chars"))


def group_totals(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 2, F.col("p_brand")).alias("brand"), F.col("p_size").cast("long").alias("size"), (F.col("p_size") + F.length("p_name")).cast("long").alias("all"))
    return catalog.rollup(p, F.col("brand"), "p_partkey", ("size", "all"))


def renumbered_lines(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber")
    return li.withColumn("line", F.row_number().over(tables.W.partitionBy("l_orderkey").orderBy("l_linenumber")))


def distinct_names(spark, d):
    p = table(spark, d, "datasheet_product").where("family_name is not null").select("category", "cand_id", "family_name", F.lower("family_name").alias("k"))
    return tables.first_per_key(p, ["category", "k"], ["cand_id"]).select("category", "family_name")


def question_order(spark, d):
    """Open terms of each scenario by priority, then as listed; a repeated one (in any case) counts once."""
    s = table(spark, d, "synonym_mapping").where(~packed.is_nothing(F.col("raw_term"))).select("scenario_id", "row_ord", F.lower("raw_term").alias("item"), F.lower(F.trim("priority")).alias("p"))
    rank = F.when(F.col("p") == "high", 0).when(F.col("p") == "medium", 1).when(F.col("p") == "low", 2).otherwise(3)
    one = tables.first_per_key(s, ["scenario_id", "item"], ["row_ord"])
    return one.select("scenario_id", "row_ord", F.row_number().over(tables.W.partitionBy("scenario_id").orderBy(rank, "row_ord")).alias("rank"))


def page_order(spark, d):
    """Place of each segment in its document by page number, then as delivered; segments without page number come last."""
    s = table(spark, d, "doc_segment").select("file_name", "seg_id", "seg_ord", F.coalesce(X.page_number(F.col("location")), F.lit(1_000_000)).alias("page"), F.lit(1).alias("one"))
    return running_sum(s, ["file_name"], ["page", "seg_ord", "seg_id"], "one", "place").select("seg_id", F.col("place").cast("long").alias("place"))


def class_a(spark, d):
    return table(spark, d, "doc_segment").where(F.lower("text").rlike(r"class\s*a\b")).select("seg_id")


def anchored_chunks(spark, d):
    return anchors.select(table(spark, d, "doc_segment"), core._terms(spark), 4000)


def anchor_segments(spark, d):
    return anchors.anchored(table(spark, d, "doc_segment"), anchors.anchor_terms(core._terms(spark)))


def box_union(spark, d):
    """The union of each supplier's boxes as fractions of a page of 1024 by 512, held within it."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 900).alias("x"), (F.col("l_orderkey") % 400).alias("y"), F.col("l_quantity").alias("w"), (F.col("l_quantity") * 3).alias("h"))
    part = lambda c, size: F.round(F.greatest(F.least(c / size, F.lit(1.0)), F.lit(0.0)), 5)
    g = li.groupBy("k").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return g.select("k", part(F.col("x0"), 1024).alias("x0"), part(F.col("y0"), 512).alias("y0"), part(F.col("x1"), 1024).alias("x1"), part(F.col("y1"), 512).alias("y1"))


def parsed_times(spark, d):
    """Times written in ISO form, with or without zone, read back; what is none gives -1."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("t"))
    return e.select("event_id", F.coalesce(F.unix_timestamp(F.try_to_timestamp("t")), F.lit(-1)).alias("seconds"))


REPLACED = [("transformer", "unit"), ("relay", "device"), ("unit monitor", "monitor")]


def neutral_texts(spark, d):
    t = F.col("text")
    for a, b in REPLACED:
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"))


def highest_voltage(spark, d):
    v = table(spark, d, "doc_segment").select("file_name", F.array_max(X.voltages(F.col("text"))).alias("kv"))
    return v.groupBy("file_name").agg(F.coalesce(F.max("kv"), F.lit(0)).alias("kv"))


def backed_products(spark, d):
    p = table(spark, d, "product_master")
    return p.select("row_ord", F.coalesce(match.asset_backed(F.col("primary_asset_type"), F.lower("description")), F.lit(False)).alias("backed"))


def item_families(spark, d):
    """The family of each item by its id, if that names one, else by name."""
    f = tables.first_per_key(_scenarios(spark, d).select(F.lower("family_name").alias("k"), "family_id", "row_ord"), ["k"], ["row_ord"]).select("k", F.col("family_id").alias("by_name"))
    c = table(spark, d, "datasheet_product").select("cand_id", F.regexp_extract(F.concat(F.lit("PROD_"), F.coalesce("family_id", F.lit("")), F.lit("_01")), r"^PROD_(PF_[A-Z]+)_\d\d$", 1).alias("by_id"), F.lower(F.trim("family_name")).alias("k"))
    return c.join(f, "k", "left").select("cand_id", F.when(F.col("by_id") != "", F.col("by_id")).otherwise(F.coalesce("by_name", F.lit(""))).alias("family_id"))


def query_plan(spark, d):
    """Searches to be made: two for each family, and the general ones."""
    f = tables.first_per_key(_scenarios(spark, d).select("family_id", "family_name", "row_ord"), ["family_id"], ["row_ord"])
    each = f.select("family_id", F.explode(F.array(F.concat("family_name", F.lit(" datasheet pdf")), F.concat("family_name", F.lit(" specifications")))).alias("query"))
    general = spark.createDataFrame([("", q) for q in ("product range", "new products")], "family_id string, query string")
    return each.unionByName(general)


def vision_pages(spark, d):
    """Segments to be read again from the image: mostly image, or hardly any text beside some image, and not yet read off one."""
    s = table(spark, d, "doc_segment").select("seg_id", F.length(F.trim(F.coalesce("text", F.lit("")))).alias("chars"), (F.col("seg_id") % 50 / 100).alias("share"), F.lower(F.coalesce("location", F.lit(""))).alias("l"))
    return s.where(~F.contains("l", F.lit("ocr"))).where("share >= 0.18 or chars < 180 and share >= 0.05").select("seg_id")


def tagged_text(spark, d):
    """The beginning of each document, 24 000 characters, with its pages marked."""
    s = table(spark, d, "doc_segment").where("text <> '' and file_name is not null").select("file_name", "seg_ord", "seg_id", F.concat(F.lit("["), F.coalesce("location", F.lit("")), F.lit("]\n"), F.col("text")).alias("t"))
    placed = running_sum(s.withColumn("size", F.length("t") + 1), ["file_name"], ["seg_ord", "seg_id"], "size", "upto")
    near = placed.where(F.col("upto") - F.col("size") < 24_000)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "seg_id", "t"))), lambda x: x["t"]), "\n")
    return near.groupBy("file_name").agg(F.substring(joined, 1, 24_000).alias("t")).select("file_name", F.length("t").alias("chars"), F.md5("t").alias("digest"))


def first_valued(spark, d):
    """The first 25 valued parameters of each family."""
    p = table(spark, d, "product_parameter").where("max_value is not null").select("family_id", "param_id")
    return p.withColumn("r", F.row_number().over(tables.W.partitionBy("family_id").orderBy("param_id"))).where("r <= 25").drop("r")


def common_scenarios(spark, d):
    """Scenarios that both the synonyms and the families know."""
    return _detected(spark, d).select("scenario_id").intersect(catalog.members(_scenarios(spark, d), "row_ord", "applicable_scenarios", "scenario_id").select("scenario_id"))


def written_json(spark, d):
    path = _fresh(spark, "json")
    table(spark, d, "supplier").write.mode("overwrite").json(path)
    return spark.read.schema("s_suppkey long, s_name string, s_nationkey int, s_acctbal double").json(path)


def written_csv(spark, d):
    path = _fresh(spark, "csv")
    sinks.export_csv(table(spark, d, "product_family").select("row_ord", "dependencies"), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("row_ord long, dependencies string").csv(path)
    return back.select("row_ord", F.coalesce("dependencies", F.lit("")).alias("dependencies"))


def published_table(spark, d):
    """Two versions published after each other; readers see the second."""
    path, r = _fresh(spark, "published"), table(spark, d, "nation")
    sinks.publish(r.limit(0), path)
    sinks.publish(r.select("n_nationkey", F.upper("n_name").alias("n_name")), path)
    return sinks.read_published(spark, path)


def appended_log(spark, d):
    """A log to which two batches were appended, counted by kind."""
    path, e = _fresh(spark, "log"), table(spark, d, "events").select("event_id", "event_type")
    for kinds in (["click", "view"], ["error", "signup", "purchase"]):
        sinks.append_log(e.where(F.col("event_type").isin(kinds)), path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def backed_up_table(spark, d):
    """A table overwritten after a copy was kept: rows of both."""
    path, r = _fresh(spark, "table"), table(spark, d, "region").select("r_regionkey", "r_name")
    sinks.backed_up(r, path, "first")
    sinks.backed_up(r.withColumn("r_name", F.lower("r_name")), path, "second")
    return spark.read.parquet(path).withColumn("of", F.lit("new")).unionByName(spark.read.parquet(f"{path}.second").withColumn("of", F.lit("old")))


def sheet_records(spark, d):
    """Rows of a sheet whose header stands below a title, as typed records."""
    p = table(spark, d, "product_parameter").select("param_id", F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("product_id", "metric_id", "parameter_name", "min_value", "max_value", "supported_value", "unit"))).alias("cells"))
    cells = spark.createDataFrame([(0, ["Parameters of all products"]), (1, ["Product ID", "Parameter ID", "Parameter Name", "Min Value", "Max Value", "Supported Value / Text", "Unit"])], "row long, cells array<string>")
    got = sheets.records(cells.unionByName(p.select(F.col("param_id").alias("row"), "cells")), "parameter")
    return got.select(F.col("row").alias("param_id"), "product_id", "metric_id", "min_value", "max_value", "unit")


def folder_rows(spark, d):
    """A CSV file in a folder, read as segments: one for each row, its cells between bars."""
    path = _fresh(spark, "folder")
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_name"), F.col("s_nationkey").cast("string"))
    rows.coalesce(1).sortWithinPartitions("s_suppkey").write.option("header", True).csv(path)
    return documents.read_folder(spark, path).select("seg_ord", "location", "text")


def seeded_boxes(spark, d):
    """Boxes stored as JSON lines, what is not stated filled in."""
    path = _fresh(spark, "seed")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("label"), F.when(F.col("p_size") > 25, F.col("p_size") / 64).alias("confidence"))
    p.write.json(path)
    back = spark.read.schema("id long, type string, label string, confidence double, status string").json(path)
    return back.select("id", "type", F.coalesce("label", "type").alias("label"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"), F.coalesce("status", F.lit("pending")).alias("status"))


def stored_feedback(spark, d):
    """Feedback stored one object a line; lines that cannot be read count as empty."""
    path = _fresh(spark, "feedback")
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))).alias("value"))
    e.write.text(path)
    back = spark.read.schema("id long, kind string").option("mode", "PERMISSIVE").json(path)
    return back.groupBy(F.coalesce("kind", F.lit("{}")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _seen(spark, d):
    """Replies as a model that looks at drawings might give them, made of table rows."""
    p = table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ["Circuit Breaker", "Transformer", "Toaster"])), F.col("p_size") % 3 + 1)
    status = F.element_at(F.array(*map(F.lit, ["new", "FUTURE", "odd"])), F.length("p_name") % 3 + 1)
    quantity = F.when(F.col("p_size") < 10, F.lit("many")).when(F.col("p_size") < 20, F.lit("0")).otherwise(F.col("p_size").cast("string"))
    item = F.struct(F.col("p_name").alias("asset_tag"), kind.alias("asset_type"), status.alias("status"), quantity.alias("quantity"))
    return p.select(F.col("p_partkey").alias("chunk_id"), F.concat(F.lit("Seen: ```json\n"), F.to_json(F.struct(F.array(item).alias("assets"))), F.lit("\n```")).alias("reply"))


def seen_assets(spark, d):
    return replies.seen_assets(_seen(spark, d)).select("chunk_id", "asset_tag", "asset_type", "status", "quantity")


def injected_pages(spark, d):
    """Segments with text read off the pages of each document whose number is that of its first page, and the one after its last."""
    s = table(spark, d, "doc_segment").where("file_name is not null").select("file_name", F.col("seg_id").alias("seg_ord"), "location", "text")
    n = s.select("file_name", X.page_number(F.col("location")).alias("n")).where("n is not null").groupBy("file_name").agg(F.min("n").alias("lo"), (F.max("n") + 1).alias("hi"))
    read = n.select("file_name", F.explode(F.array("lo", "hi")).alias("page")).distinct().withColumn("text", F.lit("seen"))
    got = replies.injected(s, read)
    return got.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("text", F.lit(replies.READ_OFF))).alias("marked"))


def allowed_pairs(spark, d):
    """Parameters of the metrics that the synonyms map, by scenario."""
    syn = table(spark, d, "synonym_mapping").where("scenario_id is not null and metric_id <> ''").select("scenario_id", "metric_id")
    items = table(spark, d, "product_parameter").select("param_id", "metric_id").join(syn.select("scenario_id").distinct().limit(1_000_000), F.col("metric_id") == "MET_107")
    return replies.allowed(items, syn).select("param_id", "scenario_id")


QUERIES = {
    f.__name__: f
    for f in (
        scenario_families, first_rules, scenario_candidates, own_scenarios, product_rules, first_product_with, metric_templates, scenario_metrics,
        requirement_kinds, requirement_fits, best_products, kept_rows, in_scope_parameters, seeded_values, merged_scenarios, line_edits,
        restored_feedback, first_defaults, appended_products, first_file_wins, future_families, spec_scenarios, included_scenarios,
        family_scenario, mean_confidence, review_counts, scenario_best, first_snippets, group_totals, renumbered_lines, distinct_names,
        question_order, page_order, class_a, anchored_chunks, anchor_segments, box_union, parsed_times, neutral_texts, highest_voltage,
        backed_products, item_families, query_plan, vision_pages, tagged_text, first_valued, common_scenarios, written_json, written_csv,
        published_table, appended_log, backed_up_table, sheet_records, folder_rows, seeded_boxes, stored_feedback, seen_assets, injected_pages,
        allowed_pairs,
    )
}

_NOTHING = ", ".join(f"'{x}'" for x in ["", *packed.NOTHING])
_BLANK = f"({{0}} is null or lower(trim({{0}})) in ({_NOTHING}))"
_MEMBERS = """f as (select row_ord, family_id, family_name, product_line, default_quantity_rule_id, unnest(list_distinct(regexp_extract_all(applicable_scenarios, '[A-Z]{3}_[A-Z]{3}_[0-9]{3}'))) as scenario_id from product_family)"""
_DETECTED = f"det as (select scenario_id, cast(least(97, count(*) * 20) as bigint) as confidence from synonym_mapping where not {_BLANK.format('scenario_id')} group by 1)"
_FIRST = "first as (select scenario_id, default_quantity_rule_id from (select *, row_number() over (partition by scenario_id order by row_ord) as r from f) where r = 1)"
_REQ = r"""
    plain as (select metric_id, number, row_number() over (partition by metric_id order by hit_id) as r from value_hit where regexp_full_match(number, '\d+(\.\d+)?')),
    req as (select row_ord as requirement_id, m.metric_id, number as value, case when m.metric_id in ('MET_107', 'MET_114') then 'Quantity Basis' when m.metric_id = 'MET_101' or contains(lower(coalesce(required_for_matching, '')), 'yes') then 'Must-have'
                when contains(lower(coalesce(required_for_matching, '')), 'preferred') then 'Preferred' else 'Reference' end as kind from metric_dictionary m join plain p on m.metric_id = p.metric_id and r = 1)"""
_FITS = core._BOUNDS.split("    v as")[0].rstrip().rstrip(",") + f""", {_REQ},
    j as (select product_id, requirement_id, kind, case when lo is null and hi is null then 1 when (lo is null or cast(value as double) >= lo) and (hi is null or cast(value as double) <= hi) then 0 else 2 end as v from b join req using (metric_id)),
    fits as (select product_id, requirement_id, min(v) as v from j group by 1, 2)"""

_ANCHORS = ", ".join(f"('{t.lower()}')" for t in dict.fromkeys(t for _, t, k, _ in core.TERMS) if not any(x == t and k == "keyword" and t in X.AMBIGUOUS for _, x, k, _ in core.TERMS))
_ANCHORED = rf"""
    {core._CONTENTS}, t(term) as (values {_ANCHORS}),
    h as (select seg_id, lower(text) as low, case when regexp_matches(lower(text), '(^|[^a-z0-9])' || term || '(s|es)?($|[^a-z0-9])')
                then length(regexp_extract(lower(text), '(?s)^((?:.*?[^a-z0-9])?)' || term || '(?:s|es)?(?:[^a-z0-9]|$)', 1)) else -1 end as hit from seg, t where trim(text) <> ''),
    anchor as (select distinct seg_id from h where hit >= 0 and not regexp_matches(substring(low, greatest(hit - 160, 0) + 1, hit + 240 - greatest(hit - 160, 0)), '{core._CUES}'))"""

SQL = {
    "anchor_segments": f"with {_ANCHORED.strip()} select seg_id from anchor",
    "anchored_chunks": f"""with recursive {_ANCHORED.strip()},
        o as (select *, row_number() over (partition by file_name order by seg_ord, seg_id) as i, sum(length(coalesce(text, ''))) over (partition by file_name) as chars, count(*) over (partition by file_name) as n from seg),
        a as (select file_name, i, case when chars >= 1000 * n then 0 else 2 end as r from o where seg_id in (select seg_id from anchor)),
        k as (select distinct o.file_name, o.seg_id, o.seg_ord, length(trim(o.text)) as size from o join a on o.file_name = a.file_name and o.i between a.i - r and a.i + r where not contents and trim(coalesce(text, '')) <> ''),
        s as (select *, row_number() over (partition by file_name order by seg_ord, seg_id) as p from k),
        r as (select file_name, seg_id, p, 0 as chunk, size + 1 as used from s where p = 1
              union all select s.file_name, s.seg_id, s.p, case when r.used + s.size > 4000 then r.chunk + 1 else r.chunk end, case when r.used + s.size > 4000 then s.size + 1 else r.used + s.size + 1 end
              from r join s on s.file_name = r.file_name and s.p = r.p + 1)
        select file_name, seg_id, chunk from r""",
    "scenario_families": f"with {_MEMBERS} select scenario_id, row_ord, family_id from f",
    "first_rules": f"with {_MEMBERS}, {_FIRST} select * from first",
    "scenario_candidates": f"""with {_MEMBERS}, g as (select scenario_id, family_id, min(row_ord) as fo from f group by 1, 2), p as (select family_id, product_id, min(row_ord) as po from product_master group by 1, 2),
        o as (select scenario_id, product_id, min((fo, po)) as pos from g join p using (family_id) group by 1, 2)
        select * from (select scenario_id, product_id, cast(row_number() over (partition by scenario_id order by pos, product_id) as integer) as rank from o) where rank <= 14""",
    "own_scenarios": f"""with own as (select row_ord, unnest(list_distinct(regexp_extract_all(applicable_scenarios, '[A-Z]{{3}}_[A-Z]{{3}}_[0-9]{{3}}'))) as scenario_id from product_master),
        ff as (select family_id, applicable_scenarios from (select *, row_number() over (partition by family_id order by row_ord) as r from product_family) where r = 1),
        inh as (select row_ord, unnest(list_distinct(regexp_extract_all(ff.applicable_scenarios, '[A-Z]{{3}}_[A-Z]{{3}}_[0-9]{{3}}'))) as scenario_id from product_master p join ff using (family_id) where {_BLANK.format('p.applicable_scenarios')})
        select * from own union all select * from inh""",
    "product_rules": f"""with {_MEMBERS}, {_FIRST}, ff as (select family_id, default_quantity_rule_id as a from (select *, row_number() over (partition by family_id order by row_ord) as r from product_family) where r = 1),
        p as (select row_ord, family_id, regexp_extract(applicable_scenarios, '[A-Z]{{3}}_[A-Z]{{3}}_[0-9]{{3}}') as scenario_id from product_master)
        select row_ord, coalesce(case when not {_BLANK.format('a')} then a end, case when not {_BLANK.format('first.default_quantity_rule_id')} then first.default_quantity_rule_id end) as default_quantity_rule_id
        from p left join ff using (family_id) left join first using (scenario_id)""",
    "first_product_with": "with t(term_ord, term) as (values " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(KINDS)) + ") select family_id, cast(term_ord as bigint) as term_ord, min(row_ord) as row_ord from product_master, t where contains(lower(concat_ws(' ', model, description)), term) group by 1, 2",
    "metric_templates": r"""with n as (select row_ord as name_ord, lower(standard_name) as name, list_filter(string_split_regex(lower(standard_name), '\s+'), lambda w: length(w) > 3 and w not in ('count', 'number', 'level', 'type', 'value', 'rating', 'class', 'list', 'point', 'points')) as ws from metric_dictionary),
        t as (select name_ord, unnest(list_append(ws, name)) as term from n)
        select name_ord, min(row_ord) as row_ord from t, unmapped_parameter where contains(lower(parameter_name), term) group by 1""",
    "scenario_metrics": f"""with s as (select * from synonym_mapping where not {_BLANK.format('scenario_id')}),
        w as (select scenario_id, metric_id, 0 as way, row_ord as pos from s where not {_BLANK.format('metric_id')} union all select scenario_id, 'MET_107', 1, 0 from s where contains(scenario_id, 'FLT')
              union all select scenario_id, m.metric_id, 2, m.row_ord from s, metric_dictionary m where contains(lower(raw_term), lower(standard_name))),
        o as (select scenario_id, metric_id, min((way, pos)) as p from w group by 1, 2)
        select scenario_id, metric_id, cast(row_number() over (partition by scenario_id order by p) as integer) as rank from o""",
    "requirement_kinds": f"with {_REQ.strip()} select * from req",
    "requirement_fits": f"with {_FITS.strip()} select product_id, requirement_id, ['pass', 'unknown', 'fail'][v + 1] as verdict from fits",
    "best_products": f"""with {_FITS.strip()},
        s as (select product_id, sum(case v when 0 then w when 2 then -1.5 * w else 0 end) as points, bool_or(v = 2 and kind = 'Must-have') as violated
              from (select *, cast(case kind when 'Must-have' then 3.0 when 'Reference' then 0.5 else 1.0 end as double) as w from fits join (select requirement_id, kind from req) using (requirement_id)) group by 1),
        p as (select * from (select row_ord, product_id, family_id, lower(trim(coalesce(status, ''))) as st, row_number() over (partition by product_id order by row_ord) as r from product_master) where r = 1),
        q as (select family_id, product_id, row_ord, round(coalesce(points, 0) + case when st = 'verified' then 0.5 else 0 end, 2) as points, coalesce(violated, false) as violated, case st when 'verified' then 0 when 'candidate' then 1 else 2 end as sr from p left join s using (product_id))
        select family_id, product_id, points, violated from (select *, row_number() over (partition by family_id order by violated, sr, points desc, row_ord) as r from q) where r = 1""",
    "kept_rows": "with removed as (select family_id from product_family except select family_id from product_master where lower(trim(status)) = 'verified') select param_id from product_parameter where family_id not in (select family_id from removed)",
    "in_scope_parameters": "select param_id from product_parameter where metric_id in (select metric_id from metric_dictionary where lower(required_for_matching) = 'yes')",
    "seeded_values": r"""with p as (select * from product_parameter where product_id is not null and metric_id is not null), a as (select product_id, metric_id, max(max_value) as value from p where max_value is not null group by 1, 2),
        b as (select product_id, metric_id, max(try_cast(regexp_extract(supported_value, '^\s*(-?\d+(?:\.\d+)?)', 1) as double)) as value from p group by 1, 2)
        select * from a union all select b.* from b left join a using (product_id, metric_id) where a.product_id is null and b.value is not null""",
    "merged_scenarios": f"""with {_MEMBERS}, {_DETECTED}, rules as (select scenario_id, cast(least(97, count(*) * 5) as bigint) as c from f group by 1)
        select coalesce(r.scenario_id, d.scenario_id) as scenario_id, coalesce(d.confidence, r.c) as confidence, case when d.scenario_id is null then 'rules' when r.scenario_id is null then 'refined' else 'both' end as origin,
               case when coalesce(d.confidence > 20, true) then 'kept' else 'dropped' end as state from rules r full join det d on r.scenario_id = d.scenario_id""",
    "line_edits": """with e as (select c_custkey as line, case when c_nationkey > 5 then c_name else '' end as name, c_acctbal < 0 as deleted from customer),
        k as (select s.s_suppkey as line, case when e.name <> '' then e.name else s.s_name end as name from supplier s left join e on e.line = s.s_suppkey where not coalesce(deleted, false))
        select * from k union all select line, name from e where not deleted and line not in (select s_suppkey from supplier)""",
    "restored_feedback": "select c_custkey, coalesce(decision, '') as decision from customer left join (select user_id, max(event_type) as decision from events group by 1) e on e.user_id = c_custkey",
    "first_defaults": "select metric_id, match_type, match_priority from (select *, row_number() over (partition by metric_id order by param_id) as r from product_parameter where match_type <> '') where r = 1",
    "appended_products": f"""with have as (select product_id from product_master where lower(trim(status)) = 'verified'),
        dft as (select metric_id, match_type as t from (select *, row_number() over (partition by metric_id order by param_id) as r from product_parameter where match_type <> '' and product_id in (select product_id from have)) where r = 1)
        select param_id, product_id, case when {_BLANK.format('match_type')} then t else match_type end as match_type from product_parameter p left join dft on dft.metric_id = p.metric_id
        where product_id in (select product_id from product_master) and product_id not in (select product_id from have)""",
    "first_file_wins": """with u as (select 0 as file, lpad(cast(row_ord as varchar), 12, '0') as row, model, family_id from product_master union all select 1, cand_id, model, family_id from datasheet_product),
        k as (select file, row, lower(trim(coalesce(model, ''), ' ')) as model, lower(trim(coalesce(family_id, ''), ' ')) as family_id from u)
        select * exclude r from (select *, row_number() over (partition by model, family_id order by file, row) as r from k) where r = 1""",
    "future_families": """with m as (select distinct lower(string_split(applies_to, ' ')[-1]) as asset_type from metric_dictionary), o as (select asset_type from m where asset_type <> '' and asset_type not in (select lower(primary_asset_type) from product_master where primary_asset_type is not null)),
        h as (select asset_type, family_name, row_number() over (partition by asset_type order by row_ord) as r from o, product_family where contains(lower(primary_asset_type), asset_type))
        select asset_type, coalesce(string_agg(family_name, ', ' order by r) filter (r <= 3), '') as families from o left join h using (asset_type) group by 1""",
    "spec_scenarios": f"with {core._HITS}, k as (select distinct file_name from doc_segment where doc_type = 'Project Specification') select scenario_id, count(*) as n, max(confidence) as confidence from hits where file_name in (select file_name from k) or not exists (select 1 from k) group by 1",
    "included_scenarios": f"with {_MEMBERS}, {_DETECTED} select * from det union all select distinct scenario_id, cast(50 as bigint) from f where product_line = 'PQ' and scenario_id not in (select scenario_id from det)",
    "family_scenario": f"with {_MEMBERS}, {_DETECTED} select family_id, scenario_id from (select family_id, scenario_id, row_number() over (partition by family_id order by confidence desc, scenario_id) as r from f join det using (scenario_id)) where r = 1",
    "mean_confidence": f"with {core._HITS}, c as (select file_name, cast(confidence * 1000 as bigint) as c from hits) select file_name, coalesce(cast(sum(c) as bigint) * 1000 // count(*), 0) as mean, coalesce(cast(sum(c) filter (c > 500) as bigint) * 1000 // nullif(count(*) filter (c > 500), 0), 0) as mean_high from c group by 1",
    "review_counts": "select family_id, count(*) as total, count(*) filter (lower(trim(status)) = 'verified') as verified, count(*) filter (lower(trim(status)) = 'candidate') as candidate from product_master group by 1",
    "scenario_best": f"with {core._HITS} select scenario_id, seg_id, term_ord from (select *, row_number() over (partition by scenario_id order by confidence desc, file_name, seg_ord, seg_id, term_ord) as r from hits where file_name is not null) where r = 1",
    "first_snippets": f"with {core._HITS} select scenario_id, file_name, n, seg_id, cast(length(substring(snippet, 1, 300)) as integer) as chars from (select *, cast(row_number() over (partition by scenario_id, file_name order by seg_ord, seg_id, term_ord) as integer) as n from hits) where n <= 3",
    "group_totals": "select coalesce(case when p_size > 2 then p_brand end, 'Unassigned') as name, count(*) as n, cast(sum(p_size) as bigint) as part, cast(sum(p_size + length(p_name)) as bigint) as whole, sum(p_size) / sum(p_size + length(p_name)) as ratio, min(p_partkey) as first from part group by 1",
    "renumbered_lines": "select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by l_linenumber) as integer) as line from lineitem where l_returnflag <> 'R'",
    "distinct_names": "select category, family_name from (select *, row_number() over (partition by category, lower(family_name) order by cand_id) as r from datasheet_product where family_name is not null) where r = 1",
    "question_order": f"""with s as (select scenario_id, row_ord, lower(trim(priority)) as p, row_number() over (partition by scenario_id, lower(raw_term) order by row_ord) as r from synonym_mapping where not {_BLANK.format('raw_term')})
        select scenario_id, row_ord, cast(row_number() over (partition by scenario_id order by case p when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end, row_ord) as integer) as rank from s where r = 1""",
    "page_order": r"select seg_id, row_number() over (partition by file_name order by coalesce(try_cast(regexp_extract(coalesce(location, ''), '(?i)page\s+(\d+)', 1) as integer), 1000000), seg_ord, seg_id) as place from doc_segment",
    "class_a": r"select seg_id from doc_segment where regexp_matches(lower(text), 'class\s*a\b')",
    "box_union": """with b as (select l_suppkey as k, l_partkey % 900 as x, l_orderkey % 400 as y, l_quantity as w, l_quantity * 3 as h from lineitem), g as (select k, min(x) as x0, min(y) as y0, max(x + w) as x1, max(y + h) as y1 from b group by 1)
        select k, round(greatest(least(x0 / 1024, 1.0), 0.0), 5) as x0, round(greatest(least(y0 / 512, 1.0), 0.0), 5) as y0, round(greatest(least(x1 / 1024, 1.0), 0.0), 5) as x1, round(greatest(least(y1 / 512, 1.0), 0.0), 5) as y1 from g""",
    "parsed_times": "select event_id, case when event_type <> 'click' then cast(epoch(date_trunc('second', ts)) as bigint) else -1 end as seconds from events",
    "neutral_texts": "select doc_id, md5(" + "".join("replace(" for _ in REPLACED) + "text" + "".join(f", '{a}', '{b}')" for a, b in REPLACED) + ") as digest from documents",
    "highest_voltage": rf"select file_name, coalesce(max(list_max(list_transform(regexp_extract_all(text, '{X.VOLTAGE}', 1), lambda x: cast(x as integer)))), 0) as kv from doc_segment group by 1",
    "backed_products": r"""with p as (select row_ord, lower(coalesce(primary_asset_type, '')) as a, lower(description) as t from product_master)
        select row_ord, coalesce(len(list_filter(list_transform(string_split_regex(a, '[/,]'), lambda x: trim(x)), lambda x: len(string_split_regex(x, '\s+')) >= 2 and contains(t, x))) > 0 or (list_contains(string_split_regex(a, '\s+'), 'gis') and contains(t, 'gis')), false) as backed from p""",
    "item_families": r"""with f as (select lower(family_name) as k, family_id from (select *, row_number() over (partition by lower(family_name) order by row_ord) as r from product_family) where r = 1)
        select cand_id, case when regexp_full_match(coalesce(c.family_id, ''), 'PF_[A-Z]+') then c.family_id else coalesce(f.family_id, '') end as family_id from datasheet_product c left join f on f.k = lower(trim(c.family_name))""",
    "query_plan": """with f as (select family_id, family_name from (select *, row_number() over (partition by family_id order by row_ord) as r from product_family) where r = 1)
        select family_id, family_name || ' datasheet pdf' as query from f union all select family_id, family_name || ' specifications' from f union all select '', 'product range' union all select '', 'new products'""",
    "vision_pages": "with s as (select seg_id, length(trim(coalesce(text, ''), ' ')) as chars, (seg_id % 50) / 100 as share, lower(coalesce(location, '')) as l from doc_segment) select seg_id from s where not contains(l, 'ocr') and (share >= 0.18 or chars < 180 and share >= 0.05)",
    "tagged_text": """with t as (select file_name, string_agg('[' || coalesce(location, '') || ']' || chr(10) || text, chr(10) order by seg_ord, seg_id) as t from doc_segment where text <> '' and file_name is not null group by 1)
        select file_name, cast(length(substring(t, 1, 24000)) as integer) as chars, md5(substring(t, 1, 24000)) as digest from t""",
    "first_valued": "select family_id, param_id from (select *, row_number() over (partition by family_id order by param_id) as r from product_parameter where max_value is not null) where r <= 25",
    "common_scenarios": f"with {_MEMBERS}, {_DETECTED} select scenario_id from det intersect select scenario_id from f",
    "written_json": "select * from supplier",
    "written_csv": "select row_ord, coalesce(dependencies, '') as dependencies from product_family",
    "published_table": "select n_nationkey, upper(n_name) as n_name from nation",
    "appended_log": "select event_type, count(*) as n from events group by 1",
    "backed_up_table": "select r_regionkey, lower(r_name) as r_name, 'new' as of from region union all select r_regionkey, r_name, 'old' from region",
    "folder_rows": """with r as (select s_suppkey, s_suppkey || ' | ' || s_name || ' | ' || s_nationkey as text, row_number() over (order by s_suppkey) + 1 as k from supplier union all select -1, 's_suppkey | s_name | s_nationkey', 1)
        select cast(k as integer) as seg_ord, 'row ' || k as location, text from r""",
    "seeded_boxes": "select p_partkey as id, p_brand as type, case when p_size > 10 then p_name else p_brand end as label, case when p_size > 25 then p_size / 64 else 0.7 end as confidence, 'pending' as status from part",
    "stored_feedback": "select case when event_type = 'error' then '{}' else event_type end as kind, count(*) as n from events group by 1",
    "seen_assets": """with p as (select *, ['Circuit Breaker', 'Transformer', 'Toaster'][p_size % 3 + 1] as t, ['New', 'Future', 'Unclear'][length(p_name) % 3 + 1] as s from part)
        select p_partkey as chunk_id, p_name as asset_tag, t as asset_type, s as status, cast(case when p_size < 20 then 1 else p_size end as double) as quantity from p where t <> 'Toaster'""",
    "injected_pages": r"""with s as (select file_name, seg_id, text, lower(location) as l, try_cast(regexp_extract(coalesce(location, ''), '(?i)page\s+(\d+)', 1) as integer) as n from doc_segment where file_name is not null),
        g as (select file_name, min(n) as lo, max(n) + 1 as hi from s group by 1), r as (select distinct file_name, unnest([lo, hi]) as page from g where lo is not null),
        f as (select file_name, l, min(seg_id) as seg_id from s group by 1, 2), hit as (select r.file_name, page, f.seg_id from r left join f on f.file_name = r.file_name and f.l = 'page ' || page)
        select s.file_name, count(distinct s.seg_id) + (select count(*) from hit h where h.file_name = s.file_name and h.seg_id is null) as n, (select count(*) from hit h where h.file_name = s.file_name) as marked from s group by 1""",
    "allowed_pairs": "with s as (select distinct scenario_id, metric_id from synonym_mapping where scenario_id is not null and metric_id = 'MET_107') select param_id, scenario_id from product_parameter join s using (metric_id)",
    "sheet_records": r"select param_id, trim(regexp_replace(product_id, '\s+', ' ', 'g')) as product_id, trim(regexp_replace(coalesce(metric_id, ''), '\s+', ' ', 'g')) as metric_id, min_value, max_value, trim(regexp_replace(coalesce(unit, ''), '\s+', ' ', 'g')) as unit from product_parameter where coalesce(trim(product_id), '') <> ''",
}
