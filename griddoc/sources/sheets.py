"""Controlled tables whose header stands somewhere in a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from griddoc.functions.text import split_list, squeezed
from griddoc.operators.tables import carried

#: Columns of each table as header, name, kind ('s' text, 'l' list, 'd' number) and, where a blank cell means something, that.
#: The first header is searched for; the first column is the key.
TABLES = {
    "scenario": [
        ("Scenario ID", "scenario_id", "s"), ("Scenario Category", "category", "s"), ("Application Scenario", "application_scenario", "s"), ("Asset Type", "asset_type", "s"),
        ("Typical Metrics / Requirements", "typical_metrics", "s"), ("Common Evidence Keywords / Synonyms", "keywords", "l"), ("Related Product Families", "related_product_families", "l"),
        ("Quantity Basis", "quantity_basis", "s"), ("Drawing Dependency", "drawing_dependency", "s"), ("Requirement Output Fields", "requirement_output_fields", "l"), ("Review Notes", "review_notes", "s"),
    ],
    "metric": [
        ("Metric ID", "metric_id", "s"), ("Standard Metric Name", "standard_name", "s"), ("Synonyms / Raw Terms", "synonyms", "l"), ("Standard Unit", "unit", "s"), ("Data Type", "data_type", "s"),
        ("Applies To", "applies_to", "s"), ("Used For", "used_for", "s"), ("Required for Matching", "required_for_matching", "s"), ("Normalization Notes", "notes", "s"),
    ],
    "synonym": [
        ("Raw Term / Phrase", "raw_term", "s"), ("Mapped Scenario ID", "scenario_id", "s"), ("Mapped Metric ID", "metric_id", "s"), ("Mapped Standard Meaning", "standard_meaning", "s"),
        ("Asset Context", "asset_context", "s"), ("Mapping Priority", "priority", "s", "Medium"), ("Notes", "notes", "s"),
    ],
    "family": [
        ("Product Family ID", "family_id", "s"), ("Product Line", "product_line", "s"), ("Product Family", "family_name", "s"), ("Applicable Scenario IDs", "applicable_scenarios", "l"), ("Primary Asset Type", "primary_asset_type", "s"),
        ("Typical Capabilities", "typical_capabilities", "s"), ("Default Quantity Rule ID", "default_quantity_rule_id", "s"), ("Dependencies / Required Inputs", "dependencies", "s"), ("Commercial / Engineering Notes", "notes", "s"),
    ],
    "product": [
        ("Product ID", "product_id", "s"), ("Product Model", "model", "s"), ("Product Family ID", "family_id", "s"), ("Product Family", "family_name", "s"), ("Applicable Scenario IDs", "applicable_scenarios", "l"), ("Primary Asset Type", "primary_asset_type", "s"),
        ("Product Description", "description", "s"), ("Supported Standards", "supported_standards", "s"), ("Communication Protocols", "protocols", "s"), ("Default Quantity Rule ID", "default_quantity_rule_id", "s"), ("Status", "status", "s", "TBD"), ("Notes", "notes", "s"),
    ],
    "parameter": [
        ("Product ID", "product_id", "s"), ("Product Model", "model", "s"), ("Product Family ID", "family_id", "s"), ("Parameter ID", "metric_id", "s"), ("Parameter Name", "parameter_name", "s"), ("Min Value", "min_value", "d"), ("Max Value", "max_value", "d"),
        ("Supported Value / Text", "supported_value", "s"), ("Unit", "unit", "s"), ("Match Type", "match_type", "s"), ("Match Priority", "match_priority", "s"), ("Notes", "notes", "s"),
    ],
    "quantity rule": [
        ("Quantity Rule ID", "rule_id", "s"), ("Scenario ID", "scenario_ids", "l"), ("Product Family ID", "family_id", "s"), ("Product Family", "family_name", "s"), ("Quantity Basis", "quantity_basis", "s"), ("Rule Description", "description", "s"),
        ("Need Drawing", "need_drawing", "s"), ("Need Asset List", "need_asset_list", "s"), ("Count Field", "count_field", "s"), ("Example", "example", "s"), ("Assumption / Risk", "assumption", "s"),
    ],
    "compatibility rule": [
        ("Rule ID", "rule_id", "s"), ("Rule Type", "rule_type", "s"), ("Scenario ID", "scenario_id", "s"), ("Asset Type", "asset_type", "s"), ("Condition / Trigger", "condition", "s"), ("Recommended Action", "action", "s"), ("Severity", "severity", "s", "Medium"), ("Notes", "notes", "s"),
    ],
    "missing information": [
        ("Missing Information Item", "missing_item", "s"), ("Project ID", "project_id", "s"), ("Related Scenario ID", "scenario_id", "s"), ("Why It Matters", "why_it_matters", "s"), ("Suggested Customer / Engineer Question", "question", "s"),
        ("Priority", "priority", "s", "Medium"), ("Owner", "owner", "s"), ("Status", "status", "s", "Open"), ("Notes", "notes", "s"),
    ],
}
#: Tables that may lack their header, and the headers searched for where that is not the key.
OPTIONAL, SEARCHED = ["missing information"], {"missing information": "Project ID"}


def header_row(cells: DataFrame, first: str) -> int | None:
    """Row number of the first row of (row, cells) that has a cell equal to first, in any case."""
    hit = F.exists("cells", lambda c: F.lower(squeezed(c)) == first.lower())
    return cells.where(hit).agg(F.min("row").alias("r")).first()["r"]


def _typed(c: Column, kind: str, blank: str = "") -> Column:
    text = squeezed(c)
    return split_list(text) if kind == "l" else text.try_cast("double") if kind == "d" else F.when(text == "", blank).otherwise(text)


def records(cells: DataFrame, name: str, optional: bool = False) -> DataFrame:
    """The rows of a table of TABLES below its header, in order (column row), without blank keys.

    Headers that the table doesn't name are left out, missing ones give empty cells. A missing header row is an error, or an
    empty table where optional.
    """
    columns = TABLES[name]
    searched = SEARCHED.get(name, columns[0][0])
    at = header_row(cells, searched)
    if at is None:
        if not (optional or name in OPTIONAL):
            raise ValueError(f"no header {searched!r}")
        heads, at = [], -1
        cells = cells.limit(0)
    else:
        heads = [(h or "").strip() for h in cells.where(F.col("row") == at).first()["cells"]]
    place = {h: k for k, h in reversed(list(enumerate(heads))) if h}
    picked = [_typed(F.get("cells", F.lit(place[h])) if h in place else F.lit(""), *kind).alias(n) for h, n, *kind in columns]
    return cells.where(F.col("row") > at).select("row", *picked).where(F.col(columns[0][1]) != "")


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the last one's values in the first one's place."""
    rest = [c for c in rows.columns if c not in (key, "row")]
    return rows.groupBy(key).agg(F.min("row").alias("row"), F.max_by(F.struct(*rest), F.col("row")).alias("v")).select("row", key, "v.*")


def package(cells: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of a package of sheets (name -> cells), kept in memory or on disk after their first use; a sheet that is missing is an error unless it may be."""
    out = {}
    for name in TABLES:
        if name not in cells and name not in OPTIONAL:
            raise ValueError(f"no sheet for {name!r}")
        some = cells.get(name)
        out[name] = records(some if some is not None else next(iter(cells.values())).limit(0), name).persist()
    return out


def priced_models(cells: DataFrame) -> DataFrame:
    """(row, section, model, part): rows with a part number below a header; a row of text alone names the section of those after it.

    The header is the first of the first 15 rows with "part no" in the second cell, else row 7.
    """
    second = F.lower(squeezed(F.get("cells", F.lit(1))))
    at = cells.where((F.col("row") <= 15) & F.contains(second, F.lit("part no"))).agg(F.coalesce(F.min("row"), F.lit(7)).alias("r")).first()["r"]
    model, part = squeezed(F.get("cells", F.lit(0))), squeezed(F.get("cells", F.lit(1)))
    body = cells.where(F.col("row") > at).select("row", F.lit(0).alias("one"), model.alias("model"), part.alias("part"))
    named = body.withColumn("head", F.when((F.col("part") == "") & (F.col("model") != ""), F.col("model")))
    return carried(named, ["one"], "head", "row", "section").where("part <> ''").select("row", F.coalesce("section", F.lit("")).alias("section"), "model", "part")
