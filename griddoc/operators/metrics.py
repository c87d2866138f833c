"""Values of metrics in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from griddoc.functions import text as X
from griddoc.operators.match import first_hits
from griddoc.session import small


def metric_values(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(file_name, metric_id, value, unit, seg_id, has_value): per document the first acceptable value of each metric named in it.

    terms: term_ord, term, metric_id, unit, data_type. Segments count in order, terms in their order, then values from left to
    right. A value must have a unit of the metric, or any unit if the metric has none; of text metrics the term itself is the
    value. A metric that is only named has the first place without value.
    """
    t = terms.select("term_ord", "term", "metric_id", X.tokens(F.col("unit")).alias("expected"), (F.lower(F.coalesce("data_type", F.lit(""))).rlike("text|list") | (F.lower(F.trim("unit")) == "text")).alias("wordy"))
    hits = first_hits(segments, terms, "seg_id", carry=("file_name", "seg_ord")).join(small(t), "term_ord")
    fits = F.filter(X.values_in(F.col("near")), lambda v: X.unit_fits(v["unit"], F.col("expected"), F.lit(False)))
    pair = lambda n, u: F.struct(n.alias("number"), u.alias("unit"))
    value = F.when(F.coalesce("wordy", F.lit(False)), pair(X.squeezed(F.col("term")), F.lit(""))).otherwise(F.get(F.transform(fits, lambda v: pair(v["number"], v["unit"])), F.lit(0)))
    rows = hits.select("file_name", "metric_id", "seg_ord", "seg_id", "term_ord", value.alias("v"))
    best = F.min(F.struct(F.col("v").isNull().alias("none"), "seg_ord", "seg_id", "term_ord", "v")).alias("b")
    g = rows.groupBy("file_name", "metric_id").agg(best)
    return g.select("file_name", "metric_id", F.coalesce("b.v.number", F.lit("")).alias("value"), F.coalesce("b.v.unit", F.lit("")).alias("unit"), "b.seg_id", (~F.col("b.none")).alias("has_value"))
