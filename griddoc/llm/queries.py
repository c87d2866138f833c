"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from griddoc.llm import boilerplate, canonical, entitymatch, leakage, mailtext, scanrepair, tokenize, truncation
from griddoc.session import table


def p1_found(spark, d):
    return boilerplate.find(table(spark, d, "doc_segment"))


def p1_clean(spark, d):
    rows = table(spark, d, "doc_segment").select("seg_id", "file_name", "text")
    return boilerplate.remove(rows, boilerplate.frequent(boilerplate.count_delta(rows))).select("seg_id", "clean")


def p1_rebuilt(spark, d):
    """Rows to rebuild when the segments loaded since July 2025 arrive after all earlier ones."""
    rows = table(spark, d, "doc_segment")
    late = F.coalesce(F.col("loaded_at") >= F.lit("2025-07-01").cast("timestamp_ntz"), F.lit(False))
    before = boilerplate.count_delta(rows.where(~late))
    after = boilerplate.merge_counts(before, boilerplate.count_delta(rows.where(late)))
    return boilerplate.rows_to_rebuild(boilerplate.postings(rows), boilerplate.crossings(before, after))


def p3_found(spark, d):
    return scanrepair.damaged(table(spark, d, "doc_segment"))


def p5_found(spark, d):
    return p5_matches(spark, d).select("cand_id", "product_id")


def p5_matches(spark, d):
    return entitymatch.match(table(spark, d, "product_master"), table(spark, d, "datasheet_product"))


def p6_found(spark, d):
    return mailtext.written(table(spark, d, "doc_segment"))


def p7_found(spark, d):
    return canonical.match(table(spark, d, "synonym_mapping"), table(spark, d, "unmapped_parameter"), table(spark, d, "metric_dictionary"))


def p8_ids(spark, d):
    return tokenize.encode(table(spark, d, "documents"))


def p8_decoded(spark, d):
    return tokenize.decode(tokenize.encode(table(spark, d, "documents")))


def p9_found(spark, d):
    return leakage.leaks(table(spark, d, "eval_item"), table(spark, d, "documents"))


def p10_found(spark, d):
    return truncation.cut(table(spark, d, "documents"))


def p10_share(spark, d):
    return truncation.cut_share(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p1_rebuilt, p3_found, p5_found, p5_matches, p6_found, p7_found, p8_ids, p8_decoded, p9_found, p10_found, p10_share)}
SQL = {
    "p1_found": r"""
        with l as (
            select seg_id, coalesce(file_name, '') as f, generate_subscripts(string_split(text, chr(10)), 1) as line_no,
                   regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^\p{L}]', '', 'g') as k
            from doc_segment where text is not null),
        n as (select coalesce(file_name, '') as f, count(*) as n_rows from doc_segment group by 1),
        c as (select f, k, count(distinct seg_id) as n from l where k <> '' group by 1, 2)
        select l.seg_id, cast(l.line_no as integer) as line_no
        from l join c using (f, k) join n using (f) where c.n >= 4 and c.n * 5 >= n.n_rows""",
    "p1_clean": r"""
        with l as (
            select seg_id, coalesce(file_name, '') as f, generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as t from doc_segment where text is not null),
        k as (select *, regexp_replace(lower(t), '[^\p{L}]', '', 'g') as k from l),
        n as (select coalesce(file_name, '') as f, count(*) as n_rows from doc_segment group by 1),
        c as (select f, k from (select f, k, count(distinct seg_id) as n from k where k <> '' group by 1, 2) join n using (f) where n >= 4 and n * 5 >= n_rows),
        a as (select seg_id, string_agg(t, chr(10) order by line_no) as clean from k left join c using (f, k) where c.k is null group by 1)
        select s.seg_id, case when s.text is not null then coalesce(a.clean, '') end as clean from doc_segment s left join a using (seg_id)""",
    "p1_rebuilt": r"""
        with l as (
            select seg_id, coalesce(file_name, '') as f, coalesce(loaded_at >= timestamp '2025-07-01', false) as late,
                   regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^\p{L}]', '', 'g') as k
            from doc_segment where text is not null),
        n as (select coalesce(file_name, '') as f, count(*) as n_after, count(*) filter (not coalesce(loaded_at >= timestamp '2025-07-01', false)) as n_before from doc_segment group by 1),
        c as (select f, k, count(distinct seg_id) as after, count(distinct seg_id) filter (not late) as before from l where k <> '' group by 1, 2),
        x as (select f, k from c join n using (f) where (after >= 4 and after * 5 >= n_after) <> (before >= 4 and before * 5 >= n_before))
        select distinct seg_id from l join x using (f, k)""",
    "p9_found": r"""
        with i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_item),
        d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
        ig as (select item_id, array_to_string(w[k:k + 11], ' ') as g from (select item_id, w, unnest(generate_series(1, len(w) - 11)) as k from i)),
        dg as (select doc_id, array_to_string(w[k:k + 11], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 11)) as k from d))
        select distinct item_id, doc_id from ig join dg using (g)""",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
