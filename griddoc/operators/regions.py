"""Regions of documents: running lines, islands around anchors, chunks, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from griddoc.functions import text as X
from griddoc.operators.running import joined, previous, ranges, running_sum
from griddoc.session import checkpointed


def running_boilerplate(pages: DataFrame, min_pages: int = 5, longest: int = 100) -> DataFrame:
    """(file_name, line): short lines on half the pages, and four at least, of a document of min_pages pages or more.

    pages: file_name, seg_id, location, text. A page is a segment whose location begins with "page ".
    """
    p = pages.where(F.lower(F.coalesce("location", F.lit(""))).startswith("page "))
    n = p.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    lines = p.select("file_name", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), X.normal_key))).alias("line")).where((F.col("line") != "") & (F.length("line") <= longest))
    often = lines.groupBy("file_name", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    return often.join(n, "file_name").where(F.col("n") >= F.greatest(F.lit(4), F.floor(F.col("n_pages") / 2))).select("file_name", "line", "n", "n_pages")


def islands(anchors: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """(file_name, lo, hi): anchors (file_name, seg_ord) widened by radius within 0..n-1, overlapping or adjacent ones merged.

    sizes: file_name, n. With one radius for all, both ends grow with the anchor, so each anchor only looks at the one before it.
    """
    spans = anchors.distinct().join(sizes, "file_name").select("file_name", F.greatest(F.col("seg_ord") - radius, F.lit(0)).alias("lo"), F.least(F.col("seg_ord") + radius, F.col("n") - 1).alias("hi"))
    before = previous(spans, ["file_name"], ["lo", "hi"], "hi", "ahead")
    marked = before.withColumn("fresh", (F.col("ahead").isNull() | (F.col("lo") > F.col("ahead") + 1)).cast("int"))
    grouped = running_sum(marked, ["file_name"], ["lo", "hi"], "fresh", "g")
    return grouped.groupBy("file_name", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


def _breaks(size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What a range of segments does to a chunk that is open before it: (fill, chunks, used, total).

    The open chunk is closed before the first segment i for which it holds more than fill[i]; the range then begins chunks[i]
    chunks and leaves used[i] in the last one. If it is never closed, it grows by total. fill only falls, so the segments after
    the one that no open chunk takes are left out.
    """
    n = len(size)
    before = np.concatenate(([0], np.cumsum(size + 1)))
    reach = before[:-1] + size
    following = np.maximum(np.searchsorted(reach, limit + before[:-1], side="right"), np.arange(1, n + 1))
    chunks, used = np.ones(n, np.int64), before[-1] - before[:-1]
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            chunks[i] += chunks[following[i]]
            used[i] = used[following[i]]
    last = min(max(int(np.searchsorted(reach, limit, side="right")), 1), n - 1) + 1
    return limit - reach[:last], chunks[:last], used[:last], int(before[-1])


def pack(segments: DataFrame, limit: int = 40_000) -> DataFrame:
    """(file_name, seg_id, chunk): segments packed in order into chunks of at most limit characters, never split.

    segments: file_name, seg_id, seg_ord, size. A document is cut into ranges; each range is summed up as what it does to a chunk
    that is open before it, the summaries of documents that lie in several ranges (fewer than there are ranges) are composed, and each range
    is numbered from the chunk it begins in.
    """
    order = ["file_name", "seg_ord", "seg_id"]
    cut = ranges(segments.where("size > 0").select(*order, F.col("size").cast("long").alias("size")), order[:1], order[1:])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, at, sizes = [], [], []
        for b in batches:
            for f, r, size in zip(b["file_name"], b["_range"], b["size"]):
                if not names or names[-1] != f:
                    names.append(f)
                    at.append(r)
                    sizes.append([])
                sizes[-1].append(size)
        # A document that neither begins nor ends the range lies within it.
        for k in {0, len(names) - 1} if names else ():
            fill, chunks, used, total = _breaks(np.array(sizes[k], np.int64), limit)
            yield pd.DataFrame({"file_name": [names[k]], "_range": [at[k]], "fill": [fill], "chunks": [chunks], "used": [used], "total": [total]})

    def begun(rows: pd.DataFrame) -> pd.DataFrame:
        chunk, held, out = 0, 0, []
        rows = rows.sort_values("_range")
        for fill, chunks, used, total in zip(rows["fill"], rows["chunks"], rows["used"], rows["total"]):
            out.append((chunk, held))
            at = int(np.searchsorted(-np.asarray(fill), -held, side="right"))
            at = at if held else max(at, 1)
            if at < len(fill):
                chunk, held = chunk + int(chunks[at]), int(used[at])
            else:
                held += int(total)
        return pd.DataFrame({"file_name": rows["file_name"], "_range": rows["_range"], "_chunk": [c for c, _ in out], "_held": [h for _, h in out]})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, chunk, held = object(), 0, 0
        for b in batches:
            out = []
            for f, size, c, h in zip(b["file_name"], b["size"], b["_chunk"], b["_held"]):
                if f != name:
                    name, chunk, held = f, c, h
                if held and held + size > limit:
                    chunk, held = chunk + 1, 0
                held += size + 1
                out.append(chunk)
            yield pd.DataFrame({"file_name": b["file_name"], "seg_id": b["seg_id"], "chunk": out})

    does = checkpointed(cut.sortWithinPartitions(*order).mapInPandas(summed, "file_name string, _range int, fill array<long>, chunks array<long>, used array<long>, total long"))
    several = does.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file_name")
    split = does.alias("d").join(several.alias("s"), F.col("d.file_name").eqNullSafe(F.col("s.file_name")), "left_semi")
    starts = split.groupBy("file_name").applyInPandas(begun, "file_name string, _range int, _chunk int, _held long")
    placed = joined(cut, starts, ["file_name"]).fillna(0, ["_chunk", "_held"])
    return placed.sortWithinPartitions(*order).mapInPandas(numbered, "file_name string, seg_id long, chunk int")


def line_offsets(segments: DataFrame) -> DataFrame:
    """(file_name, seg_id, first_line, last_line): line numbers of each segment when the document's segments are joined by a line break."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    one = running_sum(segments.select("file_name", "seg_id", "seg_ord", n.alias("n")), ["file_name"], ["seg_ord", "seg_id"], "n", "last_line")
    return one.select("file_name", "seg_id", (F.col("last_line") - F.col("n") + 1).alias("first_line"), "last_line")


def radius_of(segments: DataFrame) -> DataFrame:
    """(file_name, radius): no neighbours where segments are long on average, else two on each side."""
    g = segments.groupBy("file_name").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count(F.lit(1)).alias("n"))
    return g.select("file_name", F.when(F.col("chars") >= 1000 * F.col("n"), 0).otherwise(2).alias("radius"))


def bounded_context(docs: DataFrame, budget: int = 9000, per_doc: int = 4000, per_drawing: int = 1500) -> DataFrame:
    """(project_id, doc_id, block): beginnings of each project's documents, prose first, until the budget is used; the last may overshoot."""
    drawing = F.coalesce(F.col("doc_type") == "Drawing / SLD", F.lit(False))
    block = F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.when(drawing, per_drawing).otherwise(per_doc))
    w = W.partitionBy("project_id").orderBy("drawing", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    one = docs.select("project_id", "doc_id", drawing.alias("drawing"), block.alias("block"))
    return one.withColumn("used", F.coalesce(F.sum(F.length("block")).over(w), F.lit(0))).where(F.col("used") < budget).select("project_id", "doc_id", "block")


def coverage(selected: DataFrame, every: DataFrame) -> DataFrame:
    """One row: characters selected and in all, and whether the selection is worth it (a large corpus, at most 80 percent)."""
    chars = lambda d, n: d.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias(n))
    both = chars(selected, "selected_chars").withColumn("k", F.lit(1)).join(chars(every, "total_chars").withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("use", (F.col("total_chars") > 80_000) & (F.col("selected_chars") * 10 <= F.col("total_chars") * 8))
