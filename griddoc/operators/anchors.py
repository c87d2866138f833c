"""Selection of the regions of documents that speak of a vocabulary: anchors, their surroundings, chunks.

Composed of: anchor terms found by one automaton pass; a radius by how long a document's segments are; islands around the
anchors; contents pages left out; the rest packed into chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from griddoc.functions import text as X
from griddoc.operators import regions
from griddoc.operators.match import VOCABULARY
from griddoc.operators.running import running_sum
from griddoc.session import checkpointed

#: Shortest anchor, and the mark of text that was read off an image, which is an anchor by itself.
SHORTEST, READ_OFF = 2, "[VLM OCR of embedded image]"


def anchor_terms(terms: DataFrame) -> list[str]:
    """The distinct anchors among terms (term, kind), longest first, equals by name: all but short ones and ambiguous keywords."""
    t = terms.select(F.lower(F.trim("term")).alias("term"), "kind").where(F.length("term") >= SHORTEST)
    rows = t.where(~X.is_ambiguous(F.col("term")) | (F.col("kind") != "keyword")).select("term").distinct().limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} terms")
    return sorted((r["term"] for r in rows), key=lambda x: (-len(x), x))


def anchored(segments: DataFrame, terms: list[str], key: str = "seg_id") -> DataFrame:
    """key of the segments that hold an anchor as a word, or its plural, of which the first hit is not excluded by its surroundings."""
    shared = segments.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for t in shared.value:
            machine.add_word(t, t)
        if shared.value:
            machine.make_automaton()
        word = set("abcdefghijklmnopqrstuvwxyz0123456789")

        def ends(s: str, at: int) -> bool:
            return at >= len(s) or s[at] not in word

        def is_anchor(s: str) -> bool:
            seen = set()
            for end, t in machine.iter(s):
                start, at = end - len(t) + 1, end + 1
                if t in seen or t[0].isalnum() and start and s[start - 1] in word:
                    continue
                if t[-1].isalnum() and not (ends(s, at) or s[at : at + 1] == "s" and ends(s, at + 1) or s[at : at + 2] == "es" and ends(s, at + 2)):
                    continue
                seen.add(t)
                near = s[max(0, start - X.BEHIND) : start + X.AHEAD]
                if not any(c in near for c in X.EXCLUSION_CUES):
                    return True
            return False

        for b in batches if shared.value else ():
            kept = [is_anchor(s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(kept, pa.bool_()))], [key])

    found = segments.where(F.col("text").isNotNull()).select(F.lower("text").alias("_low"), F.col(key)).mapInArrow(run, f"{key} {dict(segments.dtypes)[key]}")
    return found.unionByName(segments.where(F.contains("text", F.lit(READ_OFF))).select(key)).distinct()


def select(segments: DataFrame, terms: DataFrame, limit: int = 40_000) -> DataFrame:
    """(file_name, seg_id, chunk): the segments within reach of an anchor, packed in order.

    segments: file_name, seg_id, seg_ord, text. The reach is two segments on each side, none where segments are long on average.
    Blank segments and contents pages are counted as neighbours but not selected.
    """
    s = segments.select("file_name", "seg_id", "seg_ord", "text")
    placed = running_sum(s.withColumn("one", F.lit(1)), ["file_name"], ["seg_ord", "seg_id"], "one", "at").withColumn("at", F.col("at") - 1)
    placed = checkpointed(placed.select("file_name", "seg_id", "seg_ord", "at", F.coalesce(F.trim("text"), F.lit("")).alias("bare"), "text"))
    hits = placed.join(anchored(placed.where("bare <> ''"), anchor_terms(terms)), "seg_id", "left_semi").select("file_name", F.col("at").alias("seg_ord"))
    sizes = placed.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    wide = sizes.where(F.col("chars") < 1000 * F.col("n"))
    long = sizes.where(F.col("chars") >= 1000 * F.col("n"))
    spans = regions.islands(hits, wide, 2).unionByName(regions.islands(hits, long, 0))
    each = spans.select(F.col("file_name").alias("of"), F.explode(F.sequence("lo", "hi")).alias("near"))
    taken = placed.join(each, F.col("file_name").eqNullSafe(F.col("of")) & (F.col("at") == F.col("near")), "left_semi")
    taken = taken.where((F.col("bare") != "") & ~X.is_contents(F.col("text")))
    return regions.pack(taken.select("file_name", "seg_id", "seg_ord", F.length("bare").alias("size")), limit)
