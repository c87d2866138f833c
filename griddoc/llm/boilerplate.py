"""Lines repeated across one file's segments.

State is two count tables that only ever grow by merging, and one that only grows by appending:

* file_rows(f1, f2, n_rows)      - rows of each file, null texts counted
* line_rows(f1, f2, line, n)     - rows of each file that hold a line
* postings(f1, f2, line, seg_id) - which rows these are, partitioned by a bucket of the key where it is stored

A new partition of segments is counted on its own (count_delta), merged (merge_counts), and the lines that crossed the
threshold in either direction are found (crossings); the rows that hold such a line are read off the postings, no text is
read again (rows_to_rebuild), and only these are rebuilt. A full build is the same with an empty state.

Keys are hashes: a file is 96 bits (f1, f2), a line 64 bits within its file, so lines are compared without shipping text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from griddoc.session import checkpointed, small

#: A line is boilerplate if it stands in at least MIN_ROWS rows and in at least one row of MIN_SHARE_OF of its file.
MIN_ROWS = 4
MIN_SHARE_OF = 5
FILE = ["f1", "f2"]
KEY = ["f1", "f2", "line"]


@dataclass(frozen=True)
class Counts:
    """The two count tables."""

    file_rows: DataFrame
    line_rows: DataFrame

    def write(self, folder: str) -> None:
        """Store both tables in a new folder; the state merged from an older folder must not overwrite that folder."""
        self.file_rows.write.parquet(f"{folder}/file_rows")
        self.line_rows.write.parquet(f"{folder}/line_rows")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Counts:
        return Counts(spark.read.parquet(f"{folder}/file_rows"), spark.read.parquet(f"{folder}/line_rows"))


#: Folders over which stored postings are spread; crossings only read those of their keys.
BUCKETS = 256


def write_postings(rows: DataFrame, folder: str) -> None:
    """Append the postings of a partition of segments to a stored table."""
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).alias("bucket")
    postings(rows).select(bucket, *KEY, "seg_id").write.mode("append").partitionBy("bucket").parquet(folder)


def read_postings(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The stored postings in the buckets of keys (few after one partition; all of them at the most)."""
    buckets = [r["b"] for r in keys.select(F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).alias("b")).distinct().collect()]
    return spark.read.parquet(folder).where(F.col("bucket").isin(buckets)).drop("bucket")


def _file_key() -> list:
    name, missing = F.coalesce(F.col("file_name"), F.lit("")), F.col("file_name").isNull()
    return [F.xxhash64(name, missing).alias("f1"), F.hash(missing, name).alias("f2")]


def _letters(text="text"):
    """The text's letters and line breaks, in lower case."""
    return F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\n]+", "")


def count_delta(rows: DataFrame) -> Counts:
    """Counts of one partition of segments (file_name, text). A line counts once per row; lines without letters never."""
    keyed = rows.select(*_file_key(), _letters().alias("letters"))
    file_rows = keyed.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n_rows"))
    lines = keyed.select(*FILE, F.explode(F.array_distinct(F.split("letters", "\n"))).alias("l")).where("l <> ''")
    line_rows = lines.select(*FILE, F.xxhash64("l").alias("line")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return Counts(file_rows, line_rows)


def merge_counts(state: Counts | None, delta: Counts) -> Counts:
    """State plus delta, both summed by key; no state is an empty one."""
    if state is None:
        return delta
    return Counts(
        state.file_rows.unionByName(delta.file_rows).groupBy(*FILE).agg(F.sum("n_rows").alias("n_rows")),
        state.line_rows.unionByName(delta.line_rows).groupBy(*KEY).agg(F.sum("n").alias("n")),
    )


def frequent(state: Counts) -> DataFrame:
    """Keys over the threshold. Only lines in MIN_ROWS rows or more are joined to the row counts."""
    often = state.line_rows.where(F.col("n") >= MIN_ROWS)
    total = state.file_rows.where(F.col("n_rows") >= MIN_ROWS)
    return often.join(total, FILE).where(F.col("n") * MIN_SHARE_OF >= F.col("n_rows")).select(*KEY)


def crossings(before: Counts | None, after: Counts) -> DataFrame:
    """Keys whose state changed, with now = whether they are over the threshold after the merge."""
    new = frequent(after).withColumn("now", F.lit(True))
    if before is None:
        return new
    old = frequent(before).withColumn("was", F.lit(True))
    both = old.join(new, KEY, "full_outer")
    return both.where("was is null or now is null").select(*KEY, F.coalesce("now", F.lit(False)).alias("now"))


def lines_of(rows: DataFrame) -> DataFrame:
    """One row per line that has letters: seg_id, line_no (from 1 over the text split at newlines) and its key."""
    keyed = rows.select("seg_id", *_file_key(), F.posexplode(F.split(_letters(), "\n")).alias("pos", "l")).where("l <> ''")
    return keyed.select("seg_id", (F.col("pos") + 1).alias("line_no"), *FILE, F.xxhash64("l").alias("line"))


def repeated_lines(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(seg_id, line_no) of every line whose key is in keys. Keys are broadcast only if they are few, after a count."""
    return lines_of(rows).join(small(checkpointed(keys.select(*KEY))), KEY, "left_semi").select("seg_id", "line_no")


def find(rows: DataFrame, state: Counts | None = None) -> DataFrame:
    """Boilerplate lines of rows, given the counts of earlier partitions.

    Null and empty texts give no line; a null file_name is a file of its own; repeated rows each count; an empty table
    gives an empty result; other columns are ignored.
    """
    return repeated_lines(rows, frequent(merge_counts(state, count_delta(rows))))


def remove(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with column clean: the text without the lines of keys. Null texts stay null.

    The keys of a file, at most MIN_SHARE_OF times the lines of its average row, come to its rows as one list, which is broadcast
    if there are few; so no text is shuffled then.
    """
    of_file = keys.groupBy(*FILE).agg(F.collect_set("line").alias("_drop"))
    one = rows.withColumns(dict(zip(("_f1", "_f2"), _file_key()))).withColumn("_lines", F.split("text", "\n"))
    j = one.join(small(checkpointed(of_file.withColumnsRenamed({"f1": "_f1", "f2": "_f2"}))), ["_f1", "_f2"], "left")
    bare = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]+", "")
    kept = F.filter("_lines", lambda x: ~((bare(x) != "") & F.array_contains("_drop", F.xxhash64(bare(x)))))
    clean = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return j.withColumn("clean", F.when(F.col("text").isNotNull(), clean)).drop("_f1", "_f2", "_lines", "_drop")


def postings(rows: DataFrame) -> DataFrame:
    """(f1, f2, line, seg_id): which rows hold which line."""
    lines = rows.select("seg_id", *_file_key(), F.explode(F.array_distinct(F.split(_letters(), "\n"))).alias("l")).where("l <> ''")
    return lines.select(*FILE, F.xxhash64("l").alias("line"), "seg_id")


def rows_to_rebuild(posted: DataFrame, changed: DataFrame) -> DataFrame:
    """seg_ids of the posted rows that hold a line of changed, the keys which crossed the threshold with the last merge."""
    return posted.join(small(checkpointed(changed.select(*KEY))), KEY, "left_semi").select("seg_id").distinct()
