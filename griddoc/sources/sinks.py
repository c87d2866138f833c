"""Writers: partitioned tables, append logs, quoted CSV, and publishing of a whole folder at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, overwritten; partitioned by columns where given."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; every cell quoted, quotes doubled, blanks kept."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def publish(df: DataFrame, path: str) -> None:
    """Write a new version beside the older ones, then point to it by replacing one small file, which is a single rename.

    Readers (read_published) see the old version or the new one, never half of it and never none. Versions before the one
    replaced are deleted.
    """
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(conf)
    version, before = f"v-{uuid.uuid4().hex}", _version(df.sparkSession, path)
    df.write.parquet(f"{path}/{version}")
    fresh = fs_path(f"{path}/_next-{version}")
    out = fs.create(fresh)
    out.write(bytearray(version, "ascii"))
    out.close()
    options = df.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, fs_path(f"{path}/_current"), options)
    for f in fs.listStatus(fs_path(path)):
        if f.getPath().getName().startswith("v-") and f.getPath().getName() not in (version, before):
            fs.delete(f.getPath(), True)


def _version(spark: SparkSession, path: str) -> str | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    current = jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    fs = current.getFileSystem(conf)
    if not fs.exists(current):
        return None
    stream = fs.open(current)
    try:
        return bytes(stream.readAllBytes()).decode("ascii")
    finally:
        stream.close()


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version that was published last."""
    return spark.read.parquet(f"{path}/{_version(spark, path)}")


def backed_up(df: DataFrame, path: str, stamp: str) -> None:
    """Overwrite a table after copying it to path with the stamp."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, copy = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{stamp}"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, target, fs, copy, False, conf)
    df.write.mode("overwrite").parquet(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object (column value); null cells are left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
