"""What Parquet footers tell about a dataset, without reading rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, changed_at) of each file of the dataset; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed_at"))


def footer_metrics(spark: SparkSession, path: str, columns: list[str] = ()) -> DataFrame:
    """One row: n_rows, n_columns, n_files, n_bytes, and min_ and max_ of ``columns``.

    Counts and extremes are pushed down to the scan, which answers them from row groups'
    statistics, task by task. Columns may be whole numbers, floats, dates or booleans: their
    statistics are exact. Spark does this for its newer Parquet source only, which is chosen for
    a session of its own, so the caller's settings stay.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = own.read.parquet(path)
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
    files = file_sizes(own, path).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"))
    scalars = {c: files.select(c).scalar() for c in ("n_files", "n_bytes")}
    return stats.withColumns({"n_columns": F.lit(len(df.columns)), **scalars})
