"""Writing tables, manifests and reports; checks after writing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshots import write_text


def write_by_year(df: DataFrame, path: str, date: str) -> None:
    """One dataset with a folder a year, rows of a year dealt together; replaces what is there."""
    df.withColumn("year", F.year(date)).repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)


def manifest(df: DataFrame, key: list[str], date: str | None = None) -> dict:
    """Rows, columns, distinct keys and date range, from one job."""
    measures = [F.count(F.lit(1)).alias("rows"), F.count_distinct(*key).alias("distinct_keys")]
    if date:
        measures += [F.min(date).cast("string").alias("min_date"), F.max(date).cast("string").alias("max_date")]
    return df.agg(*measures).first().asDict() | {"columns": len(df.columns)}


def write_manifest(spark, path: str, content: dict) -> None:
    write_text(spark, path, json.dumps(content, sort_keys=True, indent=2, default=str))


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("-" for _ in df.columns), *map(line, rows)])


def check_written(source: DataFrame, written: DataFrame, required: list[str], date: str | None = None, years: tuple[int, int] | None = None) -> None:
    """Equal row counts, required columns, dates in the years; else ``ValueError``."""
    if missing := set(required) - set(written.columns):
        raise ValueError(f"written table lacks {sorted(missing)}")
    if (a := source.count()) != (b := written.count()):
        raise ValueError(f"{a} rows were to be written, {b} are there")
    if date and years and (n := written.filter(~F.year(date).between(*years)).count()):
        raise ValueError(f"{n} rows lie outside {years}")


def reconcile(window: DataFrame, undated: DataFrame, archived: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows of the window, rows without a date, rows archived, and keys that are missing or too many.

    A key is missing as often as it stands in the source more often than in the archive.
    """
    tagged = lambda df, name: df.select(*key, *(F.lit(int(name == n)).alias(n) for n in ("window_rows", "undated_rows", "archived_rows")))
    rows = tagged(window, "window_rows").unionByName(tagged(undated, "undated_rows")).unionByName(tagged(archived, "archived_rows"))
    counted = rows.groupBy(*key).agg(*(F.sum(n).alias(n) for n in ("window_rows", "undated_rows", "archived_rows")))
    open_ = F.col("window_rows") + F.col("undated_rows") - F.col("archived_rows")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = [zero(n).alias(n) for n in ("window_rows", "undated_rows", "archived_rows")]
    out = counted.agg(*sums, zero(F.greatest(open_, F.lit(0))).alias("missing_rows"), zero(F.greatest(-open_, F.lit(0))).alias("surplus_rows"))
    return out.withColumn("reconciled", (F.col("missing_rows") == 0) & (F.col("surplus_rows") == 0))
