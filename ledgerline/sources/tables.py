"""Reading tables: schemas, required columns, years, JDBC, cached fetches, discovery."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

_DATE_NAMES = ("date", "datadate", "rdq", "statpers", "trans_dt")


@dataclass(frozen=True)
class Dataset:
    """Where a dataset lies and what it must hold."""

    name: str
    path: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    date: str | None = None
    year_column: str | None = None


def scan(spark: SparkSession, data: Dataset, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """The dataset's columns, required ones checked, missing optional ones logged, years pruned."""
    df = spark.read.option("mergeSchema", "false").parquet(data.path)
    have = {c.lower(): c for c in df.columns}
    if missing := [c for c in data.required if c.lower() not in have]:
        raise ValueError(f"{data.name}: required columns {missing} are missing")
    if absent := [c for c in data.optional if c.lower() not in have]:
        log.warning("%s: columns %s are missing and left out", data.name, absent)
    if data.year_column and (first_year is not None or last_year is not None):
        df = df.filter(F.col(data.year_column).between(first_year or 0, last_year or 9999))
    elif data.date and first_year is not None and last_year is not None:
        df = df.filter(in_years(data.date, first_year, last_year))
    wanted = [have[c.lower()] for c in (*data.required, *data.optional) if c.lower() in have]
    return df.select(*wanted) if wanted else df


def in_years(date: str, first: int, last: int) -> Column:
    """Half-open range, which reaches the scan as a pushed filter."""
    return (F.col(date) >= F.lit(f"{first}-01-01").cast("date")) & (F.col(date) < F.lit(f"{last + 1}-01-01").cast("date"))


def undated(df: DataFrame, date: str) -> DataFrame:
    """Rows without a date; with those of the years they make up all rows."""
    return df.filter(F.col(date).isNull())


def concat(frames: Iterable[DataFrame]) -> DataFrame:
    """Bag union by name; columns that a frame lacks are null."""
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in the schema's types; values that don't fit become null, absent columns too."""
    have = set(df.columns)
    cols = []
    for f in schema:
        c = F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, date: str | None = None, years: range | None = None, fetchsize: int = 50_000, undated: bool = False, **options: str) -> DataFrame:
    """A query, or a table read by one predicate a year, so that years load side by side.

    With ``undated`` rows without a date are a part of their own.
    """
    if table and date and years:
        day = options.pop("day_literal", "DATE '{}'").format
        parts = [f"{date} >= {day(f'{y}-01-01')} AND {date} < {day(f'{y + 1}-01-01')}" for y in years]
        parts += [f"{date} IS NULL"] if undated else []
        return spark.read.jdbc(url, table, predicates=parts, properties={"fetchsize": str(fetchsize), **options})
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetchsize).options(**options)
    return reader.option("query", query).load() if query else reader.option("dbtable", table).load()


def first_table(spark: SparkSession, names: Iterable[str], required: Iterable[str]) -> str | None:
    """The first of the names that is a table with the required columns."""
    need = {c.lower() for c in required}
    for n in names:
        if spark.catalog.tableExists(n) and need <= {c.lower() for c in spark.table(n).columns}:
            return n
    return None


def describe(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema]


def date_column(schema: T.StructType, preferred: Iterable[str] = _DATE_NAMES) -> str | None:
    """A preferred name, else the first date-typed column, else the first with 'date' in its name."""
    names = {f.name.lower(): f.name for f in schema}
    for p in preferred:
        if p in names:
            return names[p]
    for f in schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return f.name
    return next((f.name for f in schema if "date" in f.name.lower() or f.name.lower().endswith("dt")), None)


def clipped_years(first: int, last: int, window: tuple[int, int]) -> range:
    return range(max(first, window[0]), min(last, window[1]) + 1)


def with_retry[X](f: Callable[[], X], attempts: int = 3, wait: float = 1.0) -> X:
    """Try again after 1, 2, ... times ``wait`` seconds doubled; the last error is raised."""
    for k in range(attempts):
        try:
            return f()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


def fetch_or_load(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], force: bool = False, valid: Callable[[DataFrame], bool] = lambda df: True) -> DataFrame:
    """The table at ``path`` if it is there and valid; else it is fetched, written and read back."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not force and place.getFileSystem(conf).exists(place):
        df = spark.read.parquet(path)
        if valid(df):
            return df
    with_retry(fetch).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def unique_columns(names: Iterable[str]) -> list[str]:
    """Names in their order, each once whatever its case, as it stands first."""
    first: dict[str, str] = {}
    for n in names:
        first.setdefault(n.lower(), n)
    return list(first.values())


def sql_literal(value: object) -> str:
    """A value as a SQL literal for a predicate that a database evaluates; ids of digits stay numbers."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def log_missing_years(df: DataFrame, year: str, first: int, last: int) -> list[int]:
    """The years from ``first`` to ``last`` without a row, logged; at most one number a year reaches the driver."""
    have = {r[0] for r in df.filter(F.col(year).between(first, last)).select(year).distinct().collect()}
    missing = [y for y in range(first, last + 1) if y not in have]
    if missing:
        log.warning("no rows of the years %s", missing)
    return missing
