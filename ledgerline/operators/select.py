"""One row a group, by a total order that is spelled out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(*keys: str) -> list[Column]:
    """Sort keys with nulls last in either direction; a leading '-' means descending."""
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]


def flipped(*keys: str) -> list[Column]:
    """The reverse of :func:`order`, nulls first: the first row is the one that sorts last."""
    return [F.col(k[1:]).asc_nulls_first() if k.startswith("-") else F.col(k).desc_nulls_first() for k in keys]


def _pick(df: DataFrame, by: list[str], keys: list[Column]) -> DataFrame:
    rank = "rank__"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).filter(F.col(rank) == 1).drop(rank)


def first_by(df: DataFrame, by: list[str], *keys: str) -> DataFrame:
    """The first row of each group."""
    return _pick(df, by, order(*keys))


def last_by(df: DataFrame, by: list[str], *keys: str) -> DataFrame:
    """The last row of each group; as unknown keys sort last, they win."""
    return _pick(df, by, flipped(*keys))


def middle_by(df: DataFrame, by: list[str], *keys: str) -> DataFrame:
    """Of each sorted group the row at place size // 2: middle of three, second of two, the only one."""
    w = Window.partitionBy(*by)
    place, size = "place__", "size__"
    ranked = df.withColumns({place: F.row_number().over(w.orderBy(*order(*keys))) - 1, size: F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col(place) == F.floor(F.col(size) / 2)).drop(place, size)


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows in the order of a hash of ``keys``: the same rows for the same data."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)
