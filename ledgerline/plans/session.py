"""A session with the settings that the plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "ledgerline", **settings: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.mergeSchema": "false",
    } | settings
    builder = SparkSession.builder.appName(name)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
