"""Ratings as a stream: cleaned as they arrive, latest state a key and quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import in_set, lookup
from ..operators.ratings import EXCLUDED_CODES, MOODY_SCALE, SP_FITCH_SCALE, TERMINATOR_CODES

SCHEMA = T.StructType([
    T.StructField("issue_id", T.LongType()), T.StructField("rating_type", T.StringType()), T.StructField("rating", T.StringType()),
    T.StructField("known_at", T.TimestampType()),
])


def read_stream(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def worst_by_window(stream: DataFrame, window: str = "7 days", late: str = "2 days") -> DataFrame:
    """The most severe grade, and whether a spell ended, by issue, agency and window of the
    time at which a rating became known; state older than the watermark is dropped."""
    code = F.trim("rating")
    ordinal = F.when(F.col("rating_type") == "MR", lookup(MOODY_SCALE, code)).otherwise(lookup(SP_FITCH_SCALE, code)).cast("double")
    graded = stream.filter(~in_set(code, EXCLUDED_CODES)).withColumns({"ord": ordinal, "ended": in_set(code, TERMINATOR_CODES)})
    known = graded.filter(F.col("ord").isNotNull() | F.col("ended")).withWatermark("known_at", late)
    grouped = known.groupBy(F.window("known_at", window).alias("w"), "issue_id", "rating_type").agg(F.max("ord").alias("worst"), F.bool_or("ended").alias("ended"), F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "issue_id", "rating_type", "worst", "ended", "n")


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows as Parquet, once each."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
