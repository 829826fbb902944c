"""The corpus pipeline: five stages over ``documents``, each written and read again.

Defined cases, for every stage: an empty table gives an empty table of the same columns.
Null texts have no language and go in the first stage; a stage that is given them by itself
drops them too, but for near_dedup, which keeps each, and encode, which encodes them as
empty. Null ids come before all others. Very long texts are handled whole; repeated rows
get equal results, and near_dedup keeps all rows of a kept id. Extra columns pass through,
under their own names in all stages but the last, where a column that has the name of one
of its results is called ``<name>_given``. ``n_chars`` is renewed where there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontam, langid, linededup, minhash
from ledgerline.llm.common import drop_materialized, id_bucket, materialize, set_aside, table, tidy

#: A text goes in whole if more than this share of its words are benchmark words.
MAX_COVERAGE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language isn't one of those learned from the stage's own input."""
    model = langid.train(docs.filter(id_bucket("doc_id", 5) != 0))
    return langid.keep_identified(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out lines similar to earlier ones; documents that lose all their lines go."""
    cut = linededup.dedup_lines(docs)
    return _counted(cut.filter(F.col("text").rlike(r"\S")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    kept = minhash.near_duplicates(docs, percent=80).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out benchmark passages; a document that they cover for the most part goes."""
    plain, aside = set_aside(docs, "n_words", "n_hit", "hit_items", "longest_span", "covered")
    found = decontam.find_contamination(plain, table(spark, sf_dir, "benchmark"), cleaned=True, max_coverage=MAX_COVERAGE)
    kept = found.filter(~F.col("covered") & F.col("text").isNotNull())
    return _counted(kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text; the last stage returns digests of ids and of the decoded text."""
    plain, _ = set_aside(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode_digest(plain)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Language models and byte-pair encoding are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows go through a Parquet table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        after = materialize(stage(spark, docs, sf_dir), name)
        if k:
            drop_materialized(docs)
        tidy(spark)
        docs = after
    return docs
