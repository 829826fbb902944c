"""Target-distribution importance resampling: hashed n-gram gains, exact distributed selection.

Each text is a bag of runs of one and two words, hashed by crc32 into a fixed number of
buckets. A bucket's gain is the log ratio of its smoothed share in the target texts to that
in the corpus, so one array of fixed size holds the whole model: it is counted by tasks,
summed by Spark, sent back once and gathered per text. A text's weight is its mean gain; a
seeded Gumbel variate of its id is added, which turns "the k greatest scores" into a draw
without replacement in proportion to exp(weight).

The k-th key is found by radix selection: the rows in question are counted by the leading
binary digits of the key (at most 2 ** ``DIGIT`` counts reach the driver), the digit that holds the
k-th row is entered, and so on over score, id and the tie columns, until the border is exact.
Only rows up to that key are sorted by range and numbered, by offsets of whole ranges, so no
task ever holds more than its range and rejected rows are never sorted.

Defined cases: a null or wordless text has no features, weight 0, and is never drawn if
``min_words`` is over 0. Null ids hash as empty text and sort first among equal scores.
Repeated rows count as often as they stand and are drawn one by one; ties go to the smaller
id, then to fewer features, then to any order, which changes no value. An empty target gives
flat smoothed shares, an empty table an empty result. Very long texts are read whole. Extra
columns are not carried, so none can clash; ids must be whole numbers (TypeError).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship, text_runs

#: Bits of a key that one pass of the selection counts; 2 ** DIGIT counts reach the driver.
DIGIT = 12
BUCKETS = 10_000
PERCENT = 25
MIN_WORDS = 20
SEED = 7
#: What stands between words is blanked and A-Z lower-cased, byte by byte: all of a
#: character's bytes beyond ASCII belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_hashes(text: bytes | None) -> np.ndarray:
    """crc32 of each word, then of each two neighbours joined by a blank."""
    words = (text or b"").translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint32)
    one = list(map(crc32, words))
    two = map(crc32, map(b" ".__add__, words[1:]), one)  # goes on from the crc of the word before
    return np.fromiter(chain(one, two), np.uint32, 2 * len(words) - 1)


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts; each task sends one row a bucket at most."""
    ship(df.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_runs(batches, text):
            for t in batch.column(text).cast(pa.binary()).to_pylist():
                total += np.bincount(feature_hashes(t) % buckets, minlength=buckets) if t else 0
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return df.select(text).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the smoothed shares' ratio, for each bucket: ``buckets`` numbers, whatever the input."""
    count = [np.zeros(buckets, dtype=object), np.zeros(buckets, dtype=object)]
    for out, df in zip(count, (corpus, target), strict=True):
        for bucket, n in bucket_counts(df, text, buckets).collect():
            out[bucket] = n
    s, t = count
    s_all, t_all = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * s_all / (float(a + 1) * t_all))) for a, b in zip(s, t, strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """floor(1000 x) of a Gumbel variate x that depends on seed and id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(df: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score) of each row."""
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(gains)
    names = [id_col, "n_features", "weight", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = model.value
        for batch in text_runs(batches, text):
            ids, texts = batch.column(id_col), batch.column(text).cast(pa.binary()).to_pylist()
            sizes, weights = [], []
            for t in texts:
                found = feature_hashes(t)
                sizes.append(len(found))
                weights.append(int(gain[found % len(gain)].sum()) // len(found) if len(found) else 0)
            scores = [w + gumbel(i, seed) for w, i in zip(weights, ids.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (sizes, weights, scores))], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_features bigint, weight bigint, score bigint")


def kth_key(rows: DataFrame, keys: list[str], k: int) -> tuple[int, ...] | None:
    """The k-th smallest (from 1) of ``rows`` in the order of ``keys``; None if there are fewer.

    The keys are non-null longs. A digit is a key's leading bits (an arithmetic shift), so
    negative values need no offset; each pass divides the rows in
    question by up to 2 ** ``DIGIT``.
    """
    for name in keys:
        lo, hi = rows.agg(F.min(name), F.max(name)).first()
        if lo is None:
            return None
        shift = 0
        while (hi >> shift) - (lo >> shift) >= 1 << DIGIT:
            shift += 1
        while True:
            digit = F.shiftright(name, shift)
            counts = sorted(tuple(r) for r in rows.groupBy(digit.alias("digit")).count().collect())
            for d, n in counts:  # noqa: B007
                if k <= n:
                    break
                k -= n
            else:
                return None
            rows = rows.filter(digit == d)
            if k == n:
                return tuple(rows.agg(F.max(F.struct(*keys))).first()[0])
            if not shift:
                break
            shift = max(0, shift - DIGIT)
    return tuple(rows.agg(F.max(F.struct(*keys))).first()[0])  # only equal rows are left


def number(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` plus their place from 1 in ``order``: sorted by range, offsets added by range."""
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written, since another run of the sampling might draw the ranges otherwise.
    cut = materialize(cut.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), tag)
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in cut.groupBy("part_").count().collect()):
        offsets.append((part, before))
        before += n
    known = cut.sparkSession.createDataFrame(offsets, "part_ int, before_ bigint")
    return cut.join(F.broadcast(known), "part_").withColumn("rank", F.col("before_") + F.col("at_") + 1)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text",
    percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank is null where a row isn't drawn.

    Drawn are ``percent`` of the rows with ``min_words`` words, by score.
    """
    gains = bucket_gains(docs, target, text, buckets)
    key = {"k0_": -F.col("score"), "k1_": F.col(id_col).isNotNull().cast("bigint"), "k2_": F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), "k3_": F.col("n_features"), "k4_": F.monotonically_increasing_id()}
    rows = materialize(weigh(docs, gains, id_col, text, seed).withColumns(key), "weighed")
    able = rows.filter(F.col("n_features") >= max(0, 2 * min_words - 1))
    k = percent * able.count() // 100
    out = [id_col, "n_features", "weight", "score"]
    border = kth_key(able, list(key), k) if k else None
    if border is None:
        return rows.select(*out, F.lit(None).cast("bigint").alias("rank"))
    drawn = (F.col("n_features") >= max(0, 2 * min_words - 1)) & (F.struct(*key) <= F.struct(*(F.lit(x).cast("bigint") for x in border)))
    ranked = number(rows.filter(drawn), list(key), "drawn")
    rest = rows.filter(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*out, "rank").unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, for ids that are unique."""
    ids = resample(docs, target, id_col, **how).filter("rank is not null").select(id_col)
    return docs.join(ids, id_col, "left_semi")
