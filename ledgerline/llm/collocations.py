"""Phrase collocations by growing frequent prefixes to the right, as PrefixSpan does, without gaps.

A phrase is a run of 2 to ``LONGEST`` words inside a piece of text; a language's phrases are
counted apart. A phrase can be frequent only if each pair in it is. So:

1. One pass counts words, and pairs in 2 ** ``BITS`` hashed counters that saturate at the
   threshold. The counters' sum is a filter of fixed size (2 MB) that passes all frequent pairs;
   what it passes besides only costs work. In very large corpora it passes ever more, and the rest
   of the work stays in proportion to the text.
2. A second pass projects: each occurrence of a pair that passes becomes the pair with what may
   follow it, equal ones of a run of texts being one row with a count. Spark deals these rows
   by prefix (language and first two words) and sorts each partition, so the occurrences of any
   longer prefix are a range of rows, and pointers to its ends project it.
3. A task takes prefix after prefix, finds the ranges of the next word, and goes depth first into
   those that are frequent. Ranges at the edge of an Arrow batch are counted in parts that
   Spark adds up, so no prefix is ever held whole.

A pair with more than 1 of 500 of the rows would make one task slow. Such pairs, 1,000 at most,
are found by their counters in the first pass; their rows are dealt by the whole row, and
their counts are added up in parts.

Scores are exact: counts are decimals of 38 digits before they are divided. Each language's first
rows are taken within 256 parts of its phrases first, so no task sorts all phrases of a language.

Defined cases: null texts are empty, null languages ``und``. Repeated rows count as often as they stand,
an empty table gives an empty result, ties go to the smaller phrase in the order of UTF-8
bytes. Very long texts are read whole, in memory in proportion to the longest text. Extra
columns are not read, so none can clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, ship, text_runs

LONGEST = 4
#: Occurrences that make a phrase a candidate; its share of a phrase inside it that drops that; rows a language.
LEAST, COVERS, FIRST = 30, 80, 2000
#: Hashed counters of the pair filter, by their binary logarithm; counters of one row when they are summed.
BITS, CHUNK = 24, 1 << 16
#: A pair with this share of a run's pairs is reported; see the docstring.
_HEAVY = 1000
#: Texts of about so many bytes are counted together; words that a task knows by number.
RUN, KNOWN = 4 << 20, 400_000
#: A-Z lower-cased, what ends a piece made one byte that no text has, tabs made blanks.
_END = 255
_FOLD = bytes(b + 32 if 65 <= b <= 90 else _END if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words(dict):
    """Numbers of words as a task meets them; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[bytes] = []
        self.hashes = array("Q")
        self[bytes([_END])]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(crc32(word))
        return n

    def number(self, texts: list[bytes]) -> np.ndarray:
        """The texts' words as numbers, with a 0 after each piece."""
        end = bytes([_END])
        words = end.join([*texts, b"", b""]).translate(_FOLD).replace(end, b" " + end + b" ").split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def bucket(self, left: np.ndarray, right: np.ndarray, lang: str) -> np.ndarray:
        """The hashed counter of each pair of words."""
        h = np.array(self.hashes, np.uint64)
        with np.errstate(over="ignore"):
            x = h[left] * _MIX[0] + h[right] * _MIX[1] + np.uint64(crc32(lang.encode())) * _MIX[2]
            x = (x ^ (x >> np.uint64(29))) * _MIX[2]
        return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _by_lang(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in text_runs(batches, "text_", RUN):
        groups: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang_").to_pylist(), batch.column("text_").cast(pa.binary()).to_pylist(), strict=True):
            groups.setdefault(lang, []).append(text)
        yield from groups.items()


def _count(least: int):
    """Task of the first pass: rows of words, of filter counters, and of heavy counters."""
    top = min(least, 255)

    def rows(lang=(), word=(), n=(), chunk=(), data=()) -> pa.RecordBatch:
        size = max(map(len, (lang, word, n, chunk, data)))
        full = lambda x, t: pa.array(x, t) if len(x) else pa.nulls(size, t)
        return pa.RecordBatch.from_arrays([full(lang, pa.string()), full(word, pa.binary()), full(n, pa.int64()), full(chunk, pa.int64()), full(data, pa.binary())], names=["lang", "word", "n", "chunk", "data"])

    def words_of(words: Words, counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            found = np.flatnonzero(c)
            for at in range(0, len(found), 50_000):
                part = found[at : at + 50_000]
                yield rows([lang] * len(part), [words.names[i] for i in part], c[part])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.zeros(1 << BITS, np.uint8)
        words, counts = Words(), {}
        for lang, texts in _by_lang(batches):
            ids = words.number(texts)
            new = np.bincount(ids, minlength=len(words.names))
            new[0] = 0
            if lang in counts:
                new[: len(counts[lang])] += counts[lang]
            counts[lang] = new
            pairs = words.bucket(ids[:-1], ids[1:], lang)[(ids[:-1] > 0) & (ids[1:] > 0)]
            found, n = np.unique(pairs, return_counts=True)
            filter_[found] = np.minimum(filter_[found] + np.minimum(n, top), top)
            heavy = n * _HEAVY > len(pairs)
            yield rows(n=n[heavy], chunk=found[heavy])
            if len(words.names) > KNOWN:
                yield from words_of(words, counts)
                words, counts = Words(), {}
        yield from words_of(words, counts)
        for k in range(0, 1 << BITS, CHUNK):
            if (part := filter_[k : k + CHUNK]).any():
                yield rows(chunk=[k // CHUNK], data=[compress(part.tobytes(), 1)])

    return run


def _passing(least: int):
    """Task that sums filter counters: one bit a counter."""
    top = min(least, 255)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = sums.setdefault(chunk, np.zeros(CHUNK, np.uint16))
                np.minimum(own + np.frombuffer(decompress(data), np.uint8), top, out=own)
        bits = [np.packbits(s >= top).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(bits, pa.binary())], names=["chunk", "bits"])

    return run


def _project(passing, hot):
    """Task of the second pass: pairs that pass, each with what may follow, equal ones counted."""

    def rows(words: Words, lang: str, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = keys[:, np.lexsort(keys[::-1])]
        first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        n, keys = np.diff(np.concatenate([first, [keys.shape[1]]])), keys[:, first]
        ids = [half for key in keys for half in (key >> 32, key & 0xFFFFFFFF)]
        # Rows of hot pairs are dealt by all that follows.
        salt = np.where(np.isin(words.bucket(ids[0], ids[1], lang), hot.value), keys[1] % 32_749 + 1, 0).astype(np.int32)
        known = pa.array([b"", *words.names[1:]], pa.binary()).cast(pa.string())
        for k in range(0, len(n), 50_000):
            # Words of a run that goes no further are null; a blank ends each word, so equal prefixes stand together.
            columns = [known.take(pa.array(i[k : k + 50_000], mask=i[k : k + 50_000] == 0)) for i in ids]
            runs = pc.binary_join_element_wise(*columns, "", " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(runs), np.int32))), runs, pa.array(n[k : k + 50_000]), pa.array(salt[k : k + 50_000])], names=["lang", "run", "n", "salt"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passing.value
        words = Words()
        for lang, texts in _by_lang(batches):
            if len(words.names) > KNOWN:
                words = Words()
            ids = words.number(texts)
            bucket = words.bucket(ids[:-1], ids[1:], lang)
            ok = (ids[:-1] > 0) & (ids[1:] > 0) & (bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1).astype(bool)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            ok = np.concatenate([ok, np.zeros(LONGEST, bool)])
            ids = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
            found, going = [ids[at], ids[at + 1]], np.ones(len(at), bool)
            for d in range(1, LONGEST - 1):
                going = going & ok[at + d]
                found.append(np.where(going, ids[at + d + 1], 0))
            yield from rows(words, lang, np.stack([found[i].astype(np.int64) << 32 | found[i + 1] for i in range(0, LONGEST, 2)]))

    return run


def _grow(least: int):
    """Task of the third step: depth-first growth over a sorted partition's prefixes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            cut = pc.split_pattern(batch.column("run"), " ")
            start, end = cut.offsets.to_numpy()[:-1], cut.offsets.to_numpy()[1:] - 1  # the last part is empty
            word = lambda k: cut.values.take(pa.array(np.minimum(start + k, end)))  # noqa: B023, E731
            named = [c.dictionary_encode() for c in (batch.column("lang"), *map(word, range(LONGEST)))]
            codes = [c.indices.to_numpy() for c in named]
            total = np.concatenate([[0], np.cumsum(batch.column("n").to_numpy())])
            salted = batch.column("salt").to_numpy() > 0
            out: list[tuple[str, str, int, int]] = []

            def extend(lo: int, hi: int, depth: int, prefix: tuple[str, ...]) -> None:
                own = codes[depth][lo:hi]
                bounds = [lo, *(np.flatnonzero(own[1:] != own[:-1]) + lo + 1).tolist(), hi]
                sums = total[bounds]
                for i, n in enumerate(np.diff(sums).tolist()):  # noqa: B023
                    a, b = bounds[i], bounds[i + 1]
                    # Counted in parts: what touches the batch's edge, and all of a hot pair.
                    if n < least and a and b < size and not salted[a]:
                        continue
                    word = named[depth].dictionary[int(codes[depth][a])].as_py()
                    if not word and depth:
                        continue
                    grown = (*prefix, word)
                    if depth > 1:
                        out.append((grown[0], " ".join(grown[1:]), depth, n))
                    if depth < LONGEST:
                        extend(a, b, depth + 1, grown)

            extend(0, size, 0, ())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "k", "n"])

    return run


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all runs of 1 to ``LONGEST`` words with f >= ``least``; (lang, n) of all words)."""
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.coalesce(lang, F.lit("und")).alias("lang_"), F.coalesce(text, F.lit("")).alias("text_"))
    counted = materialize(read.mapInArrow(_count(least), "lang string, word binary, n bigint, chunk bigint, data binary"), "counted")
    words = materialize(counted.filter("word is not null").groupBy("lang", F.decode("word", "UTF-8").alias("phrase")).agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    n_all = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = np.zeros((1 << BITS) >> 3, np.uint8)
    chunks = counted.filter("data is not null").select("chunk", "data").repartition("chunk")
    for chunk, found in chunks.mapInArrow(_passing(least), "chunk bigint, bits binary").collect():
        bits[chunk * (CHUNK >> 3) : (chunk + 1) * (CHUNK >> 3)] = np.frombuffer(found, np.uint8)
    heavy = counted.filter("word is null and data is null").groupBy("chunk").agg(F.sum("n").alias("n"))
    hot = np.array([r[0] for r in heavy.filter(F.col("n") * _HEAVY > n_all).select("chunk").collect()], np.int64)
    share = spark.sparkContext.broadcast
    rows = read.mapInArrow(_project(share(bits), share(hot)), "lang string, run string, n bigint, salt int")
    dealt = rows.repartition("lang", F.substring_index("run", " ", 2), "salt").sortWithinPartitions("lang", "run")
    parts = dealt.mapInArrow(_grow(least), "lang string, phrase string, k int, n bigint")
    grown = parts.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    single = words.filter(F.col("f") >= least).select("lang", "phrase", F.lit(1).alias("k"), "f")
    found = materialize(grown.unionByName(single), "phrases")
    totals = materialize(totals, "totals")
    drop_materialized(counted, words)
    return found, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covers: int = COVERS, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by their weakest cut."""
    found, totals = frequent_phrases(docs, text, lang, least)
    words = F.split("phrase", " ")
    candidates = found.filter("k > 1").withColumn("words", words)
    join = lambda start, size: F.array_join(F.slice("words", F.lit(start) if isinstance(start, int) else start, size), " ")
    cuts = [(c, s) for c in range(1, LONGEST) for s in ("l", "r")]
    ask = [F.when(F.col("k") > c, F.struct(F.lit(f"{s}{c}").alias("slot"), (join(1, F.lit(c)) if s == "l" else join(c + 1, F.col("k") - c)).alias("part"))) for c, s in cuts]
    asked = candidates.select("lang", "phrase", F.explode(F.array_compact(F.array(*ask))).alias("q")).select("lang", "phrase", "q.slot", "q.part")
    known = found.select(F.col("lang").alias("lang_"), F.col("phrase").alias("part_"), "f")
    parts = asked.join(known, (F.col("lang") == F.col("lang_")) & (F.col("part") == F.col("part_")))
    parts = parts.select("lang", "phrase", *(F.when(F.col("slot") == f"{s}{c}", F.col("f")).alias(f"{s}{c}") for c, s in cuts))
    # A longer phrase has a part of one word less that occurs no less often than it; so one word more is enough to test.
    inside = candidates.filter("k > 2").select("lang", F.explode(F.array(join(1, F.col("k") - 1), join(2, F.col("k") - 1))).alias("phrase"), F.col("f").alias("longer"))
    own = candidates.select("lang", "phrase", F.col("f").alias("a"))
    all_ = own.unionByName(parts, allowMissingColumns=True).unionByName(inside, allowMissingColumns=True)
    facts = all_.groupBy("lang", "phrase").agg(*(F.max(c).alias(c) for c in ("a", "longer", *(f"{s}{c}" for c, s in cuts))))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    kept = facts.filter(F.col("a").isNotNull() & (F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * covers)))
    scored = [
        F.when(F.col(f"l{c}").isNotNull(), F.struct(F.expr(f"cast(a as decimal(19,0)) * 2000000 div (cast(l{c} as decimal(19,0)) + cast(r{c} as decimal(19,0)))").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))
        for c in range(1, LONGEST)
    ]
    best = kept.withColumn("best", F.array_min(F.array_compact(F.array(*scored)))).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    near = best.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
