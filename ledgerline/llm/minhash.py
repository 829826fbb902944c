"""MinHash near-duplicate groups with b-bit signatures.

A document's set holds its different shingles of five words (lower-cased A-Z; words are
runs without ASCII white space); with fewer words the whole sequence is the one shingle.
Two documents are linked if their sets' Jaccard similarity reaches the threshold, and
groups are the connected components of the links.

1. One pass makes for each document its set's digest, band keys over full minima, and a
   signature of the low ``BITS`` bits of all minima, packed in bit planes.
2. Documents with equal sets are one class, shown by its smallest id. All else is done
   among classes, so copies never meet one by one.
3. Band keys propose pairs in three rounds: each member of a bucket with its smallest
   member; then, in buckets that still hold several components, with hubs drawn by hash;
   then all pairs of different components that are left, so no candidate is lost. Pairs
   in one component need no test, so a group of thousands of near copies costs a few
   tests a member and never all pairs.
4. A proposed pair passes if the collision-corrected estimate from the packed bits (bit
   counts of xor-ed planes) comes near the threshold, and if a parity sketch of the two
   sets allows it: the bits in which the sketches differ are at most the elements in which
   the sets differ, so that test never loses a link, and it keeps thousands of documents
   that are alike, yet not alike enough, from being compared text by text. Texts of pairs
   that pass are compared on full sets. Only that comparison makes a link.

Candidate buckets and links live in tables of the shared checkpoint folder; components
are found by alternating star contraction over them. Nothing that grows with the corpus
reaches the driver. Defined cases: null texts and texts without words have an empty set
and are linked with nothing; rows with a null id are alone, with a null component; rows
that share an id are one node; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, ship, text_runs

SHINGLE = 5
BANDS = 32
ROWS = 4
#: Low bits kept of each minimum.
BITS = 2
#: Standard deviations of the estimate that a pair may lie below the threshold.
SLACK = 6.0
#: Bits of a set's parity sketch.
PARITY = 1024
_K = BANDS * ROWS
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SEEDS = np.random.default_rng(20240607)
_MULTIPLY = _SEEDS.integers(0, 1 << 63, _K, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _SEEDS.integers(0, 1 << 63, _K, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALT = _SEEDS.integers(0, 1 << 63, max(SHINGLE, ROWS) + 1, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64, up to ``n``."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.full(size, _BASE)
        _inverse = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        _powers[0] = _inverse[0] = 1
        _powers, _inverse = np.multiply.accumulate(_powers), np.multiply.accumulate(_inverse)
    return _powers, _inverse


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different shingles."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_BLANK[raw]
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    powers, inverse = _tables(len(raw) + 1)
    running = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=running[1:])
    word = _mix((running[last] - running[first]) * inverse[first] + (last - first).astype(np.uint64) * _SALT[-1])
    n = max(1, len(word) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(word))):
        out += word[k : k + n] * _SALT[k]
    return np.unique(_mix(out + np.uint64(min(SHINGLE, len(word)))))


def shingle_set(text: str | None) -> set[bytes]:
    """The shingles themselves, words joined by blanks."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_TO_BLANK).split()
    if not found:
        return set()
    return {b" ".join(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1))}


_TO_BLANK = bytes(32 if _BLANK[c] else c for c in range(256))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the ``BANDS * ROWS`` hash functions over a set that isn't empty."""
    least = np.full(_K, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 2048):
        part = hashes[i : i + 2048]
        values = np.multiply.outer(_MULTIPLY, part)
        values += _ADD[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return _mix(least)


def signature(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, bit planes of the low bits: ``BITS`` times _K / 64 words)."""
    bands = least.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _SALT[-1]
    for r in range(ROWS):
        keys = _mix(keys + bands[:, r] * _SALT[r])
    planes = [np.packbits((least >> np.uint64(b) & np.uint64(1)).astype(np.uint8)).view(np.int64) for b in range(BITS)]
    return keys.view(np.int64), np.concatenate(planes)


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of ``PARITY`` buckets, whether an odd number of the set's elements falls in it."""
    counts = np.bincount((hashes >> np.uint64(20) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def sketch(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, digest of the set (null if empty), band keys, packed signature, parity sketch."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, text):
            n, digests, bands, packed, odd = [], [], [], [], []
            for t in batch.column(text):
                hashes = shingle_hashes(t.as_py())
                n.append(len(hashes))
                if not len(hashes):
                    digests.append(None)
                    bands.append(None)
                    packed.append(None)
                    odd.append(None)
                    continue
                keys, planes = signature(minima(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                bands.append(keys)
                packed.append(planes)
                odd.append(parity(hashes))
            longs = pa.list_(pa.int64())
            columns = [pa.array(n, type=pa.int64()), pa.array(digests, type=pa.binary()), pa.array(bands, type=longs), pa.array(packed, type=longs), pa.array(odd, type=longs)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "n_shingles", "digest", "bands", "packed", "odd"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles bigint, digest binary, bands array<bigint>, packed array<bigint>, odd array<bigint>")


def estimate(a: str, b: str) -> F.Column:
    """Similarity from two packed signatures, corrected for minima whose low bits agree by chance."""
    words = _K // 64
    differing = sum(
        F.bit_count(
            sum_or([F.col(a)[p * words + w].bitwiseXOR(F.col(b)[p * words + w]) for p in range(BITS)])
        )
        for w in range(words)
    )
    chance = 2.0**-BITS
    return (1 - differing / F.lit(float(_K)) - chance) / (1 - chance)


def sum_or(columns: list[F.Column]) -> F.Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseOR(c)
    return out


def _least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - SLACK * (agree * (1 - agree) / _K) ** 0.5 / (1 - chance)


def may_link(percent: int) -> F.Column:
    """Whether sketches ``a`` and ``b`` (n, packed, odd) leave it open that their sets are linked."""
    na, nb = F.col("sa.n"), F.col("sb.n")
    differing = sum(F.bit_count(F.col("sa.odd")[w].bitwiseXOR(F.col("sb.odd")[w])) for w in range(PARITY // 64))
    sizes = (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
    # |A ^ B| (100 + p) <= (100 - p) (|A| + |B|) wherever 100 |A & B| >= p |A | B|.
    return sizes & (estimate("sa.packed", "sb.packed") >= _least_estimate(percent / 100)) & (differing * (100 + percent) <= (na + nb) * (100 - percent))


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, set[bytes]] = ("", set())
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b")), strict=True)
            links = []
            for x, y, s, t in rows:
                t = t.as_py()
                if known[0] != t:  # partitions come sorted by b, the hub of many pairs
                    known = (t, shingle_set(t))
                left, right = shingle_set(s.as_py()), known[1]
                common = len(left & right)
                if 100 * common >= percent * (len(left) + len(right) - common):
                    links.append((x.as_py(), y.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], type=batch.schema.field(k).type) for k in (0, 1)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all ends of links (a, b): the smallest node that each reaches.

    Large-star and small-star steps alternate, each one aggregation by node and one join;
    the number of rounds grows with the logarithm of the longest path.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        # Large star: each node links its larger neighbours to its smallest one.
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each node links itself and its smaller neighbours to the smallest.
        star = large.distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_materialized(edges)
        edges = after
        if mark == before:
            break
        before = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: key, n_shingles, component_id (null for a null key), kept."""
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(sketch(plain), "sketch")
    classes = rows.filter("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first(F.struct(F.col("n_shingles").alias("n"), "packed", "odd")).alias("s")
    )
    classes = materialize(classes, "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(banded.join(hubs, "band").select("band", "node", "hub", "n"), "members")
    sketches = classes.select("node", "s")

    def linked(pairs: DataFrame) -> DataFrame:
        # Materialized: the candidates are read for their ids and again with their texts.
        near = materialize(
            pairs.distinct()
            .join(sketches.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
            .join(sketches.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
            .filter(may_link(percent))
            .select("a", "b"),
            "candidates",
        )
        ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        texts = plain.join(ends, plain["doc_id"] == ends["node"], "left_semi").select(F.col("doc_id").alias("node"), "text")
        links = materialize(verify(near, texts, percent), "links")
        drop_materialized(near)
        return links

    links = linked(members.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    # Rows of one id in several classes are one node.
    groups = materialize(components(links), "components")
    # Only buckets of three and more can hold pairs that the hub hasn't tested.
    rest = members.filter("n > 2").join(groups, "node", "left").select("band", "node", "hub", F.coalesce("component", "node").alias("component"))
    mixed = rest.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    rest = materialize(rest.join(mixed, "band"), "mixed")
    if not rest.isEmpty():
        drawn = rest.groupBy("band").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", "band")).alias("drawn"))
        pairs = rest.join(drawn, "band").filter("component != drawn.component AND node != hub AND drawn.node != hub")
        more = linked(pairs.select(F.greatest("node", "drawn.node").alias("a"), F.least("node", "drawn.node").alias("b")))
        links = links.unionByName(more)
        groups = materialize(components(links), "components")
        rest = rest.drop("component").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = rest.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
        rest = rest.filter("node != hub").join(mixed, "band").join(sketches, "node")
        left = rest.select("band", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("s").alias("sa"))
        right = rest.select("band", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("s").alias("sb"))
        # What is left after two rounds: different components of one bucket, by estimate.
        last = left.join(right, (left["band"] == right["band"]) & (F.col("ca") < F.col("cb")) & may_link(percent)).select("a", "b")
        final = linked(last)
        if not final.isEmpty():
            groups = materialize(components(links.unionByName(final)), "components")
    drop_materialized(members)
    of = classes.select("digest", "node").join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    empty = rows.filter("doc_id IS NULL OR digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = rows.filter("doc_id IS NOT NULL AND digest IS NOT NULL").join(of, "digest").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
