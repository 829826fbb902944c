"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a variable-order context tree: nodes are byte strings of up to three
bytes, with the counts of the bytes that follow them in that language's training texts.
A byte seen after the current node costs -log2 n/(N+q) bits (N: bytes seen there, q:
different ones); any other byte first pays the escape q/(N+q) and is then coded by the
next shorter node, without the bytes already ruled out. Below the root all 256 bytes are
alike. Statistics are frozen after training, so a byte's cost depends only on its node,
and a text's code length is an exact sum, for every byte of the text. The language with
the shortest code wins; ties go to the first name.

Training reads a bounded sample: about ``SAMPLE`` documents a language, chosen by a hash
of the id. All nodes of the sample are kept, as sorted arrays of the byte strings that occur in
a language, so a language takes memory in proportion to its own sample and the model in
proportion to the languages. A batch's different byte strings are coded once.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no
training rows everything is ``und``. Repeated rows get equal results. Very long texts are
coded whole, a few million bytes at a time. Other columns pass through, whatever their
names; the three added ones may not be there already (ValueError). An empty table gives an
empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, resident, set_aside, ship, text_runs

#: Training documents of a language, about.
SAMPLE = 500
DEPTH = 3
UNKNOWN = "und"
#: A text is in no language if its code takes more bits a byte than this: plain bytes would be shorter.
REJECT_BITS = 8.0
_TOGETHER = 1 << 20


@dataclass(frozen=True)
class Order:
    """Nodes of one length of a language's tree: what follows them, and what a byte that doesn't costs."""

    #: Node and next byte as a number, sorted, and the chance of that byte.
    grams: np.ndarray
    chance: np.ndarray
    #: Nodes, sorted, and the factor on the shorter node's chance of any other byte.
    nodes: np.ndarray
    escape: np.ndarray


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: For each language its orders, shortest first.
    orders: tuple[tuple[Order, ...], ...]


def _grams(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the DEPTH bytes before each byte as a number, the byte); texts are set off by DEPTH zero bytes."""
    wide = raw.astype(np.uint32)
    context = np.zeros(len(raw), dtype=np.uint32)
    for k in range(1, DEPTH + 1):
        context[k:] |= wide[:-k] << np.uint32(8 * (k - 1))
    inside = np.ones(len(raw), dtype=bool)
    for k in range(DEPTH):
        inside[starts + k] = False
    return context[inside], raw[inside]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    gap = bytes(DEPTH)
    raw = np.frombuffer(b"".join(x for p in parts for x in (gap, p)), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + DEPTH))) if len(parts) else np.zeros(0, dtype=np.int64)
    return raw, starts.astype(np.int64), sizes


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> LanguageModel:
    """Model of the rows with a language, from about ``sample`` of them a language."""
    ship(labelled.sparkSession)
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    place = F.crc32(F.concat(F.lit("langid "), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")) / F.lit(float(1 << 32))
    share: Column = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, min(1.0, sample / n)).otherwise(share)
    chosen = rows.filter(place < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, "text", _TOGETHER):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = batch.column("text").to_pylist()
            for name in sorted(set(langs)):
                raw, starts, _ = _joined([t for t, x in zip(texts, langs, strict=True) if x == name])
                context, byte = _grams(raw, starts)
                grams, n = np.unique(context.astype(np.int64) << 8 | byte, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    summed = chosen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # At most the sample's own different four-byte strings.
    found = summed.toPandas()
    languages = tuple(sorted(counts))
    per_language = []
    for name in languages:
        own = found[found["lang"] == name].sort_values("gram")
        per_language.append((own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)))
    return LanguageModel(languages, tuple(_freeze(g, n) for g, n in per_language))


def _freeze(grams: np.ndarray, n: np.ndarray) -> tuple[Order, ...]:
    """The orders of one language from the counts of strings of ``DEPTH`` + 1 bytes."""
    out: list[Order] = []
    for k in range(DEPTH + 1):
        own, inverse = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        seen = np.bincount(inverse, weights=n, minlength=len(own))
        nodes, at, kinds = np.unique(own >> 8, return_inverse=True, return_counts=True)
        bytes_ = np.bincount(at, weights=seen, minlength=len(nodes))
        left = 1 - np.bincount(at, weights=_chances(out, own), minlength=len(nodes))
        some = left > 1e-12  # else all bytes were seen here
        total = np.where(some, bytes_ + kinds, bytes_)
        out.append(Order(own, seen / total[at], nodes, np.where(some, kinds / total / np.where(some, left, 1), 0)))
    return tuple(out)


def _find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key, whether it is there)."""
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


def _chances(orders: Iterable[Order], grams: np.ndarray) -> np.ndarray:
    """The chance of each string's last byte after those before it, by the given orders."""
    p = np.full(len(grams), 1 / 256)
    for k, o in enumerate(orders):
        own = grams & ((1 << 8 * (k + 1)) - 1)
        at, known = _find(o.grams, own)
        node, there = _find(o.nodes, own >> 8)
        escaped = np.where(there, p * o.escape[node] if len(o.nodes) else p, p)
        p = np.where(known, o.chance[at] if len(o.grams) else p, escaped)
    return p


def code_lengths(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each text under each language, bytes of each text)."""
    raw, starts, sizes = _joined(texts)
    out = np.zeros((len(texts), len(model.languages)))
    full = np.flatnonzero(sizes)
    if len(full) and len(model.languages):
        context, byte = _grams(raw, starts)
        different, inverse = np.unique(context.astype(np.uint32) << np.uint32(8) | byte, return_inverse=True)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        for l, orders in enumerate(model.orders):
            cost = -np.log2(np.maximum(_chances(orders, different.astype(np.int64)), 1e-30))
            out[full, l] = np.add.reduceat(cost[inverse], first[full])
    return out, sizes


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` plus lang_pred, score (posterior at equal priors) and bits_per_byte of the best language."""
    spark = df.sparkSession
    ship(spark)
    added = {"lang_pred": "string", "score": "double", "bits_per_byte": "double"}
    if clash := {c.lower() for c in df.columns} & set(added):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    frozen, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    mark = free_name(df, "has_letter")
    keep = [c for c in df.columns if keep_text or c != text]
    source = df.withColumn(mark, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = resident(("langid", token), lambda: frozen.value)
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in text_runs(batches, text, _TOGETHER):
            bits, sizes = code_lengths(m, [t or "" for t in batch.column(text).to_pylist()])
            known = np.array(batch.column(mark).to_pylist(), dtype=bool) & bool(m.languages)
            best = bits.argmin(axis=1) if m.languages else np.zeros(len(sizes), dtype=np.int64)
            least = bits.min(axis=1) if m.languages else np.zeros(len(sizes))
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1) if m.languages else np.zeros(len(sizes))
            columns = [
                pa.array(names[np.where(known, best, len(names) - 1)].tolist(), type=pa.string()),
                pa.array(np.where(known, share, 0.0)),
                pa.array(np.where(known, least / np.maximum(sizes, 1), 0.0)),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], names=[*keep, *added])

    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    return source.mapInArrow(run, ", ".join(fields + [f"{k} {v}" for k, v in added.items()]))


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", max_bits: float = REJECT_BITS) -> DataFrame:
    """Rows whose language is known: not ``und``, and coded in ``max_bits`` bits a byte or fewer.

    The columns of :func:`predict` that ``docs`` has already are carried along under other names.
    """
    plain, aside = set_aside(docs, "lang_pred", "score", "bits_per_byte")
    found = predict(plain, model, text)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") <= max_bits))
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))
