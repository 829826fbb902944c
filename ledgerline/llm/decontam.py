"""Benchmark decontamination by a generalised suffix automaton over test items.

The words of all items build one automaton. Documents stream through it: after each
word the state tells the longest run of words, ending there, that occurs in any item.
Where that run reaches a window (``window`` consecutive item words, or a whole item of
fewer), the words of the window are hit and the items that hold it are known.

Words: A-Z lower-cased, then runs of ASCII letters, digits and non-ASCII characters.
Defined cases: null or wordless texts have no words and no hits; wordless items and
items with a null id match nothing; repeated items are found together; an empty benchmark
leaves all documents clean. Very long texts stream in one pass with memory in proportion
to their own length.

The automaton is broadcast in blocks of at most ``max_words`` benchmark words (a state
takes under 1 kB). A larger benchmark is cut into several blocks, and a longer item into
parts that overlap by a window less one word, so no window is lost; the driver holds two blocks at
most. Each block is a pass of its own over the texts that writes what it hit, without
texts, to the shared folder; hits of all blocks are then joined to the documents by a digest of the
text. A worker never holds more than one block. Columns that :func:`find_contamination`
adds may not be there already (ValueError); other columns pass through.
``longest_span`` is the longest run of hit words, however the benchmark is cut.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_materialized, free_name, materialize, resident, ship, text_runs

WINDOW = 10
#: Benchmark words in one block.
MAX_WORDS = 200_000
#: A-Z to lower case, ASCII that is no letter or digit to a blank, the rest as it is.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class ItemAutomaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        holders: list[set[str]] = [set()]
        short: dict[int, dict[int, set[str]]] = {}
        #: Fewest words that make a window; below it a state needs no look.
        self.least = window
        for item, seq in items:
            if not seq:
                continue
            numbers = [self.ids.setdefault(w, len(self.ids)) for w in seq]
            state = 0
            for n in numbers:
                state = self._extend(state, n, holders)
                holders[state].add(item)
            if len(seq) < window:
                short.setdefault(state, {}).setdefault(len(seq), set()).add(item)
                self.least = min(self.least, len(seq))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for s in order:  # what occurs with a longer run occurs with its suffixes
            if self.link[s] > 0:
                holders[self.link[s]] |= holders[s]
        #: State of the window-long suffix and the items it is in, for states that have one.
        self.full: list[frozenset[str] | None] = [None] * len(self.next)
        #: (words, items) of whole short items that end in the state's shortest reach.
        self.short: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.next)
        for s in reversed(order):
            up = self.link[s]
            own = tuple((n, frozenset(v)) for n, v in short.get(s, {}).items())
            self.short[s] = own + (self.short[up] if up > 0 else ())
            if self.length[s] >= window:
                self.full[s] = self.full[up] if up > 0 and self.length[up] >= window else frozenset(holders[s])

    def _extend(self, last: int, symbol: int, holders: list[set[str]]) -> int:
        """State of the run ``last`` + ``symbol``, added if it is new."""
        known = self.next[last].get(symbol)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, symbol, known, holders)
        new = self._state(self.length[last] + 1, {}, holders)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, symbol, q, holders)
        return new

    def _state(self, length: int, edges: dict[int, int], holders: list[set[str]]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        holders.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, symbol: int, q: int, holders: list[set[str]]) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), holders)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(hit spans [start, end) of words, items with occurring windows)."""
        edges, link, length = self.next, self.link, self.length
        window, least = self.window, self.least
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = run = 0
        for i, symbol in enumerate(map(self.ids.get, seq)):
            if symbol is None:
                state = run = 0
                continue
            to = edges[state].get(symbol)
            if to is None:
                while state > 0 and to is None:
                    state = link[state]
                    to = edges[state].get(symbol)
                run = length[state]
                if to is None:
                    run = state = 0
                    continue
            state = to
            run += 1
            if run < least:
                continue
            reach = 0
            if run >= window:
                found |= self._holders(state)
                reach = window
            for n, items in self.short[state]:
                if n <= run:
                    found |= items
                    reach = max(reach, n)
            if reach:
                start = i + 1 - reach
                if spans and start <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], start), i + 1)
                else:
                    spans.append((start, i + 1))
        return spans, found

    def _holders(self, state: int) -> frozenset[str]:
        """Items with the window that ends a run of at least ``window`` words in ``state``."""
        return self.full[state] or frozenset()


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str, max_words: int, window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with their words, read one partition at a time, in blocks of bounded size."""
    rows = benchmark.filter(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string"), text)
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    longest = max(max_words, 2 * window)
    for name, body in rows.toLocalIterator():
        whole = words(body)
        for start in range(0, max(1, len(whole) - window + 1), longest - window + 1):
            seq = whole[start : start + longest]
            if block and size + len(seq) > max_words:
                yield block
                block, size = [], 0
            block.append((name, seq))
            size += len(seq)
    if block:
        yield block


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_words: int = MAX_WORDS,
    cleaned: bool = False,
    max_coverage: float = 1.0,
) -> DataFrame:
    """``documents`` plus n_words, n_hit, hit_items (sorted ids) and longest_span.

    With ``cleaned`` the text loses its hit spans (other characters stay as they are) and
    ``covered`` tells whether hits cover more than ``max_coverage`` of the words.
    """
    spark = documents.sparkSession
    ship(spark)
    added = {"n_words": "bigint", "n_hit": "bigint", "hit_items": "array<string>", "longest_span": "bigint"}
    if cleaned:
        added["covered"] = "boolean"
    if clash := {c.lower() for c in documents.columns} & set(added):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    given = documents.columns
    held = free_name(documents, "found_so_far")
    blocks = item_blocks(benchmark, item, item_text, max_words, window)
    block, later = next(blocks, []), next(blocks, None)
    if later is None:
        return _finished(documents, text, given, added, max_coverage, cleaned, _Scan(spark, block, window))
    hits = []
    while block is not None:
        hits.append(materialize(_hits(documents, text, _Scan(spark, block, window)), "decontam"))
        block, later = later, next(blocks, None)
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    # Equal texts have equal hits; a text has as many rows at most as there are blocks.
    digest = free_name(documents, "text_digest")
    found = every.groupBy(F.col("digest").alias(digest)).agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    found = materialize(found.select(digest, F.struct("spans", "items").alias(held)), "decontamhits")
    drop_materialized(*hits)
    joined = documents.withColumn(digest, F.sha2(F.col(text).cast("binary"), 256)).join(found, digest, "left").drop(digest)
    return _finished(joined, text, given, added, max_coverage, cleaned, held=held)


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


class _Scan:
    """One block of items, whose automaton a worker builds once."""

    def __init__(self, spark: SparkSession, block: list, window: int):
        self.block, self.key, self.window = spark.sparkContext.broadcast(block), uuid.uuid4().hex, window

    def automaton(self) -> ItemAutomaton:
        return resident(("decontam", self.key), lambda: ItemAutomaton(self.block.value, self.window))


def _hits(df: DataFrame, text: str, scan: _Scan) -> DataFrame:
    """(digest, spans, items) of the texts that one block hits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = scan.automaton()
        for batch in text_runs(batches, text):
            rows = []
            for t in batch.column(text).to_pylist():
                spans, found = automaton.scan(words(t))
                if spans:
                    rows.append((hashlib.sha256(t.encode()).hexdigest(), [{"a": a, "b": b} for a, b in spans], sorted(found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=ty) for k, ty in enumerate((pa.string(), _SPANS, pa.list_(pa.string())))], names=["digest", "spans", "items"])

    return df.select(text).mapInArrow(run, "digest string, spans array<struct<a:bigint,b:bigint>>, items array<string>").dropDuplicates(["digest"])


def _finished(df: DataFrame, text: str, given: list[str], added: dict[str, str], max_coverage: float, cleaned: bool, scan: _Scan | None = None, held: str | None = None) -> DataFrame:
    """The documents with what was hit: by one block's scan, or by earlier ones as the column ``held`` has it."""
    keep = [c for c in given if c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = scan.automaton() if scan else None
        for batch in text_runs(batches, text):
            before = batch.column(held).to_pylist() if held else [None] * batch.num_rows
            rows, texts = [], []
            for t, old in zip(batch.column(text).to_pylist(), before, strict=True):
                seq = words(t)
                spans, found = automaton.scan(seq) if automaton else ([(x["a"], x["b"]) for x in old["spans"]], set(old["items"])) if old else ([], set())
                # A long window may reach back over several spans, of the same block too.
                spans = merge_spans(spans)
                hit = sum(b - a for a, b in spans)
                rows.append((len(seq), hit, sorted(found), max((b - a for a, b in spans), default=0)))
                if cleaned:
                    rows[-1] += (hit > max_coverage * len(seq),)
                    texts.append(without(t, spans) if spans else t)
            own = [batch.column(k) for k in keep]
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()] + [pa.bool_()] * cleaned
            columns = [pa.array([r[k] for r in rows], type=ty) for k, ty in enumerate(types)]
            body = pa.array(texts, type=pa.string()) if cleaned else batch.column(text)
            yield pa.RecordBatch.from_arrays([*own, body, *columns], names=[*keep, text, *added])

    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*keep, text]] + [f"{k} {v}" for k, v in added.items()]
    return df.select(*keep, text, *([held] if held else [])).mapInArrow(run, ", ".join(fields))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less the words of ``spans`` (numbers of words) and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = raw.translate(_WORD_BYTES)
    out, at, word, place = [], 0, 0, 0
    size = len(plain)
    for a, b in spans:
        while word < b:
            while plain[place] == 32:
                place += 1
            start = place
            place = end if (end := plain.find(b" ", place)) >= 0 else size
            if word == a:
                out.append(raw[at:start])
            word += 1
        at = place
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")
