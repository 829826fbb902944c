"""Best-fit packing of tokenized documents, improved by swaps between bins.

Documents are encoded and closed by one id; only those longer than a sequence are cut. Whole
pieces are sequences by themselves. The others are dealt to cells of about ``CELL`` pieces by a
hash of a stored row number, so cells are even however often a document is repeated. In its cell
a task packs by best fit in order of falling size, then searches locally: from the emptiest
open bin it hands over one piece, exchanges one for one, or two for one, always so that a
fuller bin gets fuller. That raises the sum of squared fills, so the search ends; a
bin that runs empty is saved. Each cell then closes its bins but for the ``OPEN`` emptiest,
whose pieces meet those of other cells in the next round, until one cell is left. A round has
some hundred times fewer pieces than the one before, and no task ever holds more than a cell.

Closing a bin only ends its improvement; every piece keeps its place. Rounds are written to the
shared folder, so a lost executor repeats its own cells only, with the same outcome.

Encoding. White space ends a token of this kind of vocabulary and is dropped, so runs between
blanks are encoded apart, and words that a worker has met come from its bounded memory.

Defined cases: null and empty texts are one piece of the closing id alone. Repeated rows are packed as
often as they stand. Null ids are ids. An empty table gives an empty table. Very long
texts are read whole and cut. Extra columns are not carried, so none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import materialize, resident, ship, text_runs

CAPACITY = 4096
#: The id that closes each document.
CLOSING = 1
#: Pieces of a cell, about; bins that a cell leaves open for the next round.
CELL, OPEN = 40_000, 64
#: Bytes of words and of runs that a worker remembers, about, each; then it starts anew. Of these for each besides
#: its letters; letters of those that aren't kept.
MEMORY, _ENTRY, _LONG = 192 << 20, 150, 64
#: Texts whose letters have one form each, and the vocabulary's cuts for them in lower case (fixed values of its format).
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Exchanges tried in a cell for each of its open bins.
TRIES = 64


class TextEncoder:
    """Encodes texts; ids are little-endian unsigned 32-bit numbers.

    Runs between blanks are encoded apart. A run of ASCII and Latin letters, where case and
    composition are plain, is cut into words here, and the library's model is asked for unseen words
    only. Any other run goes through the whole library.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        letters = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        rest = [b for b in range(256) if b not in letters]
        #: The printable letter that stands for each byte in the vocabulary.
        self.letters = letters | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.words: dict[str, bytes] = _Remembered(self._word)
        self.runs: dict[str, bytes] = _Remembered(self._run)

    def _word(self, word: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        word = self.words.__getitem__
        if _PLAIN.fullmatch(text) and "<|" not in text:
            out = b"".join(map(word, _WORDS.findall(text.lower())))
        else:
            plain = lambda r: _PLAIN.fullmatch(r) and "<|" not in r
            out = b"".join(b"".join(map(word, _WORDS.findall(r.lower()))) if plain(r) else self.runs[r] for r in text.split(" "))
        self.words.bound()
        self.runs.bound()
        return out


class _Remembered(dict):
    """What ``make`` makes of a key, kept until about ``MEMORY`` bytes are held."""

    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(key) <= _LONG:
            self[key] = out
            self.held += _ENTRY + 2 * len(key) + len(out)
        return out

    def bound(self) -> None:
        if self.held > MEMORY:
            self.clear()
            self.held = 0


def tokenize(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's pieces of at most ``capacity`` ids."""
    ship(df.sparkSession)
    with open(path or vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())  # a fixed size, some MB
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    closing = np.array([CLOSING], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = model.value
        encoder = resident(("runs", hashlib.sha256(source.encode()).hexdigest()), lambda: TextEncoder(source))
        for batch in text_runs(batches, text, 2 << 20):
            rows, of = [], []
            for k, t in enumerate(batch.column(text).to_pylist()):
                ids = encoder.encode(t) + closing
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    of.append(k)
                    rows.append((p, at // 4, len(part) // 4, crc32(part)))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of places in ``sizes``) by best fit in order of falling size.

    ``room`` has a bit for each free space that some bin has, so the least one that is
    large enough is found by a shift.
    """
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = {}
    room = 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fit = room >> sizes[k]
        if fit:
            free = sizes[k] + (fit & -fit).bit_length() - 1
            b = with_room[free].pop()
            if not with_room[free]:
                room ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        free -= sizes[k]
        with_room.setdefault(free, []).append(b)
        room |= 1 << free
    return bins


class Search:
    """Local search over the bins of one cell: every step raises the sum of squared fills."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.capacity = capacity
        self.size = np.array(sizes, np.int64)
        self.bins = [set(b) for b in bins]
        self.fill = np.array([sum(sizes[k] for k in b) for b in bins], np.int64)
        self.of = np.zeros(len(sizes), np.int64)
        for b, members in enumerate(bins):
            self.of[members] = b

    def _move(self, k: int, to: int) -> None:
        a = int(self.of[k])
        self.bins[a].discard(k)
        self.bins[to].add(k)
        self.fill[a] -= self.size[k]
        self.fill[to] += self.size[k]
        self.of[k] = to

    def _step(self, a: int) -> bool:
        """One step out of bin ``a``: the one that fills another bin most, if there is any."""
        free = np.where((self.fill > 0) & (self.fill >= self.fill[a]), self.capacity - self.fill, -1)
        free[a] = -1
        own = sorted(self.bins[a], key=lambda k: (-self.size[k], k))
        best, move = 0, None
        for x in own:  # hand over one piece
            left = np.where(free >= self.size[x], free, self.capacity + 1)
            b = int(left.argmin())
            if left[b] <= self.capacity and self.size[x] > best:
                best, move = int(self.size[x]), ((x,), (), b)
        if move:
            return self._apply(a, move)
        # Pieces of other bins with the space that they would leave; y goes out, so x may be up to reach.
        others = np.flatnonzero(free[self.of] > 0)
        y, reach = self.size[others], self.size[others] + free[self.of[others]]
        ones = [(x,) for x in own]
        twos = [(own[i], own[j]) for i in range(min(len(own), 16)) for j in range(i)]
        for xs in ones + twos:
            x = int(self.size[list(xs)].sum())
            fits = (y < x) & (reach >= x)
            if fits.any():
                at = int(np.where(fits, y, self.capacity + 1).argmin())
                if x - int(y[at]) > best:
                    best, move = x - int(y[at]), (xs, (int(others[at]),), int(self.of[others[at]]))
        # Two pieces of another bin for one of this: the pairs of a bin are walked from both ends.
        for b in np.flatnonzero(free > best):
            inside = sorted(self.bins[b], key=lambda k: (self.size[k], k))
            for x in own:
                i, j = 0, len(inside) - 1
                while i < j:
                    gain = int(self.size[x] - self.size[inside[i]] - self.size[inside[j]])
                    if gain > free[b]:
                        i += 1
                    else:
                        if gain > best:
                            best, move = gain, ((x,), (inside[i], inside[j]), int(b))
                        j -= 1
        return bool(move) and self._apply(a, move)

    def _apply(self, a: int, move: tuple) -> bool:
        out, back, b = move
        for k in back:
            self._move(k, a)
        for k in out:
            self._move(k, b)
        return True

    def run(self, tries: int) -> list[list[int]]:
        least = -(-int(self.size.sum()) // self.capacity)
        stuck: set[int] = set()
        used = int((self.fill > 0).sum())
        while tries and used > least:
            open_ = [b for b in np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)) if b not in stuck]
            if not open_:
                break
            a = min(open_, key=lambda b: (self.fill[b], b))
            if self._step(int(a)):
                stuck.clear()
                used -= int(self.fill[a] == 0)
            else:
                stuck.add(int(a))
            tries -= 1
        return [sorted(b) for b in self.bins if b]


def pack_sizes(sizes: list[int], capacity: int = CAPACITY, given: list[list[int]] | None = None, tries: int | None = None) -> list[list[int]]:
    """Bins of places in ``sizes``: the better of best fit and the given bins, after local search."""
    bins = best_fit(sizes, capacity)
    if given is not None and len(given) <= len(bins):
        bins = given
    search = Search(sizes, bins, capacity)
    return search.run(TRIES * min(len(bins), OPEN) if tries is None else tries)


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """``pieces`` plus sequence_id and offset; no length may be over ``capacity``."""
    spark = pieces.sparkSession
    ship(spark)
    columns = pieces.columns
    schema = pieces.schema.add("tag_", "long").add("sequence_id", "long").add("offset", "long").add("open_", "boolean")

    def fill(table: pa.Table, last: bool) -> pa.Table:
        table = table.drop_columns("cell_").sort_by("tag_")
        sizes = table.column(length).to_pylist()
        old: dict[int, list[int]] = {}
        for k, s in enumerate(table.column("sequence_id").to_pylist()):
            old.setdefault(s, []).append(k)
        tags = table.column("tag_").to_pylist()
        bins = pack_sizes(sizes, capacity, None if None in old else list(old.values()))
        fills = sorted((sum(sizes[k] for k in b), n) for n, b in enumerate(bins))
        again = set() if last else {n for f, n in fills[:OPEN] if f < capacity}
        name, place, still = [0] * len(sizes), [0] * len(sizes), [False] * len(sizes)
        for n, b in enumerate(bins):
            at = 0
            for k in b:
                name[k], place[k], still[k] = tags[b[0]], at, n in again
                at += sizes[k]
        for c, values in (("sequence_id", pa.array(name, pa.int64())), ("offset", pa.array(place, pa.int64())), ("open_", pa.array(still))):
            table = table.set_column(table.schema.get_field_index(c), c, values)
        return table

    rows = materialize(pieces.withColumn("tag_", F.monotonically_increasing_id()), "pieces")
    whole = F.col(length) >= capacity
    parts = [rows.filter(whole).withColumns({"sequence_id": F.col("tag_"), "offset": F.lit(0).cast("bigint")})]
    rest = rows.filter(~whole).withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint"), "open_": F.lit(True)})
    n = rest.count()
    while n:
        cells = -(-n // cell)
        run = partial(fill, last=cells == 1)
        # A bin's pieces go to one cell together.
        cell_ = F.pmod(F.xxhash64("sequence_id" if parts[1:] else "tag_"), F.lit(cells))
        done = materialize(rest.withColumn("cell_", cell_).groupBy("cell_").applyInArrow(lambda t: run(t), schema), "packed")  # noqa: PLW0108  its arguments are counted
        parts.append(done.filter("not open_"))
        rest = done.filter("open_")
        n = rest.count()
    out = parts[0].select(*columns, "sequence_id", "offset")
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns, "sequence_id", "offset"))
    return out


def pack_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, cell: int = CELL, path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(tokenize(df, id_col, text, capacity, path), capacity=capacity, cell=cell)
