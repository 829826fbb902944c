"""BPE encoding and decoding by dynamic programming over prefixes.

A byte-level BPE vocabulary has, for every byte string, one encoding. Its prefixes'
encodings are linked: the encoding of a prefix is the encoding of a shorter prefix plus
one last token, and that last token is unique. :class:`BpeModel` finds it for each
prefix: a suffix automaton over the vocabulary (Aho-Corasick form: states are token
prefixes, suffix links lead to the next shorter token) yields the tokens that end there,
longest first; the first that is compatible with the last token of what precedes it is
stored, and following the stored tokens back emits the ids. Two tokens are compatible if
no merge would cross their border before both are complete; this is read off the merge
tree, without encoding anything.

Texts are cut as the vocabulary file's pre-tokenizer does; special tokens that occur in a
text are single ids. Unseen pieces are encoded in sorted order, so that pieces share the
work on common prefixes, and each worker remembers a bounded number of bytes of them.

Defined cases: null texts count as empty; empty texts have no ids and decode to ''.
Very long texts are linear in time; a text without any cut is one piece and still linear.
Other columns pass through; the added ones may not be there already (ValueError). An empty
table gives an empty table; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import resident, ship, text_runs

#: Cuts of the byte-level pre-tokenizer (fixed value of the vocabulary's format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank next to other white space or at an end of the text; a blank that is neither.
_LOOSE = re.compile(r"\s | \s|^ | $")
_TIGHT = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of chunks and their ids that a worker remembers, about; then it starts anew.
MEMORY = 96 << 20
#: Of these for each chunk besides its letters, and for each tested pair of tokens or taken edge.
_CHUNK, _PAIR = 320, 160
#: Texts of about so many bytes are encoded together.
TOGETHER = 2 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class BpeModel:
    """Vocabulary, merge tree and suffix automaton of one tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(map(letters.__getitem__, s))
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: as_bytes(s) for s, i in vocab.items() if s not in self.special}
        ids = {b: i for i, b in self.token.items()}
        #: Merge order and result of a pair of ids, halves of each merged id.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (ids[as_bytes(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = ids[self.token[left] + self.token[right]]
            self.merge[left, right] = (rank, whole)
            if whole not in self.halves:
                self.halves[whole] = (left, right)
                self.order[whole] = rank
        self._automaton(ids)
        #: Edges taken so far, and pairs of tokens tested so far, by packed keys.
        self.moves: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.size = [0] * (max(self.token) + 1)
        for i, b in self.token.items():
            self.size[i] = len(b)
        self.text = {i: b for i, b in self.token.items()} | {i: s.encode() for s, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self._cut_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.cut = regex.compile(PIECES)
        self.memory: dict[str | int, tuple[str, int, bytes]] = {}
        self.held = 0

    def _automaton(self, ids: dict[bytes, int]) -> None:
        """States are token prefixes; ``ends``: longest token that ends in a state, ``shorter``: the next token that ends there."""
        self.step: list[dict[int, int]] = [{}]
        state_of: dict[bytes, int] = {b"": 0}
        usable = {b: i for b, i in ids.items() if len(b) == 1 or i in self.halves}
        whole = {0: -1}
        for b, i in usable.items():
            state = 0
            for c in b:
                to = self.step[state].get(c)
                if to is None:
                    to = self.step[state][c] = len(self.step)
                    self.step.append({})
                state = to
            whole[state] = i
        self.link = [0] * len(self.step)
        self.ends = [-1] * len(self.step)
        self.shorter: dict[int, int] = {}
        queue = [0]
        for state in queue:
            for c, to in self.step[state].items():
                queue.append(to)
                if state:
                    up = self.link[state]
                    while up and c not in self.step[up]:
                        up = self.link[up]
                    self.link[to] = self.step[up].get(c, 0)
                own, below = whole.get(to, -1), self.ends[self.link[to]]
                self.ends[to] = own if own >= 0 else below
                if own >= 0:
                    self.shorter[own] = below
        del state_of

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two tokens."""
        # The tokens' own merges are undone from the last to the first. At each moment a
        # (the end of the left one) touches b (the start of the right one); a merge of a and
        # b spoils the pair if BPE would do it before the merge that ends the moment: the
        # earlier of those that consume a and b. Between equal ranks the left place goes first.
        never = len(self.merge) + 1
        a, b = left, right
        a_next, b_next = never, never
        while True:
            hit = self.merge.get((a, b))
            if hit is not None and hit[0] < a_next and hit[0] <= b_next:
                return False
            a_rank, b_rank = self.order.get(a, -1), self.order.get(b, -1)
            if a_rank < 0 and b_rank < 0:
                return True
            if a_rank > b_rank:
                a_next, a = a_rank, self.halves[a][1]
            elif b_rank > a_rank:
                b_next, b = b_rank, self.halves[b][0]
            else:  # the same merge on either side: the left one is done first, so it is undone last
                b_next, b = b_rank, self.halves[b][0]

    def _go(self, state: int, byte: int) -> int:
        """Where ``byte`` leads, over suffix links; remembered as an edge of its own."""
        if len(self.moves) * _PAIR > MEMORY:
            self.moves.clear()
        at = state
        while (to := self.step[at].get(byte)) is None and at:
            at = self.link[at]
        to = self.moves[state << 8 | byte] = to or 0
        return to

    def _fit(self, left: int, right: int) -> bool:
        if len(self.fits) * _PAIR > MEMORY:
            self.fits.clear()
        ok = self.fits[left << 20 | right] = self.compatible(left, right)
        return ok

    def encode_pieces(self, pieces: Iterable[bytes]) -> Iterator[tuple[int, ...]]:
        """Ids of each piece. Prefixes shared with the piece before are not worked out again, so sort them."""
        moves, fits, ends, size, shorter = self.moves, self.fits, self.ends, self.size, self.shorter
        last: list[int] = []  # the last token of the encoding of each non-empty prefix
        states = [0]
        before_it = b""
        for piece in pieces:
            at = 0
            for x, y in zip(before_it, piece, strict=False):
                if x != y:
                    break
                at += 1
            del last[at:], states[at + 1 :]
            state = states[at]
            for c in piece[at:]:
                to = moves.get(state << 8 | c)
                state = self._go(state, c) if to is None else to
                t = ends[state]
                at += 1
                while t >= 0:
                    before = at - size[t]
                    if not before:
                        break
                    left = last[before - 1]
                    ok = fits.get(left << 20 | t)
                    if ok or ok is None and self._fit(left, t):
                        break
                    t = shorter[t]
                if t < 0:
                    raise ValueError(f"byte {c} is not in the vocabulary")
                last.append(t)
                states.append(state)
            before_it = piece
            ids, at = [], len(piece) - 1
            while at >= 0:
                ids.append(last[at])
                at -= size[last[at]]
            yield tuple(ids[::-1])

    def chunks(self, text: str) -> Iterator[list[str | int]]:
        """Runs of a text that are cut into pieces independently, and special tokens as ids.

        A lone blank between two characters that aren't blank always starts a piece.
        """
        parts = self._cut_special.split(text) if self._cut_special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [self.special[part]]
            elif part:
                head, *rest = part.split(" ") if not _LOOSE.search(part) else _TIGHT.split(part)
                yield [head, *[" " + r for r in rest]]

    def found(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """For each text, what its chunks encode to: (decimal ids, their number, the bytes they decode to)."""
        cut = [[c for chunk in self.chunks(t) for c in chunk] for t in texts]
        own = self.memory
        if self.held > MEMORY:
            own.clear()
            self.held = 0
        fresh = {c for chunks in cut for c in chunks} - own.keys()
        split = {c: self.cut.findall(c) if isinstance(c, str) else (c,) for c in fresh}
        pieces = sorted({p.encode() for ps in split.values() for p in ps if isinstance(p, str)})
        ids = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        for c, ps in split.items():
            found = [i for p in ps for i in (ids[p.encode()] if isinstance(p, str) else (p,))]
            own[c] = kept = (",".join(map(str, found)), len(found), b"".join(map(self.text.__getitem__, found)))
            self.held += _CHUNK + len(kept[0]) + 2 * len(kept[2])
        return [list(map(own.__getitem__, chunks)) for chunks in cut]

    def encode(self, text: str) -> list[int]:
        return [int(i) for f in self.found([text])[0] for i in f[0].split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")


def load_model(source: str) -> BpeModel:
    """The model of a vocabulary file's text, built once in each process."""
    return resident(("bpe", hashlib.sha256(source.encode()).hexdigest()), lambda: BpeModel(source))


def _broadcast(spark: SparkSession, path: str | None):
    """The vocabulary file's text (a fixed size, a few MB), read on the driver."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None, out: str = "token_ids") -> DataFrame:
    """``df`` plus the ids of each text."""
    def rows(model: BpeModel, texts: list[str | None]) -> list[tuple]:
        return [([int(i) for f in found for i in f[0].split(",")],) for found in model.found([t or "" for t in texts])]

    return _mapped(df, text, {out: ("array<int>", pa.list_(pa.int32()))}, rows, path)


def decode_ids(df: DataFrame, ids: str = "token_ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``df`` plus the text of each list of ids; null lists count as empty."""
    return _mapped(df, ids, {out: ("string", pa.string())}, lambda m, lists: [(m.decode(t or ()),) for t in lists], path, is_text=False)


def encode_digest(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` without texts, plus n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding again."""
    kinds = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _mapped(df, text, kinds, _digest, path, drop=True)


def _digest(model: BpeModel, texts: list[str | None]) -> list[tuple[int, str, str]]:
    rows = []
    for found in model.found([t or "" for t in texts]):
        ids = hashlib.sha256(",".join([f[0] for f in found]).encode()).hexdigest()
        # All decoded bytes are joined before they are read as UTF-8: a token may end inside a character.
        back = b"".join([f[2] for f in found]).decode("utf-8", "replace")
        rows.append((sum([f[1] for f in found]), ids, hashlib.sha256(back.encode()).hexdigest()))
    return rows


def _mapped(df: DataFrame, column: str, kinds: dict, f, path: str | None, is_text: bool = True, drop: bool = False) -> DataFrame:
    if clash := {c.lower() for c in df.columns} & set(kinds):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    ship(df.sparkSession)
    source = _broadcast(df.sparkSession, path)
    keep = [c for c in df.columns if not (drop and c == column)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(source.value)
        for batch in text_runs(batches, column, TOGETHER) if is_text else batches:
            rows = f(model, batch.column(column).to_pylist())
            new = [pa.array([r[k] for r in rows], type=t) for k, (_, t) in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new], names=[*keep, *kinds])

    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    return df.mapInArrow(run, ", ".join(fields + [f"{k} {sql}" for k, (sql, _) in kinds.items()]))
