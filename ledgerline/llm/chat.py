"""Chat formatting: a hidden Markov model recovers speakers of transcripts, then turns are rendered.

Each line of a transcript is observed as a speaker marker (whose, if any) and a line kind
(question, list or code, long, short, blank). States are (role, first or later line of a
turn). Viterbi gives the likeliest states; lines from one first line to the next are a
turn, its marker is cut off, and turns are rendered in one canonical form.

Decoding is online: whenever all surviving paths share their past, that past is final and
is handed on, so memory follows the undecided lines, not the transcript.

Defined cases: a null or empty transcript has no turns and renders to ''. Lines before any
marker take the likeliest role, by their features. Ties go to the first state. Repeated
turns are turns of their own; an empty table gives an empty table; a very long turn is read line by
line. Columns that are added may not be there already (ValueError).

The probabilities of :class:`SpeakerModel` are learned from labelled turns by :func:`fit`; its defaults
serve where there are none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Labelled turns to learn from, about.
SAMPLE = 20_000
ROLES = ("system", "user", "assistant")
#: Names of speakers in transcripts (fixed values).
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model"),
}
_ROLE_OF = {n: r for r, names in NAMES.items() for n in names}
_MARKER = re.compile(r"^\s*(?:[#>*\[(<|]+\s*)?([A-Za-z]{1,12})(?:\s*[\])>|*]+\s*:?|\s*:\**|\s+[-–—](?=\s))\s*")
KINDS = ("question", "list", "long", "short", "blank")


def marker(line: str) -> tuple[str | None, int]:
    """(role that the line's marker names or None, length of the marker)."""
    m = _MARKER.match(line)
    role = _ROLE_OF.get(m[1].lower()) if m else None
    return (role, m.end()) if role else (None, 0)


def line_kind(line: str) -> str:
    s = line.strip()
    if not s:
        return "blank"
    if s.endswith("?"):
        return "question"
    if s.startswith(("- ", "* ", "```", "1.", "    ")):
        return "list"
    return "long" if len(s) > 200 else "short"


@dataclass(frozen=True)
class SpeakerModel:
    """Log probabilities of starts, steps and observations; states are 2 * role + (0 first, 1 later)."""

    #: Weights of the next turn's role after a role; the row "" is the start.
    follow: dict[str, tuple[float, float, float]] = field(default_factory=lambda: {"": (0.3, 0.6, 0.1), "system": (0.05, 0.85, 0.1), "user": (0.01, 0.09, 0.9), "assistant": (0.01, 0.89, 0.1)})
    #: That a turn goes on after a line.
    stay: float = 0.8
    #: That a first line bears its own speaker's marker, another's; that a later line bears one.
    own_marker: float = 0.93
    false_marker: float = 0.01
    later_marker: float = 0.002
    #: Weights of the line kinds by role; of first lines, where they are known apart.
    first_kinds: dict[str, tuple[float, ...]] | None = None
    kinds: dict[str, tuple[float, ...]] = field(default_factory=lambda: {"system": (0.02, 0.18, 0.4, 0.35, 0.05), "user": (0.3, 0.05, 0.15, 0.45, 0.05), "assistant": (0.05, 0.25, 0.35, 0.3, 0.05)})

    def tables(self) -> tuple[list[float], list[list[float]], dict[tuple[str | None, str], list[float]]]:
        log = lambda x: math.log(x) if x > 0 else -1e9
        start = [x for w in self.follow[""] for x in (log(w), -1e9)]
        step = []
        for role in ROLES:
            row = [x for w in self.follow[role] for x in (log((1 - self.stay) * w), -1e9)]
            row[2 * ROLES.index(role) + 1] = log(self.stay)
            step += [row, row]
        emit = {}
        for seen in (None, *ROLES):
            for k, kind in enumerate(KINDS):
                out = []
                for role in ROLES:
                    first = self.own_marker if seen == role else self.false_marker if seen else 1 - self.own_marker - 2 * self.false_marker
                    later = self.later_marker if seen else 1 - 3 * self.later_marker
                    out += [log(first * (self.first_kinds or self.kinds)[role][k]), log(later * self.kinds[role][k])]
                emit[seen, kind] = out
        return start, step, emit


def fit(turns_: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", marked: float = SpeakerModel.own_marker, sample: int = SAMPLE) -> SpeakerModel:
    """The model of about ``sample`` turns with a role, chosen by a hash of conversation and turn.

    Learned are what role follows which (the turn numbered one less; a turn without one counts as a
    start), how long turns are, what kinds of lines a role's turns begin and go on with, and
    how often lines look like markers that are none. ``marked`` is the share of turns that bear
    their marker in the transcripts to come. All counts are smoothed by one; roles other than
    the known ones and null keys teach nothing. At most some dozens of counts reach the driver.
    """
    ship(turns_.sparkSession)
    all_ = turns_.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    all_ = all_.filter(F.col("role").isin(*ROLES) & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    place = F.crc32(F.concat_ws(" ", F.lit("chat"), F.col("conv").cast("string"), F.col("turn").cast("string")).cast("binary")) / F.lit(float(1 << 32))
    chosen = all_.filter(place < sample / max(1, all_.count()))
    before = all_.groupBy("conv", (F.col("turn") + 1).alias("turn")).agg(F.min("role").alias("before"))
    pairs = {(b or "", r): n for b, r, n in chosen.select("conv", "turn", "role").join(before, ["conv", "turn"], "left").groupBy("before", "role").count().collect()}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for i, line in enumerate(t.split("\n")):
                    key = (r, i == 0, line_kind(line), marker(line)[0] is not None)
                    seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_pylist([{"role": r, "first": f, "kind": k, "like": m, "n": n} for (r, f, k, m), n in seen.items()], schema=_COUNTS)

    lines = [tuple(r) for r in chosen.select("role", "text").mapInArrow(count, "role string, first boolean, kind string, like boolean, n bigint").groupBy("role", "first", "kind", "like").sum("n").collect()]
    total = lambda **want: sum(x[4] for x in lines if all(x[("role", "first", "kind", "like").index(k)] == v for k, v in want.items()))

    def shares(counts: list[int]) -> tuple[float, ...]:
        return tuple((c + 1) / (sum(counts) + len(counts)) for c in counts)

    kinds = {f: {r: shares([total(role=r, first=f, kind=k) for k in KINDS]) for r in ROLES} for f in (True, False)}
    first, later = total(first=True), total(first=False)
    return SpeakerModel(
        follow={b: shares([pairs.get((b, r), 0) for r in ROLES]) for b in ("", *ROLES)}, stay=(later + 1) / (first + later + 2), own_marker=marked,
        false_marker=(1 - marked) * (total(first=True, like=True) + 1) / (first + 2) / 2, later_marker=(total(first=False, like=True) + 1) / (later + 2) / 3,
        kinds=kinds[False], first_kinds=kinds[True],
    )


_COUNTS = pa.schema([("role", pa.string()), ("first", pa.bool_()), ("kind", pa.string()), ("like", pa.bool_()), ("n", pa.int64())])


class Decoder:
    """Viterbi over the lines of one transcript; ``push`` and ``close`` yield (line, state) as they become final."""

    def __init__(self, model: SpeakerModel):
        self.start, self.step, self.emit = model.tables()
        self.score: list[float] | None = None
        self.lines: list[str] = []
        self.back: list[list[int]] = []

    def push(self, line: str) -> Iterator[tuple[str, int]]:
        seen = self.emit[marker(line)[0], line_kind(line)]
        n = len(seen)
        if self.score is None:
            self.score = [a + b for a, b in zip(self.start, seen, strict=True)]
            self.back.append(list(range(n)))
        else:
            score, step = self.score, self.step
            came = [max(range(n), key=lambda i, j=j: (score[i] + step[i][j], -i)) for j in range(n)]
            self.score = [score[i] + step[i][j] + seen[j] for j, i in enumerate(came)]
            self.back.append(came)
        self.lines.append(line)
        if len(self.lines) >= 64:
            yield from self._settled()

    def _paths(self, ends: Iterable[int]) -> list[set[int]]:
        """States at each pending line that paths from ``ends`` go through."""
        at = set(ends)
        out = [at]
        for came in reversed(self.back[1:]):
            at = {came[s] for s in at}
            out.append(at)
        return out[::-1]

    def _settled(self) -> Iterator[tuple[str, int]]:
        live = [s for s, x in enumerate(self.score) if x > -1e8]
        through = self._paths(live)
        k = max((i for i, states in enumerate(through) if len(states) == 1), default=-1)
        # The last settled line stays pending as the root of what follows.
        if k > 0:
            for i in range(k):
                yield self.lines[i], self._only(through, i, k)
            del self.lines[:k], self.back[:k]

    def _only(self, through: list[set[int]], i: int, k: int) -> int:
        (state,) = through[k]
        for j in range(k, i, -1):
            state = self.back[j][state]
        return state

    def close(self) -> Iterator[tuple[str, int]]:
        if self.score is None:
            return
        state = max(range(len(self.score)), key=lambda s: (self.score[s], -s))
        states = [state]
        for came in reversed(self.back[1:]):
            state = came[state]
            states.append(state)
        yield from zip(self.lines, reversed(states), strict=True)
        self.score, self.lines, self.back = None, [], []


def turns(decided: Iterable[tuple[str, int]]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, from lines with their states."""
    role, body = None, []
    for line, state in decided:
        if state % 2 == 0:
            if role is not None:
                yield role, "\n".join(body)
            role = ROLES[state // 2]
            body = [line[marker(line)[1] :]]
        else:
            body.append(line)
    if role is not None:
        yield role, "\n".join(body)


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip()}\n<|end|>\n"


def parse(transcript: str | None, model: SpeakerModel | None = None) -> list[tuple[str, str]]:
    """Turns of a whole transcript."""
    if not transcript:
        return []
    decoder = Decoder(model or SpeakerModel())

    def decided() -> Iterator[tuple[str, int]]:
        for line in transcript.split("\n"):
            yield from decoder.push(line)
        yield from decoder.close()

    return list(turns(decided()))


def format_transcripts(df: DataFrame, transcript: str = "transcript", model: SpeakerModel | None = None) -> DataFrame:
    """``df`` plus turns (role, text) and rendered, for one transcript a row."""
    if clash := {c.lower() for c in df.columns} & {"turns", "rendered"}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    ship(df.sparkSession)
    m = model or SpeakerModel()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            found = [parse(t.as_py(), m) for t in batch.column(transcript)]
            columns = [pa.array([[{"role": r, "text": t} for r, t in f] for f in found], type=kind), pa.array(["".join(render(r, t) for r, t in f) for f in found], type=pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "turns", "rendered"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, turns array<struct<role:string,text:string>>, rendered string")


#: How a transcript may mark its speakers: (names of system, user and assistant, form).
STYLES = (
    (("System", "User", "Assistant"), "{}: "),
    (("system", "human", "ai"), "[{}] "),
    (("Instructions", "Question", "Answer"), "**{}:** "),
    (("CONTEXT", "CUSTOMER", "AGENT"), "### {}: "),
)


def mark(role: str | None, style: int) -> str:
    names, form = STYLES[style]
    return form.format(names[ROLES.index(role)]) if role in ROLES else ""


def reformat_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", model: SpeakerModel | None = None, bare: int = 0) -> DataFrame:
    """Write each conversation as a transcript, parse it blind to the roles, render it again.

    One row a conversation: conv_id, n_lines, n_turns, n_given (turns of the table), roles
    (initials of the recovered roles), agreed (turns whose role is the given one, by
    place), lines_agreed (lines that come back with the given role), rendered_sha256. Of ``bare``
    turns one, by hash, is written without its marker (0: none), so its speaker is to be told
    from its lines and its neighbours. Rows stream sorted by conversation and turn, so a task holds
    only undecided lines, and two letters a turn, however long a conversation is. Rows with
    a null conversation are one conversation; null roles have no marker, null texts are empty.
    """
    ship(df.sparkSession)
    m = model or SpeakerModel()
    kind = df.schema[conv].dataType.simpleString()
    source = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("style", F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % len(STYLES))
    chance = F.crc32(F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    source = source.withColumn("bare", chance % bare == 0 if bare else F.lit(False))
    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "n_lines", "n_turns", "n_given", "roles", "agreed", "lines_agreed", "rendered_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        at: _Conversation | None = None
        for batch in batches:
            schema = schema or pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *((n, pa.string() if n in ("roles", "rendered_sha256") else pa.int64()) for n in names[1:])])
            done = []
            for c, r, t, s, b in zip(*(batch.column(n) for n in ("conv_id", "role", "text", "style", "bare")), strict=True):
                c = c.as_py()
                if at is None or at.key != c:
                    if at is not None:
                        done.append(at.close())
                    at = _Conversation(c, m)
                at.add(r.as_py(), t.as_py(), None if b.as_py() else s.as_py())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([at.close()], schema=schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, n_lines bigint, n_turns bigint, n_given bigint, roles string, agreed bigint, lines_agreed bigint, rendered_sha256 string")


class _Conversation:
    def __init__(self, key, model: SpeakerModel):
        self.key, self.decoder = key, Decoder(model)
        self.digest = hashlib.sha256()
        self.n_lines = 0
        self.given: list[str] = []
        self.found: list[str] = []
        self.role: str | None = None
        self.body: list[str] = []
        #: Given roles of lines that aren't decided yet.
        self.pending: deque[str | None] = deque()
        self.lines_agreed = 0

    def add(self, role: str | None, text: str, style: int | None) -> None:
        self.given.append((role or " ")[0])
        for line in ((mark(role, style) if style is not None else "") + text).split("\n"):
            self.n_lines += 1
            self.pending.append(role)
            for decided in self.decoder.push(line):
                self._line(*decided)

    def _line(self, line: str, state: int) -> None:
        self.lines_agreed += self.pending.popleft() == ROLES[state // 2]
        if state % 2 == 0:
            self._end()
            self.role = ROLES[state // 2]
            self.body = [line[marker(line)[1] :]]
        else:
            self.body.append(line)

    def _end(self) -> None:
        if self.role is not None:
            self.found.append(self.role[0])
            self.digest.update(render(self.role, "\n".join(self.body)).encode("utf-8", "surrogatepass"))

    def close(self) -> dict:
        for decided in self.decoder.close():
            self._line(*decided)
        self._end()
        agreed = sum(a == b for a, b in zip(self.given, self.found, strict=False))
        return {
            "conv_id": self.key, "n_lines": self.n_lines, "n_turns": len(self.found), "n_given": len(self.given),
            "roles": "".join(self.found), "agreed": agreed, "lines_agreed": self.lines_agreed, "rendered_sha256": self.digest.hexdigest(),
        }
