"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as symbols: insult, threat, target, negation, report or other. Small
transducers rewrite the symbols of a clause and are composed into one machine:

- *report*: an insult or threat after a word of speech ("said that ...") is reported;
- *negation*: within three words after a negation it is negated;
- *target*: within four words before or after a word of address or person it is aimed (a
  machine that reads the clause from its end marks those before such a word);
- *weights*: each kind of match adds its weight times that of the lexicon entry.

Only clauses with a match count; a text's features are built from its clauses' weights and
a logistic curve fitted on labelled rows gives the score. The insult lexicon (word stems
with weights) is mined from the labelled rows by likelihood ratio. Both steps read a
bounded sample of about ``SAMPLE`` labelled rows chosen by a hash of the id, a parameter;
every stem of the sample that passes the tests is kept.

Defined cases: null texts count as empty and have no match; without labelled rows of both
classes the score is the share of label 1, or 0. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_runs
from .quality import bounded_sample

SAMPLE = 8000
LEAST_STEM, LONGEST_STEM = 3, 12
LEAST_COUNT = 4
#: Least log ratio of a stem's rates in toxic and other texts, and least G statistic of it.
LEAST_RATIO = 1.5
LEAST_GAIN = 25.0
_REMEMBERED = 200_000

#: Words of the closed classes (fixed values; the insults themselves are learned).
_THREAT_STEMS = {
    "kill hurt destroy burn shoot": " s ed ing", "stab": " s bed bing", "beat": " s en ing", "shot": "", "burnt": "",
    "töt getöt": "e en et est ete eten", "verletz": "e en t te ten", "umbring umzubring": "e en t st", "umgebracht": "",
    "tu frapp": "er e es é ée és ez ons ent ait erai era eront", "détrui": "re s t sez sons sent rai ra ront",
    "mat": "ar o as a an amos é ó aron aré ará arán ando ado arte arlo arla aros", "hier": "o e es en",
    "her destru": "ir iré irá irán ido irte irlo irla", "destru": "yo ye yes yen yó yendo",
}
THREATS = sorted({stem + end for stems, ends in _THREAT_STEMS.items() for stem in stems.split() for end in ends.split(" ")})
TARGETS = "you your yours youre u he she they them him his her their du dich dir dein deine ihr euch sie tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split()
NEGATIONS = "not no never nobody isnt arent dont nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says say called wrote quoted reported claimed told sagte sagt schrieb dit disait écrit dijo dice escribió".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED_INSULT, AIMED_THREAT = range(8)

#: ASCII letters and digits (lower case) and all bytes from 128 stay; ends of clauses become
#: line ends, anything else a blank.
_CLAUSE_BYTES = bytes(
    10 if c in b".!?;\n" else c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) -> (state, output symbol); missing arcs copy and stay."""

    arcs: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def _after(trigger: str, marks: dict[str, str], reach: int | None) -> Transducer:
    """Rewrites ``marks`` for ``reach`` words after ``trigger`` (for the clause's rest: None)."""
    arcs: dict[tuple[int, str], tuple[int, str]] = {}
    symbols = {"o", "i", "t", "y", "n", "r", *marks, *marks.values()} | {c.upper() for c in "it"}
    states = range(1, (reach or 1) + 1)
    for s in (0, *states):
        arcs[s, trigger] = ((reach or 1), trigger)
    for s in states:
        for c in symbols - {trigger}:
            arcs[s, c] = (s if reach is None else s - 1, marks.get(c, c))
    return Transducer(arcs)


#: Symbols: o other, i insult, t threat, y target, n negation, r report; then d reported,
#: e negated, I and T aimed at someone.
AIM = _after("y", {"i": "I", "t": "T"}, 4)
GRAMMAR = (
    _after("r", {"i": "d", "t": "d", "I": "d", "T": "d"}, None),
    _after("n", {"i": "e", "t": "e", "I": "e", "T": "e"}, 3),
    AIM,
)
#: Weight of a match by its final symbol; a threat counts only where it is aimed.
WEIGHTS = {"i": 1.0, "I": 1.5, "T": 1.0, "d": 0.25, "e": 0.1}
_NAMES = {OTHER: "o", INSULT: "i", THREAT: "t", TARGET: "y", NEGATION: "n", REPORT: "r", AIMED_INSULT: "I", AIMED_THREAT: "T"}


def compose(parts: tuple[Transducer, ...]) -> dict[tuple[int, int], tuple[int, float]]:
    """The composed machine: (state, word class) -> (state, weight); state 0 is the start."""
    start = (0,) * len(parts)
    number = {start: 0}
    queue = [start]
    table: dict[tuple[int, int], tuple[int, float]] = {}
    for state in queue:
        for kind, symbol in _NAMES.items():
            to = []
            for part, s in zip(parts, state, strict=True):
                s, symbol = part.step(s, symbol)
                to.append(s)
            key = tuple(to)
            if key not in number:
                number[key] = len(number)
                queue.append(key)
            table[number[state], kind] = (number[key], WEIGHTS.get(symbol, 0.0))
    return table


MACHINE = compose(GRAMMAR)
_KINDS = {c: k for k, c in _NAMES.items()}
#: (state, word class) -> (state, word class) of ``AIM``, for a clause read from its end.
BACKWARD = {(s, k): (to, _KINDS[x]) for s in range(5) for k, c in _NAMES.items() for to, x in [AIM.step(s, c)]}


class Lexicon(dict):
    """Word -> (class, weight), from stems and closed classes; remembered up to a bound."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = {s.encode(): w for s, w in stems.items()}
        self.sizes = sorted({len(s) for s in self.stems}, reverse=True)
        self.closed = {w.encode(): k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}

    def __missing__(self, word: bytes) -> tuple[int, float]:
        found = (OTHER, 0.0)
        for n in self.sizes:
            if n <= len(word) and (w := self.stems.get(word[:n])) is not None:
                found = (INSULT, w)
                break
        else:
            if (kind := self.closed.get(word)) is not None:
                found = (kind, 1.0)
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = found
        return found


def clause_weights(text: str | None, lexicon: Lexicon) -> tuple[list[float], int]:
    """(weights of the clauses that match, words of the text)."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_CLAUSE_BYTES)
    kinds = list(map(lexicon.__getitem__, raw.split()))
    if not any(k[0] == INSULT or k[0] == THREAT for k in set(kinds)):
        return [], len(kinds)
    out = []
    for clause in raw.split(b"\n"):
        read = list(map(lexicon.__getitem__, clause.split()))
        if not any(k[0] == INSULT or k[0] == THREAT for k in read):
            continue
        state, marked = 0, []
        for kind, weight in reversed(read):
            state, kind = BACKWARD[state, kind]
            marked.append((kind, weight))
        state, total = 0, 0.0
        for kind, weight in reversed(marked):
            state, times = MACHINE[state, kind]
            total += times * weight
        if total > 0:
            out.append(total)
    return out, len(kinds)


N_FEATURES = 4


def features(weights: list[float], n: int) -> tuple[float, ...]:
    """Bias, log of the summed weights, log of their rate in 100 words, the strongest clause."""
    total = sum(weights)
    return 1.0, float(np.log1p(total)), float(np.log1p(100 * total / (n + 20))), float(np.log1p(max(weights, default=0.0)))


@dataclass(frozen=True)
class ToxicityModel:
    stems: dict[str, float] = field(default_factory=dict)
    theta: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)


def mine_stems(rows: DataFrame) -> dict[str, float]:
    """Stems whose words are much more frequent in toxic texts of (t, y), with their log ratios."""
    words = rows.select("y", F.explode(F.array_distinct(F.split(F.translate(F.coalesce("t", F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1))).alias("w"))
    per_word = words.filter(F.length("w") >= LEAST_STEM).groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    stems = per_word.select("a", "b", F.explode(F.transform(F.sequence(F.lit(LEAST_STEM), F.least(F.length("w"), F.lit(LONGEST_STEM))), lambda k: F.substring(F.col("w"), F.lit(1), k))).alias("stem"))
    totals = per_word.agg(F.sum("a"), F.sum("b")).first()
    n1, n0 = totals[0] or 0, totals[1] or 0
    if not n1 or not n0:
        return {}
    ratio = F.log((F.col("a") + 0.5) / F.lit(float(n1))) - F.log((F.col("b") + 0.5) / F.lit(float(n0)))
    even = F.lit(n1 / (n1 + n0)) * (F.col("a") + F.col("b"))
    rest = (F.col("a") + F.col("b")) - even
    gain = 2 * (F.col("a") * F.log(F.col("a") / even) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / rest)).otherwise(0.0))
    counted = stems.groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") >= LEAST_COUNT)
    strong = counted.withColumn("ratio", ratio).withColumn("gain", gain).filter((F.col("ratio") >= LEAST_RATIO) & (F.col("gain") >= LEAST_GAIN))
    found = strong.orderBy(F.desc("gain"), F.length("stem").desc(), "stem").collect()
    chosen: dict[str, float] = {}
    shorter: set[str] = set()  # every stem that a chosen one begins with
    for r in found:
        s = r["stem"]
        if s in shorter or any(s[:k] in chosen for k in range(LEAST_STEM, len(s) + 1)):
            continue
        chosen[s] = float(r["ratio"])
        shorter |= {s[:k] for k in range(LEAST_STEM, len(s) + 1)}
    return chosen


def fit_scores(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge by Newton steps."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return (float(np.log((share + 1e-6) / (1 - share + 1e-6))), *([0.0] * (N_FEATURES - 1)))
    theta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * theta)
        theta = theta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, theta))


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE) -> ToxicityModel:
    """Lexicon and score curve from about ``sample`` rows of ``labelled`` (id, text, label)."""
    ship(labelled.sparkSession)
    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    chosen = bounded_sample(rows, "k", "toxicity", sample)
    stems = mine_stems(chosen)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in text_runs(batches, "t"):
            x = [features(*clause_weights(t.as_py(), lexicon)) for t in batch.column("t")]
            columns = [pa.array([r[k] for r in x], type=pa.float64()) for k in range(1, N_FEATURES)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("y")], names=[*(f"x{k}" for k in range(1, N_FEATURES)), "y"])

    schema = ", ".join(f"x{k} double" for k in range(1, N_FEATURES)) + ", y int"
    found = chosen.mapInArrow(run, schema).toPandas().sort_values(["x1", "x2", "x3", "y"])
    x = np.column_stack([np.ones(len(found)), *(found[f"x{k}"].to_numpy() for k in range(1, N_FEATURES))])
    return ToxicityModel(stems, fit_scores(x, found["y"].to_numpy(np.float64)))


def score(df: DataFrame, model: ToxicityModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` plus ``score`` and ``n_matches`` (clauses that match)."""
    if clash := {c.lower() for c in df.columns} & {"score", "n_matches"}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    ship(df.sparkSession)
    frozen = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if keep_text or c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = frozen.value
        lexicon, theta = Lexicon(m.stems), np.array(m.theta)
        for batch in text_runs(batches, text):
            scores, n = [], []
            for t in batch.column(text):
                weights, size = clause_weights(t.as_py(), lexicon)
                scores.append(float(1 / (1 + np.exp(-np.clip(theta @ features(weights, size), -30, 30)))))
                n.append(len(weights))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(scores, type=pa.float64()), pa.array(n, type=pa.int64())], names=[*keep, "score", "n_matches"])

    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    return df.mapInArrow(run, ", ".join([*fields, "score double", "n_matches bigint"]))
