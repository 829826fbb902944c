"""Default episodes from a stream of defaults, reinstatements and new debt, in whatever order they come.

Each firm is a state: the default that is open, if any, and the events that the watermark
hasn't passed yet. A timer fires when it does; the events up to it are then applied in
the order of their days, so an event that arrives late, but within the watermark, changes
nothing about the outcome. What is left of a firm between batches is its open default and
the events of the delay, not its history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events of one day: defaults first, since an episode isn't over on the day of a further default.
DEFAULT, REINSTATED, NEW_DEBT = "default", "reinstated", "new_debt"
_RANK = {DEFAULT: 0, REINSTATED: 1, NEW_DEBT: 1}
OUTPUT = "gvkey string, default_date date, emerge_date date"


def events(defaults: DataFrame, fresh: DataFrame, key: str = "gvkey") -> DataFrame:
    """(gvkey, kind, at, since) of the tables that :func:`ledgerline.operators.labels.episodes` takes.

    ``at``: the time an event became known; ``since``: the day of the default that a
    reinstatement ends, or of the offering whose first rating is told.
    """
    gvkey = F.col(key).cast("string").alias("gvkey")
    row = lambda df, kind, at, since: df.filter(F.col(at).isNotNull()).select(gvkey, F.lit(kind).alias("kind"), F.col(at).cast("timestamp").alias("at"), F.col(since).cast("date").alias("since"))
    parts = [row(defaults, DEFAULT, "default_date", "default_date"), row(defaults, REINSTATED, "reinstated_date", "default_date"), row(fresh, NEW_DEBT, "first_rating", "offering_date")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def advance(start: dt.date | None, told: list[tuple[dt.date, str, dt.date]]) -> tuple[dt.date | None, list[tuple[dt.date, dt.date | None]]]:
    """The open default after ``told`` (day, kind, since), and the episodes that began or ended."""
    out: list[tuple[dt.date, dt.date | None]] = []
    for day, kind, since in sorted(told, key=lambda x: (x[0], _RANK[x[1]])):
        if kind == DEFAULT:
            if start is None:
                start = day
                out.append((start, None))
        elif start is not None and day > start and (since >= start if kind == REINSTATED else since > start):
            out.append((start, day))
            start = None
    return start, out


class Episodes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "day date")
        self.waiting = handle.getListState("waiting", "day date, kind string, since date")
        #: An episode that ended today can't start anew by another default of the same day.
        self.ended = handle.getValueState("ended", "day date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for at, kind, since in zip(pdf["at"], pdf["kind"], pdf["since"], strict=True):
                if kind in _RANK and not pd.isna(at) and not pd.isna(since):
                    self.waiting.appendValue((at.date(), kind, since))
                    self.handle.registerTimer(int(at.timestamp() * 1000))
        yield pd.DataFrame(columns=["gvkey", "default_date", "emerge_date"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        midnight = lambda d: int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.UTC).timestamp() * 1000)
        told, later = [], []
        for row in self.waiting.get():
            (told if midnight(row[0]) <= passed else later).append((row[0], row[1], row[2]))
        out = []
        if told:
            ended = self.ended.get()[0] if self.ended.exists() else None
            start, out = advance(self.open.get()[0] if self.open.exists() else None, [x for x in told if x[1] != DEFAULT or ended is None or x[0] > ended])
            self.open.update((start,)) if start is not None else self.open.clear()
            if closed := [e for _, e in out if e is not None]:
                self.ended.update((closed[-1],))
            self.waiting.put(later) if later else self.waiting.clear()
        yield pd.DataFrame([(key[0], s, e) for s, e in out], columns=["gvkey", "default_date", "emerge_date"])

    def close(self) -> None:
        pass


def stream_episodes(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """(gvkey, default_date, emerge_date) of a stream of :func:`events`: a row as an episode begins, without its end, and one as it ends.

    Events more than ``delay`` behind the newest are dropped. The session must use a state store that has
    columns (``spark.sql.streaming.stateStore.providerClass`` of RocksDB).
    """
    timed = stream.filter(F.col("gvkey").isNotNull()).withWatermark("at", delay)
    return timed.groupBy("gvkey").transformWithStateInPandas(statefulProcessor=Episodes(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def latest(told: DataFrame) -> DataFrame:
    """One row an episode of what a stream has told so far, with its end where it has one."""
    return told.groupBy("gvkey", "default_date").agg(F.max("emerge_date").alias("emerge_date"))
