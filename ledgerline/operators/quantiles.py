"""Exact quantiles of columns of any size, without gathering their values anywhere.

Each wanted place (a column and a rank) has a range of values that holds it, at first all. A pass
cuts every range into ``BINS`` bins and counts the rows in each, with their least and
greatest value, by one aggregate for all columns and places; the bin that holds the rank is
the next range. It shrinks to the values that are there, so each pass separates the range's least
from its greatest, and ends when they are the same. Counts of at most ``BINS`` bins a place
reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 2048


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbours, as ``percentile`` gives them; None without values.

    Nulls and NaN don't count. The rows are read once a pass: persist them if they are dear.
    """
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    rows = df.select(*(v.alias(f"c{i}") for i, v in enumerate(number.values())))
    first = rows.agg(*(f(f"c{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    # Open places: (column, rank from 0) -> (least value, greatest value, rank within the range).
    open_: dict[tuple[int, int], tuple[float, float, int]] = {}
    for i in range(len(columns)):
        n = first[f"n{i}"]
        for s in shares if n else ():
            for rank in {math.floor(s * (n - 1)), math.ceil(s * (n - 1))}:
                open_[i, rank] = (first[f"lo{i}"], first[f"hi{i}"], rank)
    done: dict[tuple[int, int], float] = {}
    while open_:
        done |= {k: lo for k, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {k: v for k, v in open_.items() if k not in done}
        if not open_:
            break
        places = list(open_)

        def spot(t: int):
            (i, _), (lo, hi, _) = places[t], open_[places[t]]  # noqa: B023
            x = F.col(f"c{i}")
            # Halves, so that ranges wider than the greatest double don't overflow.
            share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
            at = F.when(x == F.lit(hi), F.lit(BINS)).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
            return F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), F.struct(F.lit(t).alias("t"), at.cast("int").alias("bin"), x.alias("x")))

        spots = rows.select(F.explode(F.array_compact(F.array(*(spot(t) for t in range(len(places)))))).alias("s")).select("s.*")
        bins: dict[int, list[tuple]] = {}
        for r in spots.groupBy("t", "bin").agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect():
            bins.setdefault(r[0], []).append((r[1], r[2], r[3], r[4]))
        for t, place in enumerate(places):
            rank = open_[place][2]
            for _, n, lo, hi in sorted(bins[t]):
                if rank < n:
                    open_[place] = (lo, hi, rank)
                    break
                rank -= n
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        n = first[f"n{i}"]
        out[c] = []
        for s in shares:
            if not n:
                out[c].append(None)
                continue
            at = s * (n - 1)
            a, b = done[i, math.floor(at)], done[i, math.ceil(at)]
            out[c].append(a + (b - a) * (at - math.floor(at)) if a != b else a)
    return out
