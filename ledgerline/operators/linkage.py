"""Linking borrowers to firms by layers of keys, and by similar names within blocks."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import name_core, name_norm

RESOLVE_LEAST = 0.90
RESOLVE_MARGIN = 0.05
FUZZY_LEAST = 0.92
FUZZY_CORE = 6
FUZZY_BLOCK = 4
#: Firms' names of up to so many letters meet by what is left of them when letters go, longer ones by pieces.
FUZZY_SHORT = 20


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks; not symmetric, so the order counts."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: str, b: str):
    return F.pandas_udf(_ratio, "double")(F.col(a), F.col(b))


def with_name_keys(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("name_norm", name_norm(name)).withColumn("name_core", name_core("name_norm"))


_FOUND = ("gvkey", "match_type", "name_similarity")


def _layer(state: DataFrame, firms: DataFrame, key: str, match: str, note: bool = True) -> DataFrame:
    """``state`` (a row a borrower) after the open borrowers' ``key`` has been looked up.

    One firm is taken as it is; of several the most similar name, if it is clearly ahead.
    Else, with ``note``, the ambiguity is recorded; the borrower stays open.
    """
    right = firms.filter(F.coalesce(F.col(key if key in firms.columns else "name_core"), F.lit("")) != "")
    right = right.select(F.col(key if key in firms.columns else "name_core").alias("key__"), F.col("gvkey").alias("firm__"), F.col("name_norm").alias("norm__"), F.col("name_core").alias("other__")).distinct()
    asked = F.when(F.col("gvkey").isNull() & (F.col(key) != ""), F.col(key))
    scored = state.withColumn("ask__", asked).join(right, F.col("ask__") == F.col("key__"), "left").withColumn("s__", similarity("name_core", "other__"))
    w = Window.partitionBy("id")
    ahead = w.orderBy(F.desc_nulls_last("s__"), F.desc_nulls_last("firm__"), "norm__")
    ranked = scored.withColumns({
        "n__": F.size(F.collect_set("firm__").over(w)), "place__": F.row_number().over(ahead), "next__": F.coalesce(F.lead("s__").over(ahead), F.lit(0.0)),
        "first__": F.first("s__").over(w.orderBy("firm__", "norm__", "other__")),
    }).filter("place__ = 1")
    sole = F.col("n__") == 1
    clear = (F.col("n__") > 1) & (F.col("s__") >= RESOLVE_LEAST) & (F.col("s__") - F.col("next__") >= RESOLVE_MARGIN)
    unclear = (F.col("n__") > 1) & F.lit(note)
    return ranked.select(
        *(c for c in state.columns if c not in _FOUND),
        F.when(sole | clear, F.col("firm__")).otherwise(F.col("gvkey")).alias("gvkey"),
        F.when(sole, match).when(clear, f"{match}_resolved").when(unclear, "ambiguous_needs_review").otherwise(F.col("match_type")).alias("match_type"),
        F.when(sole, F.col("first__")).when(clear | unclear, F.col("s__")).otherwise(F.col("name_similarity")).alias("name_similarity"),
    )


def _least_common(a: int, b: int) -> int:
    """The fewest characters in matching blocks with which names of these lengths are similar enough."""
    m = int(FUZZY_LEAST * (a + b) / 2)
    while m and 2.0 * (m - 1) / (a + b) >= FUZZY_LEAST:
        m -= 1
    while 2.0 * m / (a + b) < FUZZY_LEAST:
        m += 1
    return m


def _partners(n: int) -> list[int]:
    """Lengths of names that can be similar enough to one of ``n`` characters."""
    return [k for k in range(max(FUZZY_CORE, n // 2), 2 * n) if _least_common(n, k) <= min(n, k)]


def _without(name: str, keep: int) -> set[str]:
    """All that is left of a name when some of its letters go, none of the block's."""
    return {name[:FUZZY_BLOCK] + "".join(c) for c in combinations(name[FUZZY_BLOCK:], keep - FUZZY_BLOCK)} if keep >= FUZZY_BLOCK else {""}


def _cuts(n: int) -> list[tuple[int, int]]:
    """(from, to) of the pieces of a name of ``n`` characters behind its block: one more than the letters in which a similar name differs."""
    most = max(n + k - 2 * _least_common(n, k) for k in _partners(n))
    edges = [FUZZY_BLOCK + (n - FUZZY_BLOCK) * i // (most + 1) for i in range(most + 2)]
    return list(zip(edges, edges[1:], strict=False))


def firm_keys(name: str) -> set[str]:
    """Keys of a firm's name; see :func:`_pairs`."""
    n = len(name)
    if n <= FUZZY_SHORT:
        return set().union(*(_without(name, m) for m in {_least_common(n, k) for k in _partners(n)}))
    return {f"{name[:FUZZY_BLOCK]}|{n}|{i}|{name[a:b]}" for i, (a, b) in enumerate(_cuts(n))}


def borrower_keys(name: str) -> set[str]:
    """Keys of a borrower's name; see :func:`_pairs`."""
    n = len(name)
    short = {_least_common(n, k) for k in _partners(n) if k <= FUZZY_SHORT}
    keys = set().union(*(_without(name, m) for m in short))
    for k in _partners(n):
        if k > FUZZY_SHORT:
            m = _least_common(n, k)
            keys.update(f"{name[:FUZZY_BLOCK]}|{k}|{i}|{name[a + d:b + d]}" for i, (a, b) in enumerate(_cuts(k)) for d in range(m - k, n - m + 1) if a + d >= FUZZY_BLOCK and b + d <= n)
    return keys


def _shorter(name: str) -> set[str]:
    return _without(name, len(name) - 1)


def _keyed(df: DataFrame, name: str, keys: Callable[[str], set[str]]) -> DataFrame:
    """(name, key__), some 100,000 rows at a time; many a name, which Spark's estimate leaves out, so they are not broadcast."""

    def emit(batches):
        for pdf in batches:
            names, found = [], []
            for x in pdf[name]:
                mine = keys(x)
                names += [x] * len(mine)
                found += mine
                if len(found) >= 100_000:
                    yield pd.DataFrame({name: names, "key__": found})
                    names, found = [], []
            if found:  # Spark can't turn a frame without rows and types into strings
                yield pd.DataFrame({name: names, "key__": found})

    return df.select(name).mapInPandas(emit, f"`{name}` string, key__ string").hint("merge")


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Different (name_core, other__) among which is each pair that is similar enough.

    The letters in matching blocks are a common subsequence, and equal first letters can always be
    part of the longest one. So of two names of lengths a and b both hold the same sequence of
    ``_least_common(a, b)`` letters: short firms' names meet by all such sequences. With a long name these
    are many; but it differs in so few places that one of its pieces stands whole in the other
    name, shifted by at most the letters that go or come.
    """
    near = F.udf(lambda n: _partners(n), "array<int>")
    block = F.substring("name_core", 1, FUZZY_BLOCK)
    sizes = left.groupBy(block.alias("block__"), F.length("name_core").alias("n__")).agg(F.count(F.lit(1)).alias("c__"))
    wanted = sizes.select("block__", F.explode(near("n__")).alias("size__")).distinct()
    there = right.withColumns({"block__": F.substring("other__", 1, FUZZY_BLOCK), "size__": F.length("other__")}).join(wanted, ["block__", "size__"], "left_semi")
    return _keyed(left, "name_core", borrower_keys).join(_keyed(there, "other__", firm_keys), "key__").select("name_core", "other__").distinct()


def _best(pairs: DataFrame) -> DataFrame:
    """(name_core, best__): the score and name of the most similar other name that is similar enough."""
    # Filtered after the aggregate: a filter on the score itself would be copied through the join's equality to all keys.
    scored = pairs.withColumn("s__", similarity("other__", "name_core"))
    best = scored.groupBy("name_core").agg(F.max("s__").alias("top__"), F.max_by("other__", F.struct("s__", "other__")).alias("other__")).filter(F.col("top__") >= FUZZY_LEAST)
    return best.select("name_core", F.struct(F.col("top__").alias("s__"), "other__").alias("best__"))


def closest_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name_core, close): the most similar of ``right``'s names (other__) of the same first letters, if similar enough.

    Names that are equal or one letter apart are looked up first. A pair further apart scores n / (n + 1)
    at most, n being the length of the name; so only names without a better one meet all others.
    """
    same = left.join(right, F.col("name_core") == F.col("other__")).select("name_core", "other__")
    less = _keyed(left, "name_core", _shorter).join(right, F.col("key__") == F.col("other__")).select("name_core", "other__")
    more = left.join(_keyed(right, "other__", _shorter), F.col("name_core") == F.col("key__")).select("name_core", "other__")
    near = _best(same.unionByName(less).unionByName(more)).persist()
    n = F.length("name_core")
    sure = near.filter(F.col("best__.s__") > n / (n + 1))
    rest = left.join(sure.select("name_core"), "name_core", "left_anti")
    return sure.unionByName(_best(_pairs(rest, right))).select("name_core", F.col("best__.other__").alias("close"))


def _close(state: DataFrame, firms: DataFrame) -> DataFrame:
    """``state`` plus ``close``: for open borrowers the most similar core name of the same first letters, if similar enough."""
    long = F.length("name_core") >= FUZZY_CORE
    asked = F.when(F.col("gvkey").isNull() & long, F.col("name_core"))
    left = state.select(asked.alias("name_core")).dropna().distinct().persist()
    right = firms.filter(long).select(F.col("name_core").alias("other__")).distinct().persist()
    found = closest_names(left, right).withColumnRenamed("name_core", "ask__")
    return state.withColumn("ask__", asked).join(found, "ask__", "left").select(*state.columns, "close")


def link_borrowers(borrowers: DataFrame, firms: DataFrame, fuzzy: bool = False, securities: DataFrame | None = None) -> DataFrame:
    """Link (id, name, ticker) to firms (gvkey, name[, ticker]) by ticker, exact name, core name, and similar name.

    Tickers are looked up in ``securities`` (ticker, gvkey, name; see :func:`ticker_firms`), or in
    ``firms`` itself. A layer works on what earlier ones haven't linked; an ambiguous
    borrower may be resolved later, else it needs review. A similar name that stays
    unresolved changes nothing. Every borrower has one row.
    """
    people = with_name_keys(borrowers, "name").withColumn("ticker", F.upper(F.trim("ticker")))
    known = with_name_keys(firms, "name")
    if fuzzy:
        known = known.persist()  # five joins read it
    listed = known if securities is None else with_name_keys(securities, "name")
    listed = listed.withColumn("ticker", F.upper(F.trim("ticker")))
    none = {"gvkey": F.lit(None).cast(firms.schema["gvkey"].dataType), "match_type": F.lit("unmatched"), "name_similarity": F.lit(None).cast("double")}
    state = people.select("id", "ticker", "name_norm", "name_core").dropDuplicates(["id"]).withColumns(none)
    state = _layer(state, listed, "ticker", "ticker_crsp")
    state = _layer(state, known, "name_norm", "exact_name")
    state = _layer(state, known, "name_core", "core_name")
    if fuzzy:
        state = state.persist()
        state = _layer(_close(state, known), known, "close", "fuzzy_name", note=False)
    return state.select("id", *_FOUND)


def borrower_universe(companies: DataFrame, wide: DataFrame) -> DataFrame:
    """Borrowers of the company table, and those that only the wide loan table has, one row an id.

    Of several rows of an id, the one with the least name, then ticker. ``source`` tells the table.
    """
    one = lambda df, source: df.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(F.col("name").isNull().alias("none"), "name", "ticker")).alias("b")).select("id", "b.name", "b.ticker", F.lit(source).alias("source"))
    first = one(companies, "company")
    return first.unionByName(one(wide, "wide").join(first.select("id"), "id", "left_anti"))


def firm_identities(names: DataFrame) -> DataFrame:
    """Different (gvkey, name) of all years, with the keys of the name."""
    return with_name_keys(names.select("gvkey", "name").dropna().distinct(), "name")


def ticker_firms(names: DataFrame, links: DataFrame) -> DataFrame:
    """(ticker, gvkey, name) over securities: names history (permno, ticker, name) and firm links (permno, gvkey).

    Firm links count for primary issues and kinds in order, one firm a security.
    """
    tickers = names.select("permno", F.upper(F.trim("ticker")).alias("ticker"), "name").filter(F.col("ticker") != "").distinct()
    return tickers.join(links.select("permno", "gvkey").filter(F.col("gvkey").isNotNull()).distinct(), "permno").select("ticker", "gvkey", "name").distinct()


def link_summary(links: DataFrame) -> DataFrame:
    return links.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gvkey").alias("n_firms"))


def link_totals(links: DataFrame) -> DataFrame:
    """(kind, value, n): borrowers, linked ones, different firms, and counts by match type and by source."""
    count = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("value"), "n")
    linked = links.filter(F.col("gvkey").isNotNull())
    whole = count("total", links.agg(F.count("*").alias("n"))).unionByName(count("linked", linked.agg(F.count("*").alias("n")))).unionByName(count("firms", linked.agg(F.count_distinct("gvkey").alias("n"))))
    for kind in ("match_type", "source"):
        if kind in links.columns:
            whole = whole.unionByName(links.groupBy(F.col(kind).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n"))
    return whole
