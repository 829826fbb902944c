"""Null-safe scalar expressions. A missing number is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal forms and their short spellings.
SUFFIX_CANON = {
    "INCORPORATED": "INC", "CORPORATION": "CORP", "COMPANY": "CO", "COMPANIES": "CO", "LIMITED": "LTD",
    "HOLDINGS": "HLDGS", "HOLDING": "HLDGS", "INTERNATIONAL": "INTL", "INDUSTRIES": "IND",
    "TECHNOLOGIES": "TECH", "TECHNOLOGY": "TECH", "SERVICES": "SVCS", "SERVICE": "SVCS", "GROUP": "GRP",
    "SYSTEMS": "SYS", "PARTNERS": "PTNRS", "RESOURCES": "RES", "AND": "&",
}
# Legal forms that a name's core does without.
DROPPABLE_SUFFIXES = (
    "INC", "CORP", "CO", "LTD", "LLC", "LP", "LLP", "PLC", "SA", "NV", "AG", "GMBH",
    "SPA", "AB", "AS", "OY", "BV", "PTY", "ULC", "TRUST", "HLDGS", "GRP", "CL",
)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: str | Column) -> Column:
    """Double; what can't be read, and NaN, is null."""
    d = _c(x).try_cast("double")
    return F.when(~F.isnan(d), d)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def guarded_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den where den > 0, else null."""
    return F.when(_c(den) > 0, _c(num) / _c(den))


def guarded_log(x: str | Column) -> Column:
    return F.when(_c(x) > 0, F.ln(_c(x)))


def sum_known(*parts: str | Column) -> Column:
    """Sum of the known parts; null only if all are unknown."""
    cols = [_c(p) for p in parts]
    none = reduce(lambda a, b: a & b, [c.isNull() for c in cols])
    return F.when(~none, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols]))


def any_missing(*parts: str | Column) -> Column:
    return reduce(lambda a, b: a | b, [_c(p).isNull() for p in parts])


def lookup(table: Mapping[str, object], key: str | Column) -> Column:
    """Value of ``key`` in a small fixed table, null if it isn't there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), _c(key))


def in_set(x: str | Column, values: list | tuple) -> Column:
    """Membership that is false, not null, for null."""
    return F.coalesce(_c(x).isin(*values), F.lit(False))


def name_norm(name: str | Column) -> Column:
    """Upper case, other signs to blanks, legal forms in their short spelling."""
    clean = F.regexp_replace(F.upper(F.coalesce(_c(name), F.lit(""))), "[^A-Z0-9& ]+", " ")
    tokens = F.filter(F.split(clean, " +"), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(lookup(SUFFIX_CANON, t), t)), " ")


def name_core(norm: str | Column) -> Column:
    """A normalized name without the legal forms at its end and without blanks."""
    forms = "|".join(DROPPABLE_SUFFIXES)
    return F.regexp_replace(F.regexp_replace(_c(norm), f"(^| )({forms})( ({forms}))*$", ""), " ", "")


def security_key(cusip: str | Column, size: int) -> Column:
    """First ``size`` letters or digits of an identifier that has at least as many, else null."""
    clean = F.upper(F.regexp_replace(F.trim(_c(cusip)), "[^A-Za-z0-9]", ""))
    return F.when(F.length(clean) >= size, F.substring(clean, 1, size))


def same_keys(keys: list[str], suffix: str) -> Column:
    """Each key equals its namesake with ``suffix``, nulls too; true without keys."""
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}{suffix}"))
    return match


def percent(share: str | Column, digits: int = 1) -> Column:
    """A share as text, like 12.5%; null stays null."""
    x = _c(share)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f%%", x * 100))
