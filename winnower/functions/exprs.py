"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def present(*pairs: tuple[Column, str | Column]) -> Column:
    """The values whose condition holds, in order; a null condition doesn't hold."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(v) if isinstance(v, str) else v) for cond, v in pairs)))


def any_of(c: Column, values: Sequence[str]) -> Column:
    return c.isin(*values)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether any word is a substring."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def tokens(c: Column) -> Column:
    """Lower-case tokens between runs of white space."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: t != "")


def ratio(top: Column, by: Column, none: float = 0.0) -> Column:
    """``top / by``, ``none`` where ``by`` is zero or null."""
    return F.when(by != 0, top.cast("double") / by).otherwise(F.lit(none))
