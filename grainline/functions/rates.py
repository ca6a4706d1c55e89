"""Column expressions that every aggregate shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_rate(n: Column, d: Column) -> Column:
    """n / d where d > 0, else NULL."""
    return F.when(d > 0, n / d)


def sum_if_observed(c: Column) -> Column:
    """SUM that is NULL when the group has no value."""
    return F.sum(c)


def sum_or_zero(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def conditional_sums(c: Column, condition: Column) -> tuple[Column, Column, Column]:
    """Sum, count and sum of squares of c where the condition holds."""
    own = F.when(condition, c)
    return F.sum(own), F.count(own), F.sum(own * own)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def slug(c: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def position_group(c: Column) -> Column:
    up = F.upper(c)
    return F.when(up.startswith("WR"), "WR").when(up.startswith("TE"), "TE").when(up.startswith("RB") | up.startswith("HB") | up.startswith("FB"), "RB")


def era(season: Column, bounds: list[tuple[int, str]], last: str) -> Column:
    """The name of the first bound that the season does not exceed."""
    out = None
    for top, name in bounds:
        out = F.when(season <= top, name) if out is None else out.when(season <= top, name)
    return out.otherwise(last)


def age_at(season: Column, birth: Column) -> Column:
    """Years from birth to 1 September of the season."""
    return F.datediff(F.make_date(season, F.lit(9), F.lit(1)), birth) / 365.2425


def ordered_when(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise)
