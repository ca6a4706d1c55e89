"""Joins with declared cardinality, intervals and as-of rules (family C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    pass


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", cardinality: str = "m:1", check: bool = True) -> DataFrame:
    """A join whose cardinality (1:1, m:1, 1:m, m:m) is checked first by one aggregate of keys a side."""
    if check:
        for side, df, one in (("left", left, cardinality[0] == "1"), ("right", right, cardinality[-1] == "1")):
            if one and not duplicate_keys(df, on).isEmpty():
                raise CardinalityError(f"{side} side repeats {on}; declared {cardinality}")
    return left.join(right, on, how)


def interval_join(facts: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Facts with the intervals of the same keys that hold their point (both ends included): an equi-join with a residual."""
    right = intervals.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(on)), *[c for c in intervals.columns if c not in on])
    condition = F.col(point).between(F.col(start), F.col(end))
    for i, c in enumerate(on):
        condition = condition & (facts[c] == right[f"_k{i}"])
    return facts.join(right, condition, how).drop(*(f"_k{i}" for i in range(len(on))))


def lag_join(df: DataFrame, keys: list[str], season: str, columns: list[str], by: int = 1, how: str = "left", prefix: str = "prior_") -> DataFrame:
    """df plus the columns of the row `by` seasons earlier; a gap gives NULL (left) or no row (inner)."""
    prior = df.select(*keys, (F.col(season) + by).alias(season), *(F.col(c).alias(prefix + c) for c in columns))
    return df.join(prior, [*keys, season], how)


def grid(dims: list[DataFrame], observed: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """Every combination of the dimension tables, with the observations or the fill values."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(d)
    return out.join(observed, on, "left").fillna(fill)


def as_of_totals(df: DataFrame, entity: list[str], season: str, sums: list[str], prefix: str = "career_") -> DataFrame:
    """df plus sums over all earlier seasons of the entity; NULL before the first."""
    w = Window.partitionBy(*entity).orderBy(season).rangeBetween(Window.unboundedPreceding, -1)
    return df.select("*", *(F.sum(c).over(w).alias(prefix + c) for c in sums))


def as_of_evidence(targets: DataFrame, evidence: DataFrame, entity: str, cutoff: str, date: str, value: str, stage: str) -> DataFrame:
    """For each target the evidence on or before its cutoff: the highest stage, then the latest date; several values there
    are ambiguous."""
    # targets and evidence in one line per entity: the running best is what a target may know, and no pairs are made
    line = evidence.select(entity, F.col(date).alias("_at"), F.lit(0).alias("_kind"), F.struct(stage, date).alias("_e")).unionByName(targets.select(entity, F.col(cutoff).alias("_at"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    past = Window.partitionBy(entity).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    best = line.withColumn("_b", F.max("_e").over(past)).where("_kind = 1").select(entity, F.col("_at").alias(cutoff), F.col(f"_b.{stage}").alias(stage), F.col(f"_b.{date}").alias(date))
    values = evidence.groupBy(entity, stage, date).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v"))
    out = best.join(values, [entity, stage, date], "left")
    return out.select(entity, cutoff, stage, date, F.when(F.col("_n") == 1, F.col("_v")).alias(value), F.when(F.col("_n") > 1, "ambiguous").when(F.col("_n") == 1, "resolved").otherwise("none").alias("status"))


def replace_cells(base: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """base without the cells that new covers, plus new."""
    return base.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)


def override(base: DataFrame, review: DataFrame, on: list[str], column: str) -> DataFrame:
    """base with the reviewed value where there is one, and researched."""
    right = review.select(*on, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    return base.join(right, on, "left").withColumn(column, F.coalesce("_new", column)).withColumn("researched", F.coalesce("_hit", F.lit(False))).drop("_new", "_hit")


def moves(df: DataFrame, actor: str, role: str, season: str, team: str) -> DataFrame:
    """Rows of the same actor and role in the next season with another team."""
    nxt = df.select(actor, role, (F.col(season) - 1).alias(season), F.col(team).alias("to_team")).distinct()
    return df.select(actor, role, season, F.col(team).alias("from_team")).distinct().join(nxt, [actor, role, season]).where("from_team <> to_team")


def role_intersection(df: DataFrame, keys: list[str], role: str, wanted: list[int], name: int) -> DataFrame:
    """df's distinct (keys, role) plus a synthetic role for the keys that hold all wanted ones."""
    base = df.select(*keys, role).distinct()
    full = base.groupBy(*keys).agg(F.count_if(F.col(role).isin(wanted)).alias("n")).where(F.col("n") == len(wanted)).select(*keys, F.lit(name).alias(role))
    return base.unionByName(full)


def joinability(facts: DataFrame, evidence: DataFrame, on: list[str], by: str, counted: dict[str, list[str]]) -> DataFrame:
    """Distinct facts, entities and so on that each component (by) of the evidence reaches."""
    joined = facts.join(evidence.select(*on, by).distinct(), on)
    return joined.groupBy(by).agg(*(F.count_distinct(F.struct(*cols) if len(cols) > 1 else F.col(cols[0])).alias(name) for name, cols in counted.items()))


def exists_anchor(facts: DataFrame, anchors: DataFrame, on: list[str], condition: Column) -> DataFrame:
    return facts.join(anchors.where(condition).select(*on), on, "left_semi")
