"""Aggregations (family D). Each is one grouped pass unless its text says otherwise; map-side partial sums keep hot groups cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import safe_rate
from . import order


def entity_metrics(df: DataFrame, keys: list[str], counts: dict[str, Column], sums: dict[str, Column], rates: dict[str, tuple[str, str]], distinct: dict[str, str] | None = None) -> DataFrame:
    """Counts of flags, sums, distinct counts, then rates (numerator, denominator) rebuilt from them."""
    aggs = [F.count_if(c).alias(n) for n, c in counts.items()] + [F.sum(c).alias(n) for n, c in sums.items()] + [F.count_distinct(c).alias(n) for n, c in (distinct or {}).items()]
    out = df.groupBy(*keys).agg(*aggs)
    return out.select("*", *(safe_rate(F.col(a), F.col(b)).alias(n) for n, (a, b) in rates.items()))


def unpivot_sides(df: DataFrame, common: list[str], sides: list[dict[str, Column]]) -> DataFrame:
    """One row a side, from structs of columns; no self-join and no second scan."""
    return df.select(*common, F.explode(F.array(*(F.struct(*(c.alias(n) for n, c in s.items())) for s in sides))).alias("_s")).select(*common, "_s.*")


def record(df: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """games, wins, losses, ties, points for and against."""
    a, b = F.col(own), F.col(other)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), F.count_if(a > b).alias("wins"), F.count_if(a < b).alias("losses"), F.count_if(a == b).alias("ties"), F.sum(a).cast("long").alias("points_for"), F.sum(b).cast("long").alias("points_against"))


def profile_long(df: DataFrame, keys: list[str], rates: dict[str, tuple[Column, Column]], means: dict[str, Column] | None = None, quantiles: dict[str, tuple[Column, float]] | None = None, places: int = 9) -> DataFrame:
    """Many tendency features in one pass, then long rows (feature, numerator, denominator, value): rates (hit among
    eligible), means and exact quantiles of a column's non-null values."""
    aggs, parts = [], []
    null = F.lit(None).cast("long")
    for n, (hit, among) in rates.items():
        aggs += [F.count_if(hit & among).alias(f"{n}_n"), F.count_if(among).alias(f"{n}_d")]
        parts.append((n, F.col(f"{n}_n"), F.col(f"{n}_d"), safe_rate(F.col(f"{n}_n"), F.col(f"{n}_d"))))
    for n, c in (means or {}).items():
        aggs += [F.sum(c).alias(f"{n}_n"), F.count(c).alias(f"{n}_d")]
        parts.append((n, F.col(f"{n}_n").cast("long"), F.col(f"{n}_d"), safe_rate(F.col(f"{n}_n"), F.col(f"{n}_d"))))
    for n, (c, q) in (quantiles or {}).items():
        aggs.append(F.count(c).alias(f"{n}_d"))
        parts.append((n, null, F.col(f"{n}_d"), null))
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), a.alias("numerator"), d.alias("denominator"), F.round(v.cast("double"), places).alias("value")) for n, a, d, v in parts))
    out = df.groupBy(*keys).agg(*aggs).select(*keys, F.explode(rows).alias("_f")).select(*keys, "_f.*")
    if not quantiles:
        return out
    # quantiles are picked by rank from counts of values, so that no group is held by a task
    held = F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(float(q)).alias("_share"), c.cast("double").alias("_v")) for n, (c, q) in quantiles.items()))
    found = order.quantiles(df.select(*keys, F.explode(held).alias("_h")).select(*keys, "_h.*"), [*keys, "feature", "_share"], "_v", {"_q": F.col("_share")})
    return out.join(found.select(*keys, "feature", "_q"), [*keys, "feature"], "left").select(*keys, "feature", "numerator", "denominator", F.coalesce("value", F.round("_q", places)).alias("value"))


def category_shares(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Share of each category in each group, zero rows for categories that a group lacks. The categories and groups
    are small tables by then."""
    counts = df.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    full = groups.crossJoin(counts.select(category).distinct()).join(counts, [*keys, category], "left")
    return full.select(*keys, category, F.coalesce("n", F.lit(0)).alias("n"), "total", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def string_set(c: Column) -> Column:
    """Sorted distinct values joined by a bar."""
    return F.array_join(F.sort_array(F.collect_set(c.cast("string"))), "|")


def coverage_status(intervals: DataFrame, expected_weeks: int, grid: DataFrame, on: list[str]) -> DataFrame:
    """Per grid cell: weeks that verified and supported intervals cover against the expected ones, as a status."""
    weeks = intervals.withColumn("w", F.explode(F.sequence("start_week", "end_week"))).where(F.col("w").between(1, expected_weeks))
    seen = weeks.groupBy(*on).agg(F.collect_set(F.when(F.col("status") == "verified", F.col("w"))).alias("v"), F.collect_set(F.when(F.col("status") != "unresolved", F.col("w"))).alias("s"), F.count_distinct("w").alias("any_weeks"))
    expected = F.sequence(F.lit(1), F.lit(expected_weeks))
    lacks = lambda c: F.size(F.array_except(expected, F.col(c)))
    status = F.when(F.col("v").isNull(), "absent").when(lacks("v") == 0, "verified").when(lacks("s") == 0, "supported").when(F.size("v") > 0, "partly_verified").when(F.size("s") > 0, "partly_supported").otherwise("unresolved")
    out = grid.join(seen, on, "left")
    return out.select(*on, F.coalesce(F.size("v"), F.lit(0)).alias("verified_weeks"), F.coalesce("any_weeks", F.lit(0)).alias("any_weeks"), status.alias("coverage"))


def weighted_mean(x: str, w: str) -> Column:
    usable = F.col(x).isNotNull() & (F.col(w) > 0)
    return safe_rate(F.sum(F.when(usable, F.col(x) * F.col(w))), F.sum(F.when(usable, F.col(w))))


def single_owner_share(df: DataFrame, keys: list[str], group: list[str], owner: str, limit: float = 0.9) -> DataFrame:
    """Share of groups with just one owner, and whether it passes the limit."""
    one = df.groupBy(*keys, *group).agg(F.count_distinct(owner).alias("n"))
    out = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), (F.count_if(F.col("n") == 1) / F.count(F.lit(1))).alias("single_share"))
    return out.withColumn("confounded", F.col("single_share") >= limit)


def stacked_dimensions(df: DataFrame, dimensions: dict[str, Column], aggs: list[Column]) -> DataFrame:
    """The same aggregates over several dimensions in one table (dimension, group): one scan, each row once a dimension."""
    tags = F.array(*(F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("grp")) for n, c in dimensions.items()))
    return df.withColumn("_t", F.explode(tags)).groupBy(F.col("_t.dimension").alias("dimension"), F.col("_t.grp").alias("grp")).agg(*aggs)


def tagged_aggregates(df: DataFrame, tags: dict[str, Column], aggs: list[Column], name: str = "population") -> DataFrame:
    """The same aggregates over overlapping populations, each a condition: one scan."""
    own = F.filter(F.array(*(F.when(c, n) for n, c in tags.items())), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(own)).groupBy(name).agg(*aggs)
