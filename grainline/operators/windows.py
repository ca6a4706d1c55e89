"""Window functions, ordering and paging (families E and F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def competition_rank(df: DataFrame, keys: list[str], measure: str, name: str) -> DataFrame:
    """rank (ties share the least), descending; NULL measures stay unranked."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(measure))
    return df.withColumn(name, F.when(F.col(measure).isNotNull(), F.rank().over(w)))


def dense_rank_eligible(df: DataFrame, keys: list[str], measure: str, eligible: Column, name: str = "rank") -> DataFrame:
    """dense_rank among the eligible rows only, descending; the others keep NULL."""
    w = Window.partitionBy(*keys, "_e").orderBy(F.desc_nulls_last(measure))
    return df.withColumn("_e", F.coalesce(eligible, F.lit(False))).withColumn(name, F.when(F.col("_e"), F.dense_rank().over(w))).drop("_e")


def group_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def fractional_split(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """weight 1/n where n rows share the key, and the measure times it."""
    out = group_count(df, keys, "owners").withColumn("weight", F.when(F.col("owners") > 1, 1 / F.col("owners")).otherwise(F.lit(1.0)))
    return out.withColumn(f"weighted_{measure}", F.col(measure) * F.col("weight"))


def zscore(df: DataFrame, keys: list[str], measure: str, name: str = "z", population: bool = False) -> DataFrame:
    """(x - mean) / sd per partition: sample form with 0 where sd is 0 or NULL, population form with NULL where it is 0."""
    w = Window.partitionBy(*keys)
    x = F.col(measure)
    if population:
        sd = F.stddev_pop(x).over(w)
        return df.withColumn(name, F.when(sd > 0, (x - F.avg(x).over(w)) / sd))
    sd = F.stddev_samp(x).over(w)
    return df.withColumn(name, F.when(sd > 0, (x - F.avg(x).over(w)) / sd).otherwise(F.lit(0.0)))


def trailing_zscore(df: DataFrame, keys: list[str], season: str, measure: str, seasons: int = 5) -> DataFrame:
    """z of each season by the population mean and sd of the trailing seasons, itself included."""
    w = Window.partitionBy(*keys).orderBy(season).rangeBetween(-(seasons - 1), 0)
    x = F.col(measure)
    sd = F.stddev_pop(x).over(w)
    return df.select("*", F.count(x).over(w).alias("fit_rows"), F.min(season).over(w).alias("fit_first"), F.when(sd > 0, (x - F.avg(x).over(w)) / sd).alias("z"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def percentile_score(df: DataFrame, keys: list[str], measure: str, reliability: str) -> DataFrame:
    """Average-rank percentile 0..100, the same shrunk to 50 by the reliability, and a bounded score."""
    w = Window.partitionBy(*keys)
    ties = Window.partitionBy(*keys, measure)
    n = F.count(measure).over(w)
    average = F.rank().over(w.orderBy(F.asc_nulls_last(measure))) + (F.count(F.lit(1)).over(ties) - 1) / 2
    sd = F.stddev_pop(measure).over(w)
    pct = F.when(n > 1, 100 * (average - 1) / (n - 1)).otherwise(F.lit(50.0))
    out = df.withColumn("percentile", pct)
    return out.withColumn("shrunk_percentile", 50 + (F.col("percentile") - 50) * F.col(reliability)).withColumn("score", F.when(sd > 0, F.tanh((F.col(measure) - F.avg(measure).over(w)) / sd)).otherwise(F.lit(0.0)))


def prior_mean(df: DataFrame, keys: list[str], season: str, value: str, weight: str, name: str = "prior_mean") -> DataFrame:
    """Weighted mean of all earlier seasons of the same key."""
    w = Window.partitionBy(*keys).orderBy(season).rangeBetween(Window.unboundedPreceding, -1)
    total = F.sum(weight).over(w)
    return df.withColumn(name, F.when(total > 0, F.sum(F.col(value) * F.col(weight)).over(w) / total))


def page(df: DataFrame, condition: Column, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page with the total of all matching rows; limit 1 to 200."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200 and offset 0 or more")
    rows = df.where(condition)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def bounded_scope(df: DataFrame, cap: int) -> DataFrame:
    """df, or an error if it has more than cap rows; the probe reads cap + 1 rows at most."""
    if df.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} rows in scope")
    return df


def row_index(df: DataFrame, lead: str, then: str, rest: list[str], name: str = "k", buckets: int = 64) -> DataFrame:
    """df plus the row number by lead descending (a column of few values), then and rest ascending; none of them NULL. Rows are
    numbered within (lead, range of then) and the rows of the ranges before are added, so that no task numbers the whole table."""
    bounds = sorted(set(df.agg(F.percentile_approx(then, [(i + 1) / buckets for i in range(buckets - 1)], 50 * buckets)).first()[0] or []))
    rows = df.withColumn("_cut", sum((F.when(F.col(then) > b, 1).otherwise(0) for b in bounds), F.lit(0)))
    counts = rows.groupBy(lead, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(lead, "_cut", (F.sum("_n").over(Window.orderBy(F.desc(lead), "_cut")) - F.col("_n")).alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy(lead, "_cut").orderBy(then, *rest))
    return rows.withColumn("_own", own).join(F.broadcast(before), [lead, "_cut"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_cut", "_own", "_before")
