"""Set operations and reshaping (families G and H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_diagonal(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_vertical(frames: list[DataFrame], schema: dict[str, str]) -> DataFrame:
    """Union of frames of the same columns, each cast to the wanted types."""
    return reduce(lambda a, b: a.unionByName(b), [df.select(*(F.col(c).cast(t).alias(c) for c, t in schema.items())) for df in frames])


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def population_identity(scored: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """Per model: its keys, those that other models have and it lacks, and whether it has all. One pass: a key lacks
    a model where fewer models than there are hold it."""
    pairs = scored.select(model, *keys).distinct()
    models = pairs.select(model).distinct()
    full = models.crossJoin(pairs.select(*keys).distinct()).join(pairs.withColumn("_h", F.lit(1)), [model, *keys], "left")
    return full.groupBy(model).agg(F.count("_h").alias("rows_scored"), F.count_if(F.col("_h").isNull()).alias("missing")).withColumn("identical", F.col("missing") == 0)


def pivot_wide(df: DataFrame, keys: list[str], feature: str, values: dict[str, str], names: list[str]) -> DataFrame:
    """Long to wide by one pivot; absent requested features are NULL columns. values: column -> suffix."""
    aggs = [F.max(c).alias(s) for c, s in values.items()]
    out = df.where(F.col(feature).isin(names)).groupBy(*keys).pivot(feature, names).agg(*aggs)
    if len(aggs) == 1:
        return out
    return out.select(*keys, *(F.col(f"`{n}_{s}`").alias(f"{n}{s}") for n in names for s in values.values()))


def profile_unpivot(df: DataFrame, keys: list[str], features: dict[str, tuple[Column, Column, Column, Column]]) -> DataFrame:
    """Wide aggregates to long rows: feature, numerator, denominator, sum_squares, raw, qualified."""
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), a.cast("long").alias("numerator"), d.cast("long").alias("denominator"), s.cast("long").alias("sum_squares"), F.when(d > 0, a / d).alias("raw"), q.alias("qualified")) for n, (a, d, s, q) in features.items()))
    return df.select(*keys, F.explode(rows).alias("_f")).select(*keys, "_f.*")


def delimited_members(df: DataFrame, key: str, column: str, delimiter: str = "|") -> DataFrame:
    """Distinct non-blank members of a delimited text column per key."""
    return df.select(key, F.explode(F.split(F.col(column), f"\\{delimiter}")).alias("member")).where(F.trim("member") != "").distinct()


def list_contains(array: Column, value: Column) -> Column:
    """Membership; an absent list or value is False."""
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def horizontal(df: DataFrame, columns: list[str]) -> DataFrame:
    """any_present, sum_present (NULL where none), min_present and rms over the non-null of the columns."""
    present = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    n = F.size("_p")
    total = lambda f: F.aggregate("_p", F.lit(0.0), lambda a, x: a + f(x))
    return df.withColumn("_p", present).select(*df.columns, (n > 0).alias("any_present"), F.when(n > 0, total(lambda x: x)).alias("sum_present"), F.array_min("_p").alias("min_present"), F.when(n > 0, F.sqrt(total(lambda x: x * x) / n)).alias("rms"))


def interactions(df: DataFrame, products: dict[str, tuple[str, str]]) -> DataFrame:
    return df.select("*", *((F.col(a) * F.col(b)).alias(n) for n, (a, b) in products.items()))
