"""Exact order statistics of groups of any size: ranks, quantiles, conformal radii (families D, K).

Equal values of a group are counted before they are shuffled, and the counts are added up in the order of (group, value) within ranges and
over them (intervals.running). A value's place in its group is known from that: no task, window or buffer holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .intervals import running


def value_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, value, n (rows with the value), n_upto (rows of the group with it or a smaller one); with a weight also its sums w and w_upto.
    NULL values are left out."""
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(weight).alias("w")] if weight else [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*sums)
    return running(counts, keys, value, ["n"] + (["w"] if weight else []))


def pick(ranks: DataFrame, keys: list[str], value: str, wanted: dict[str, Column]) -> DataFrame:
    """keys, n and for each name the value at rank `wanted` (from 1; a column of n), NULL beyond n. ranks: of value_ranks."""
    ranks = ranks.withColumnsRenamed({"n": "_own", "n_upto": "_upto"})
    totals = ranks.groupBy(*keys).agg(F.max("_upto").alias("n"))
    both = ranks.join(totals, keys) if keys else ranks.crossJoin(F.broadcast(totals))
    at = lambda k: (F.col("_upto") >= k) & (F.col("_upto") - F.col("_own") < k)
    return both.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(at(k), F.col(value))).alias(name) for name, k in wanted.items()))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float | Column]) -> DataFrame:
    """keys, n and for each name the quantile of that share (a number, or a column of the keys), interpolated between the two nearest
    ranks as percentile does."""
    ranks = cut(value_ranks(df, keys, value), "ranks")
    place = {name: (F.col("n") - 1) * (F.lit(s) if isinstance(s, float) else s) for name, s in shares.items()}
    wanted = {f"_{side}_{name}": f(h).cast("long") + 1 for name, h in place.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    got = pick(ranks, keys, value, wanted)
    low, high = (lambda name: F.col(f"_low_{name}")), (lambda name: F.col(f"_high_{name}"))
    between = lambda name, h: F.when(F.floor(h) == F.ceil(h), low(name).cast("double")).otherwise((F.ceil(h) - h) * low(name) + (h - F.floor(h)) * high(name))
    return got.select(*keys, "n", *(between(name, h).alias(name) for name, h in place.items()))


def cumulative_quantiles(df: DataFrame, keys: list[str], season: str, value: str, share: float, targets: DataFrame, cells: int = 64) -> DataFrame:
    """keys, season (the target), n, q: the quantile over all seasons before each target. Values are counted in cells first (cut at approximate
    quantiles of the key); the counts before a target tell in which cell its rank lies, and only the rows of that cell are ordered, so that a
    row is passed on to about targets / cells targets instead of all."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, season, F.col(value).cast("double").alias("_v"))
    edges = rows.groupBy(*keys).agg(F.percentile_approx("_v", [(i + 1) / cells for i in range(cells - 1)], 50 * cells).alias("_edges"))
    rows = rows.join(edges, keys) if keys else rows.crossJoin(F.broadcast(edges))
    rows = cut(rows.withColumn("_cell", F.size(F.filter("_edges", lambda e: F.col("_v") > e))).drop("_edges"), "cells")
    ahead = targets.select(F.col(season).alias("_t"))  # a row a season, as are the counts by cell
    hist = rows.groupBy(*keys, season, "_cell").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(ahead)).where(F.col(season) < F.col("_t")).groupBy(*keys, "_t", "_cell").agg(F.sum("n").alias("n"))
    hist = hist.select("*", F.sum("n").over(Window.partitionBy(*keys, "_t").orderBy("_cell")).alias("_upto"), F.sum("n").over(Window.partitionBy(*keys, "_t")).alias("_n"))
    place = (F.col("_n") - 1) * share
    sides = F.explode(F.array(*(F.struct(F.lit(name).alias("_side"), (f(place).cast("long") + 1).alias("_k")) for name, f in (("low", F.floor), ("high", F.ceil)))))
    wanted = hist.select(*keys, "_t", "_cell", "n", "_upto", "_n", sides.alias("_s")).select("*", "_s.*").where("_k <= _upto AND _k > _upto - n")
    wanted = cut(wanted.select(*keys, "_t", "_cell", "_side", "_n", (F.col("_k") - F.col("_upto") + F.col("n")).alias("_k")), "wanted")
    near = rows.join(F.broadcast(wanted), [*keys, "_cell"]).where(F.col(season) < F.col("_t"))
    counts = near.groupBy(*keys, "_t", "_side", "_k", "_n", "_v").agg(F.count(F.lit(1)).alias("n"))
    got = running(counts, [*keys, "_t", "_side", "_k", "_n"], "_v", ["n"]).where("_k <= n_upto AND _k > n_upto - n")
    both = got.groupBy(*keys, F.col("_t").alias(season)).agg(F.max("_n").alias("n"), F.max(F.when(F.col("_side") == "low", F.col("_v"))).alias("_low"), F.max(F.when(F.col("_side") == "high", F.col("_v"))).alias("_high"))
    h = (F.col("n") - 1) * share
    return both.select(*keys, season, "n", F.when(F.floor(h) == F.ceil(h), F.col("_low")).otherwise((F.ceil(h) - h) * F.col("_low") + (h - F.floor(h)) * F.col("_high")).alias("q"))


def average_ranks(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df plus <column>_rank: ranks within the group with ties averaged, among rows where all the columns are present."""
    out = df
    for c in columns:
        out = out.where(F.col(c).isNotNull())
    base = cut(out, "ranked") if len(columns) > 1 else out
    for c in columns:
        ranks = value_ranks(base, keys, c).select(*keys, c, (F.col("n_upto") - (F.col("n") - 1) / 2).alias(f"{c}_rank"))
        out = (base if c == columns[0] else out).join(ranks, [*keys, c])
    return out.select(*df.columns, *(f"{c}_rank" for c in columns))


def weighted_ranks(df: DataFrame, keys: list[str], columns: list[str], weight: str) -> DataFrame:
    """df plus <column>_rank: the weight of the group's smaller values and half of that of the equal ones (its own included)."""
    out = df.where(F.col(weight) > 0)
    for c in columns:
        out = out.where(F.col(c).isNotNull())
    base = cut(out, "weighted")
    out = base
    for c in columns:
        ranks = value_ranks(base, keys, c, weight).select(*keys, c, (F.col("w_upto") - F.col("w") / 2).alias(f"{c}_rank"))
        out = out.join(ranks, [*keys, c])
    return out.select(*df.columns, *(f"{c}_rank" for c in columns))


def conformal_radii(df: DataFrame, keys: list[str], season: str, targets: DataFrame, residual: str, levels: dict[str, float], window: int = 5) -> DataFrame:
    """keys, season (the target), residuals and a radius a level (name: level): the k-th smallest absolute residual of the `window` seasons
    before the target, k = ceil((n + 1) level); NULL where k > n. A residual is counted in its own season and then passed on to the
    targets ahead: rows are counts of values."""
    own = df.where(F.col(residual).isNotNull()).groupBy(*keys, season, F.abs(residual).alias("_r")).agg(F.count(F.lit(1)).alias("_c"))
    ahead = own.select(*keys, F.explode(F.sequence(F.col(season) + 1, F.col(season) + window)).alias(season), "_r", "_c").join(F.broadcast(targets.select(season)), season, "left_semi")  # a row a season
    counts = ahead.groupBy(*keys, season, "_r").agg(F.sum("_c").alias("n"))
    ranks = cut(running(counts, [*keys, season], "_r", ["n"]), "ranks")
    got = pick(ranks, [*keys, season], "_r", {name: F.ceil((F.col("n") + 1) * level).cast("long") for name, level in levels.items()})
    return got.withColumnRenamed("n", "residuals")
