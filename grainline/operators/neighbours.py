"""Exact nearest neighbours in any number of features (family K).

Distinct points are split at their quartiles, one feature after the other, until a cell holds no more than leaf_rows of them; each level is a
grouped pass, and the tree is a table a level: cells with their parent and the box around their points. A query first meets its own cell, which
bounds its distance, and then, level by level, the cells whose box is no farther than that bound; the points of the leaves that are left hold the nearest. All is
equi-joins on cells; the number of features changes how many cells are met, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

FAN = 4


def tree(points: DataFrame, features: list[str], leaf_rows: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """points (distinct, with the column cell of their leaf) and a table a level below the root: parent, cell, low_<f>, high_<f>."""
    rows, levels, level = points.withColumn("cell", F.lit(0).cast("long")), [], 0
    while True:
        crowded = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"_{f}") for f in [features[level % len(features)]])).where(F.col("n") > leaf_rows)
        if crowded.isEmpty():
            return rows, levels
        f = features[level % len(features)]
        split = rows.join(crowded.select("cell", F.col(f"_{f}").alias("_cuts")), "cell", "left").withColumn("parent", F.col("cell"))
        place = F.coalesce(F.size(F.filter("_cuts", lambda c: F.col(f) > c)), F.lit(0))
        split = cut(split.withColumn("cell", F.col("cell") * FAN + F.when(F.col("_cuts").isNull(), 0).otherwise(place)).drop("_cuts"), "cells")
        levels.append(cut(split.groupBy("parent", "cell").agg(*(F.min(c).alias(f"low_{c}") for c in features), *(F.max(c).alias(f"high_{c}") for c in features)), "boxes"))
        rows, level = split.drop("parent"), level + 1


def distance(features: list[str]) -> Column:
    """Mean squared difference of the features and those named p_."""
    return sum(((F.col(f) - F.col(f"p_{f}")) * (F.col(f) - F.col(f"p_{f}")) for f in features), F.lit(0.0)) / len(features)


def box_distance(features: list[str]) -> Column:
    gap = lambda f: F.greatest(F.col(f"low_{f}") - F.col(f), F.col(f) - F.col(f"high_{f}"), F.lit(0.0))
    return sum((gap(f) * gap(f) for f in features), F.lit(0.0)) / len(features)


def nearest(queries: DataFrame, points: DataFrame, key: list[str], features: list[str], itself: bool = False, leaf_rows: int = 64) -> DataFrame:
    """key, nearest: the least mean squared difference of each query to a point. itself: queries are rows of points and do not count
    themselves (a point that several rows share is at distance 0 of each). NULL features have no distance; no points give no rows."""
    whole = lambda df: df.where(" AND ".join(f"{f} IS NOT NULL" for f in features)).withColumns({f: F.col(f).cast("double") for f in features})
    places = whole(points).groupBy(*features).agg(F.count(F.lit(1)).alias("_times"))
    leaves, levels = tree(cut(places, "places"), features, leaf_rows)
    p = leaves.select("cell", *(F.col(f).alias(f"p_{f}") for f in features), "_times")
    q = cut(whole(queries).select(*key, *features), "queries")
    d = F.when(F.lit(itself) & (distance(features) == 0) & (F.col("_times") < 2), None).otherwise(distance(features))

    # a query goes down to the box that is nearest at each level: a leaf with points, hence a bound
    down = q.withColumn("cell", F.lit(0).cast("long"))
    for boxes in levels:
        met = down.withColumnRenamed("cell", "parent").join(boxes, "parent")
        down = met.groupBy(*key, *features).agg(F.min_by("cell", F.struct(box_distance(features), "cell")).alias("cell"))
    bound = down.join(p, "cell").groupBy(*key, *features).agg(F.min(d).alias("bound"))
    front = cut(bound.withColumn("cell", F.lit(0).cast("long")), "bounds")
    for boxes in levels:
        near = F.col("bound").isNull() | (box_distance(features) <= F.col("bound"))
        front = front.withColumnRenamed("cell", "parent").join(boxes, "parent").where(near).select(*key, *features, "bound", "cell")
    return front.join(p, "cell").groupBy(*key).agg(F.min(d).alias("nearest")).where("nearest IS NOT NULL")
