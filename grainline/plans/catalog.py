"""All registered queries of the engine. Importing a module of plans registers its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as win
from ..operators.joins import lag_join
from . import aggs, calls, domain, folds, joins, models, moves, profiles, projection, reliability, research, reshape_quality, states, serving, sources_keys, stats, windows  # noqa: F401
from .bindings import Tables
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events -> actor-season metrics -> prior-season deltas -> ranks among the qualified, in a stable order."""
    m = aggs.season_metrics(Tables(spark, sf_dir))
    d = lag_join(m, ["actor_id", "team_id"], "season", ["value_rate"]).withColumn("delta", F.col("value_rate") - F.col("prior_value_rate"))
    r = win.dense_rank_eligible(d, ["season"], "value_rate", F.col("qualifies"))
    return r.select("season", "actor_id", "team_id", "games", "volume", "value_rate", "delta", "rank").orderBy("season", F.asc_nulls_last("rank"), "actor_id", "team_id")
