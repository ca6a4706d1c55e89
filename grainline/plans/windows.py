"""Queries of families E (windows) and F (order and paging)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as win
from .registry import query


@query("E01_competition_rank", "SELECT season, team_id, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY season ORDER BY v DESC NULLS LAST) END AS k FROM (SELECT season, team_id, CASE WHEN team_id % 8 <> 0 THEN plays // 20 END AS v FROM team_seasons)")
def _(t):
    rows = t.team_seasons.select("season", "team_id", F.expr("CASE WHEN team_id % 8 <> 0 THEN plays div 20 END").alias("v"))
    return win.competition_rank(rows, ["season"], "v", "k").drop("v")


ELIGIBLE = "SELECT season, team_id, d.k FROM team_seasons LEFT JOIN (SELECT season, team_id, dense_rank() OVER (PARTITION BY season ORDER BY attempts DESC) AS k FROM team_seasons WHERE value > 0) d USING (season, team_id)"


@query("E02_dense_rank_eligible", ELIGIBLE)
def _(t):
    return win.dense_rank_eligible(t.team_seasons, ["season"], "attempts", F.col("value") > 0, "k").select("season", "team_id", "k")


@query("E03_eligible_ranking_view", ELIGIBLE)
def _(t):
    return t.spark.sql("""WITH d AS (SELECT season, team_id, dense_rank() OVER (PARTITION BY season ORDER BY attempts DESC) AS k FROM {rows} WHERE value > 0)
      SELECT season, team_id, k FROM {rows} LEFT JOIN d USING (season, team_id)""", rows=t.team_seasons)


@query("E04_group_count_window", "SELECT interval_id, count(*) OVER (PARTITION BY season, team_id, role) AS n FROM intervals")
def _(t):
    return win.group_count(t.intervals, ["season", "team_id", "role"]).select("interval_id", "n")


@query("E05_fractional_split", "SELECT interval_id, count(*) OVER w AS owners, 1.0::DOUBLE / count(*) OVER w AS weight, (end_week - start_week + 1) * (1.0::DOUBLE / count(*) OVER w) AS weighted_weeks FROM intervals WINDOW w AS (PARTITION BY season, team_id, role)")
def _(t):
    rows = t.intervals.withColumn("weeks", F.col("end_week") - F.col("start_week") + 1)
    return win.fractional_split(rows, ["season", "team_id", "role"], "weeks").select("interval_id", "owners", "weight", "weighted_weeks")


@query("E06_zscore_partition_sample", "SELECT season, team_id, round(CASE WHEN stddev_samp(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_samp(v) OVER w ELSE 0 END, 8) AS z FROM (SELECT season, team_id, CASE WHEN season = 1996 THEN 5 ELSE plays END AS v FROM team_seasons) WINDOW w AS (PARTITION BY season)")
def _(t):
    rows = t.team_seasons.select("season", "team_id", F.when(F.col("season") == 1996, 5).otherwise(F.col("plays")).alias("v"))
    return win.zscore(rows, ["season"], "v").select("season", "team_id", F.round("z", 8).alias("z"))


@query("E07_zscore_partition_population", "SELECT season, team_id, round(CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w END, 8) AS z FROM (SELECT season, team_id, CASE WHEN season = 1996 THEN 5 ELSE plays END AS v FROM team_seasons) WINDOW w AS (PARTITION BY season)")
def _(t):
    rows = t.team_seasons.select("season", "team_id", F.when(F.col("season") == 1996, 5).otherwise(F.col("plays")).alias("v"))
    return win.zscore(rows, ["season"], "v", population=True).select("season", "team_id", F.round("z", 8).alias("z"))


@query("E08_trailing_standardise", "SELECT team_id, season, count(plays) OVER w AS fit_rows, min(season) OVER w AS fit_first, round(CASE WHEN stddev_pop(plays) OVER w > 0 THEN (plays - avg(plays) OVER w) / stddev_pop(plays) OVER w END, 6) AS z FROM team_seasons WINDOW w AS (PARTITION BY team_id ORDER BY season RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(t):
    return win.trailing_zscore(t.team_seasons.select("team_id", "season", "plays"), ["team_id"], "season", "plays").select("team_id", "season", "fit_rows", "fit_first", F.round("z", 6).alias("z"))


@query("E09_top_row_per_group", "SELECT season, team_id, actor_id, value FROM (SELECT *, row_number() OVER (PARTITION BY season, team_id ORDER BY value DESC, actor_id) AS k FROM actor_seasons) WHERE k = 1")
def _(t):
    return win.top_per_group(t.actor_seasons, ["season", "team_id"], [F.desc("value"), F.asc("actor_id")]).select("season", "team_id", "actor_id", "value")


@query("E10_percentile_score", """
WITH r AS (SELECT season, team_id, attempts, least(plays::DOUBLE / 1000, 1) AS rel FROM team_seasons),
p AS (SELECT *, 100 * (rank() OVER (PARTITION BY season ORDER BY attempts) + (count(*) OVER (PARTITION BY season, attempts) - 1) / 2 - 1) / (count(*) OVER (PARTITION BY season) - 1) AS pct, tanh((attempts - avg(attempts) OVER (PARTITION BY season)) / stddev_pop(attempts) OVER (PARTITION BY season)) AS sc FROM r)
SELECT season, team_id, round(pct, 6) AS percentile, round(50 + (pct - 50) * rel, 6) AS shrunk_percentile, round(sc, 6) AS score FROM p""")
def _(t):
    rows = t.team_seasons.select("season", "team_id", "attempts", F.least(F.col("plays") / 1000, F.lit(1.0)).alias("rel"))
    return win.percentile_score(rows, ["season"], "attempts", "rel").select("season", "team_id", F.round("percentile", 6).alias("percentile"), F.round("shrunk_percentile", 6).alias("shrunk_percentile"), F.round("score", 6).alias("score"))


@query("E11_cumulative_prior_mean", "SELECT a.actor_id, a.season, round(sum(b.value * b.volume)::DOUBLE / sum(b.volume)::DOUBLE, 6) AS prior_mean FROM actor_seasons a LEFT JOIN actor_seasons b ON a.actor_id = b.actor_id AND b.season < a.season GROUP BY 1, 2")
def _(t):
    return win.prior_mean(t.actor_seasons, ["actor_id"], "season", "value", "volume").select("actor_id", "season", F.round("prior_mean", 6).alias("prior_mean"))


@query("E12_row_index_rank", "SELECT season, team_id, row_number() OVER (ORDER BY season DESC, plays, team_id) AS k FROM team_seasons")
def _(t):
    return win.row_index(t.team_seasons.select("season", "team_id", "plays"), "season", "plays", ["team_id"]).select("season", "team_id", "k")


@query("E13_last_n_per_group", "SELECT actor_id, season, plays FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY season DESC) AS k FROM actor_seasons WHERE volume >= 1500) WHERE k <= 3")
def _(t):
    return win.top_per_group(t.actor_seasons.where("volume >= 1500"), ["actor_id"], [F.desc("season")], 3).select("actor_id", "season", "plays")


@query("F01_stable_order", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    return t.raw("customer").select("c_custkey", "c_acctbal").orderBy(F.asc_nulls_last("c_acctbal"), "c_custkey")


@query("F02_page_query", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 25")
def _(t):
    return win.page(t.raw("customer"), F.col("c_mktsegment") == "BUILDING", [F.desc("c_acctbal"), F.asc("c_custkey")], 50, 25).select("c_custkey", "c_name", "total")


@query("F03_bounded_scope", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return win.bounded_scope(t.raw("nation").select("n_nationkey", "n_name"), 100)


@query("F04_sample_rows", "SELECT season, actor_id, plays FROM actor_seasons WHERE volume > 1800 ORDER BY season, actor_id LIMIT 5")
def _(t):
    return t.actor_seasons.where("volume > 1800").select("season", "actor_id", "plays").orderBy("season", "actor_id").limit(5)


@query("F05_top_n_per_entity", "SELECT actor_id, season, value FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY value DESC, season DESC) AS k FROM actor_seasons) WHERE k <= 3")
def _(t):
    return win.top_per_group(t.actor_seasons, ["actor_id"], [F.desc("value"), F.desc("season")], 3).select("actor_id", "season", "value")
