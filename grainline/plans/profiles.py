"""Wide and long profiles of teams, actors and games (families D, H, J). Features are SQL conditions that Spark and the oracle
share, each over a denominator of its own; one grouped pass gives them all."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rates
from ..operators import aggs, joins, reshape
from ..operators import windows as win
from . import aggs as bound
from .aggs import SEASON, SIDES, season_metrics, sides
from .registry import query

C = F.col
N = lambda: F.count(F.lit(1))

GAME_KEYS = ["game_id", "season", "week", "actor_id", "team_id", "opponent_id"]
#: name -> numerator and denominator of a game's rates, by the sums below.
GAME_RATES = {
    "value_rate": ("value", "volume"), "hit_rate": ("hits", "attempts"), "attempt_rate": ("attempts", "plays"), "success_rate": ("successes", "plays"), "value_per_play": ("value", "plays"),
    "volume_per_play": ("volume", "plays"), "tax_per_play": ("taxes", "plays"), "discount_per_play": ("discounts", "plays"), "high_rate": ("high", "plays"), "attempt_value": ("value_attempted", "attempts"), "high_value": ("value_high", "high"),
}
GAME_COUNTS = {"plays": "true", "attempts": "attempt", "successes": "success", "hits": "attempt AND success", "high": "discount >= 8"}
GAME_SUMS = {"volume": "volume", "value": "value", "taxes": "tax", "discounts": "discount", "value_attempted": "CASE WHEN attempt THEN value END", "value_high": "CASE WHEN discount >= 8 THEN value END"}
_counts_sql = lambda d: ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in d.items())
_sums_sql = lambda d: ", ".join(f"CAST(sum({c}) AS BIGINT) AS {n}" for n, c in d.items())


@query("D01_entity_game_metrics", f"""WITH g AS (SELECT {', '.join(GAME_KEYS)}, min(play_id) AS first_play, {_counts_sql(GAME_COUNTS)}, {_sums_sql(GAME_SUMS)} FROM plays GROUP BY ALL)
SELECT *, first_play = min(first_play) OVER (PARTITION BY game_id, team_id) AS starter, {', '.join(f'CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b}::DOUBLE END AS {n}' for n, (a, b) in GAME_RATES.items())} FROM g""")
def _(t):
    g = t.plays_by_game.groupBy(*GAME_KEYS).agg(F.min("play_id").alias("first_play"), *(F.count_if(F.expr(c)).alias(n) for n, c in GAME_COUNTS.items()), *(F.sum(F.expr(c)).alias(n) for n, c in GAME_SUMS.items()))
    # the starter opened the team's game; a team's actors in one game are few
    out = g.withColumn("_f", F.min("first_play").over(Window.partitionBy("game_id", "team_id")))
    return out.select(*GAME_KEYS, "first_play", *GAME_COUNTS, *GAME_SUMS, (C("first_play") == C("_f")).alias("starter"), *(rates.safe_rate(C(a), C(b)).alias(n) for n, (a, b) in GAME_RATES.items()))


STARTS = "st AS (SELECT game_id, team_id, min(actor_id) AS actor_id FROM plays GROUP BY 1, 2), sr AS (SELECT st.actor_id, s.season, st.team_id, count(*) AS starts, count(*) FILTER (WHERE own > other) AS wins, count(*) FILTER (WHERE own < other) AS losses, count(*) FILTER (WHERE own = other) AS ties, CAST(sum(own) AS BIGINT) AS points_for, CAST(sum(other) AS BIGINT) AS points_against FROM st JOIN sides s ON st.game_id = s.game_id AND st.team_id = s.team GROUP BY 1, 2, 3)"


@query("D12_supplemental_statistics", f"""WITH {SEASON}, {SIDES}, {STARTS}, bx AS (SELECT actor_id, season, team_id, count(*) FILTER (WHERE attempt AND success) AS hits, CAST(sum(volume) FILTER (WHERE attempt) AS BIGINT) AS attempt_volume, count(*) FILTER (WHERE attempt AND value < -20000) AS losses_taken, CAST(sum(value) FILTER (WHERE attempt) AS BIGINT) AS attempt_value FROM plays GROUP BY 1, 2, 3)
SELECT sm.season, sm.actor_id, sm.team_id, sm.attempts, sm.games, sm.volume AS total_volume, sm.value AS total_value, coalesce(starts, 0) AS starts, wins, losses, ties, points_for, points_against, round(value_rate, 9) AS value_rate,
  CASE WHEN sm.attempts > 0 THEN 100 * hits::DOUBLE / sm.attempts END AS completion_pct, CASE WHEN sm.attempts > 0 THEN attempt_volume::DOUBLE / sm.attempts END AS volume_per_attempt,
  CASE WHEN sm.attempts > 0 THEN (attempt_value + 20 * hits - 45 * losses_taken)::DOUBLE / sm.attempts END AS adjusted_net, coalesce(wins + losses + ties = starts, true) AS reconciles
FROM sm JOIN bx USING (season, actor_id, team_id) LEFT JOIN sr USING (season, actor_id, team_id)""")
def _(t):
    keys = ["season", "actor_id", "team_id"]
    st = t.plays.groupBy("game_id", "team_id").agg(F.min("actor_id").alias("actor_id")).withColumnRenamed("team_id", "team")
    record = aggs.record(st.join(sides(t), ["game_id", "team"]), ["season", "actor_id", "team"], "own", "other").withColumnsRenamed({"team": "team_id", "games": "starts"})
    a = C("attempt")
    box = t.plays.groupBy(*keys).agg(F.count_if(a & C("success")).alias("hits"), F.sum(F.when(a, C("volume"))).alias("attempt_volume"), F.count_if(a & (C("value") < -20000)).alias("losses_taken"), F.sum(F.when(a, C("value"))).alias("attempt_value"))
    out = season_metrics(t).join(box, keys).join(record, keys, "left")
    n = C("attempts")
    return out.select(
        *keys, "attempts", "games", C("volume").alias("total_volume"), C("value").alias("total_value"), F.coalesce("starts", F.lit(0)).alias("starts"), "wins", "losses", "ties", "points_for", "points_against", F.round("value_rate", 9).alias("value_rate"),
        rates.safe_rate(100 * C("hits"), n).alias("completion_pct"), rates.safe_rate(C("attempt_volume"), n).alias("volume_per_attempt"), rates.safe_rate(C("attempt_value") + 20 * C("hits") - 45 * C("losses_taken"), n).alias("adjusted_net"),
        F.coalesce(C("wins") + C("losses") + C("ties") == C("starts"), F.lit(True)).alias("reconciles"))


@query("D13_team_season_statistics", f"""WITH {SIDES}, rec AS (SELECT season, team AS team_id, {bound.RECORD} FROM sides GROUP BY 1, 2), tn AS (SELECT season, team_id, count(*) FILTER (WHERE attempt AND NOT success AND value < -20000) AS turnovers FROM plays GROUP BY 1, 2)
SELECT ts.season, ts.team_id, plays, volume, value, attempts, successes, turnovers, games, wins, losses, ties, points_for, points_against, value::DOUBLE / plays AS value_per_play, volume::DOUBLE / plays AS volume_per_play, attempts::DOUBLE / plays AS attempt_rate,
  rank() OVER (PARTITION BY ts.season ORDER BY value DESC) AS value_rank, rank() OVER (PARTITION BY ts.season ORDER BY attempts DESC) AS attempt_rank, CASE WHEN points_for IS NOT NULL THEN rank() OVER (PARTITION BY ts.season ORDER BY points_for DESC NULLS LAST) END AS points_rank
FROM team_seasons ts JOIN tn USING (season, team_id) LEFT JOIN rec USING (season, team_id)""")
def _(t):
    keys = ["season", "team_id"]
    record = aggs.record(sides(t), ["season", "team"], "own", "other").withColumnRenamed("team", "team_id")
    lost = t.plays.groupBy(*keys).agg(F.count_if(C("attempt") & ~C("success") & (C("value") < -20000)).alias("turnovers"))
    out = t.team_seasons.drop("tax", "discount").join(lost, keys).join(record, keys, "left")
    out = out.select("*", (C("value") / C("plays")).alias("value_per_play"), (C("volume") / C("plays")).alias("volume_per_play"), (C("attempts") / C("plays")).alias("attempt_rate"))
    for c, n in (("value", "value_rank"), ("attempts", "attempt_rank"), ("points_for", "points_rank")):
        out = win.competition_rank(out, ["season"], c, n)
    return out


#: category -> feature -> (hit, among): 25 rates, each over its own denominator.
RATE_FEATURES = {
    "tendency": {"attempt": ("attempt", "true"), "attempt_first": ("attempt", "play_id <= 2"), "attempt_late": ("attempt", "play_id >= 5"), "attempt_low": ("attempt", "discount <= 2"), "attempt_high": ("attempt", "discount >= 8"), "deep": ("volume >= 40", "attempt"), "short": ("volume <= 10", "attempt")},
    "usage": {"heavy": ("tax >= 6", "true"), "light": ("tax <= 2", "true"), "middle": ("discount BETWEEN 4 AND 6", "true"), "heavy_attempt": ("tax >= 6", "attempt"), "light_attempt": ("tax <= 2", "attempt"), "wide": ("discount >= 8", "attempt"), "narrow": ("discount <= 2", "attempt")},
    "situational": {"attempt_opening": ("attempt", "week <= 3"), "attempt_closing": ("attempt", "week >= 10"), "attempt_third": ("attempt", "play_id = 3"), "attempt_peer": ("attempt", "opponent_id % 5 = team_id % 5"), "attempt_behind": ("attempt", "value < 0")},
    "outcome": {"success": ("success", "attempt"), "success_high": ("success", "discount >= 8"), "positive": ("value > 0", "true"), "positive_attempt": ("value > 0", "attempt"), "explosive": ("value >= 20000", "true"), "loss": ("value <= -20000", "true")},
}
#: feature -> (column, among): five means, by category.
MEAN_FEATURES = {"outcome": {"mean_value": ("value", "true"), "attempt_value": ("value", "attempt"), "rest_value": ("value", "NOT attempt")}, "usage": {"mean_volume": ("volume", "true"), "high_volume": ("volume", "discount >= 8")}}
#: feature -> (column, among, quantile).
QUANTILE_FEATURES = {"outcome": {"value_p90": ("value", "attempt", 0.9)}}
_flat = lambda d: {n: (k, *v) for k, own in d.items() for n, v in own.items()}
ALL_RATES, ALL_MEANS, ALL_QUANTILES = _flat(RATE_FEATURES), _flat(MEAN_FEATURES), _flat(QUANTILE_FEATURES)
CATEGORY = {n: v[0] for n, v in (ALL_RATES | ALL_MEANS | ALL_QUANTILES).items()}


def _long_sql(keys: str) -> str:
    """w: a column pair a feature; l: long rows with category, feature, numerator, denominator, value."""
    cols, num, den, val = [], [], [], []
    for n, (_, hit, among) in ALL_RATES.items():
        cols += [f"count(*) FILTER (WHERE ({hit}) AND ({among})) AS {n}_n", f"count(*) FILTER (WHERE {among}) AS {n}_d"]
        num, den, val = [*num, f"{n}_n"], [*den, f"{n}_d"], [*val, f"CASE WHEN {n}_d > 0 THEN {n}_n::DOUBLE / {n}_d END"]
    for n, (_, c, among) in ALL_MEANS.items():
        cols += [f"CAST(sum({c}) FILTER (WHERE {among}) AS BIGINT) AS {n}_n", f"count({c}) FILTER (WHERE {among}) AS {n}_d"]
        num, den, val = [*num, f"{n}_n"], [*den, f"{n}_d"], [*val, f"CASE WHEN {n}_d > 0 THEN {n}_n::DOUBLE / {n}_d END"]
    for n, (_, c, among, q) in ALL_QUANTILES.items():
        cols += [f"quantile_cont(CASE WHEN {among} THEN {c} END, {q}) AS {n}_q", f"count({c}) FILTER (WHERE {among}) AS {n}_d"]
        num, den, val = [*num, "NULL"], [*den, f"{n}_d"], [*val, f"{n}_q"]
    names = ", ".join(f"'{n}'" for n in CATEGORY)
    kinds = ", ".join(f"'{c}'" for c in CATEGORY.values())
    return f"w AS (SELECT {keys}, {', '.join(cols)} FROM plays GROUP BY ALL), l31 AS (SELECT {keys}, unnest([{kinds}]) AS category, unnest([{names}]) AS feature, unnest([{', '.join(num)}]) AS numerator, unnest([{', '.join(den)}]) AS denominator, round(unnest([{', '.join(val)}]), 9) AS value FROM w)"


PROFILES = _long_sql("team_id, season")


def team_profiles(t):
    """31 features of each team and season, long, with their category. The quantile is exact and held per team and season."""
    rate = {n: (F.expr(hit), F.expr(among)) for n, (_, hit, among) in ALL_RATES.items()}
    mean = {n: F.when(F.expr(among), C(c)) for n, (_, c, among) in ALL_MEANS.items()}
    quantile = {n: (F.when(F.expr(among), C(c)), q) for n, (_, c, among, q) in ALL_QUANTILES.items()}
    long = aggs.profile_long(t.plays, ["team_id", "season"], rate, mean, quantile)
    kind = F.create_map(*(F.lit(x) for pair in CATEGORY.items() for x in pair))
    return long.withColumn("category", kind[C("feature")])


@query("D18_scheme_profiles", f"WITH {PROFILES} SELECT * FROM l31")
def _(t):
    return team_profiles(t)


CODES = range(9)


@query("D20_mechanic_flag_rates", f"""
SELECT team_id, season, avg(CASE WHEN discount > 2 THEN attempt::INT END) AS attempt_rate, count(CASE WHEN discount > 2 THEN attempt END) AS attempt_n, avg(CASE WHEN tax = 1 THEN success::INT END) AS success_rate, count(CASE WHEN tax = 1 THEN success END) AS success_n,
  {', '.join(f'(count(*) FILTER (WHERE attempt AND tax = {k}))::DOUBLE / nullif(count(*) FILTER (WHERE attempt), 0) AS code_{k}' for k in CODES)} FROM plays GROUP BY 1, 2""")
def _(t):
    flag = lambda c, ok: F.when(ok, C(c).cast("int"))
    a, s = flag("attempt", C("discount") > 2), flag("success", C("tax") == 1)
    code = F.when(C("attempt"), C("tax"))  # no code where nothing was attempted
    return t.plays.groupBy("team_id", "season").agg(F.avg(a).alias("attempt_rate"), F.count(a).alias("attempt_n"), F.avg(s).alias("success_rate"), F.count(s).alias("success_n"), *(rates.safe_rate(F.count_if(code == k), F.count(code)).alias(f"code_{k}") for k in CODES))


_E = bound.ERA


@query("D35_era_rollup", f"""
WITH a AS (SELECT {_E} AS era, count(*) AS plays, CAST(sum(value) AS BIGINT) AS value FROM plays GROUP BY 1), b AS (SELECT {_E} AS era, count(*) AS games FROM games GROUP BY 1), c AS (SELECT {_E} AS era, count(*) AS shared_intervals FROM intervals WHERE shared GROUP BY 1),
d AS (SELECT {_E} AS era, count(*) AS verified_intervals FROM intervals WHERE status = 'verified' GROUP BY 1), e AS (SELECT {_E} AS era, count(*) AS qualified_seasons FROM actor_seasons WHERE volume >= 1700 GROUP BY 1), f AS (SELECT {_E} AS era, count(DISTINCT owner_id) AS owners FROM intervals WHERE role = 1 GROUP BY 1), g AS (SELECT {_E} AS era, count(*) AS playoff_games FROM games WHERE game_type = 'POST' GROUP BY 1)
SELECT era, plays, value, games, coalesce(shared_intervals, 0) AS shared_intervals, coalesce(verified_intervals, 0) AS verified_intervals, coalesce(qualified_seasons, 0) AS qualified_seasons, coalesce(owners, 0) AS owners, coalesce(playoff_games, 0) AS playoff_games
FROM a JOIN b USING (era) LEFT JOIN c USING (era) LEFT JOIN d USING (era) LEFT JOIN e USING (era) LEFT JOIN f USING (era) LEFT JOIN g USING (era)""")
def _(t):
    e = bound.era().alias("era")
    out = t.plays.groupBy(e).agg(N().alias("plays"), F.sum("value").alias("value"))
    # conditions on one table share a pass
    games = t.games.groupBy(e).agg(N().alias("games"), F.count_if(C("game_type") == "POST").alias("playoff_games"))
    owned = t.intervals.groupBy(e).agg(F.count_if("shared").alias("shared_intervals"), F.count_if(C("status") == "verified").alias("verified_intervals"), F.count_distinct(F.when(C("role") == 1, C("owner_id"))).alias("owners"))
    actors = t.actor_seasons.groupBy(e).agg(F.count_if(C("volume") >= 1700).alias("qualified_seasons"))
    return out.join(games, "era").join(owned, "era", "left").join(actors, "era", "left").fillna(0)


POPULATIONS = {"all": "true", "qualified": "volume >= 2000", "recent": "season >= 1999", "early": "season <= 1997", "positive": "value > 0", "thin": "plays < 60", "attempting": "attempts * 3 >= plays", "succeeding": "successes * 2 >= plays", "light": "volume < 1500"}


@query("D36_sample_summary", f"""
SELECT population, count(*) AS n, count(DISTINCT actor_id) AS actors, count(DISTINCT team_id) AS teams, count(DISTINCT season) AS seasons_seen, CAST(sum(volume) AS BIGINT) AS volume FROM (
  {' UNION ALL '.join(f"SELECT '{n}' AS population, * FROM actor_seasons WHERE {c}" for n, c in POPULATIONS.items())}) GROUP BY 1""")
def _(t):
    return aggs.tagged_aggregates(t.actor_seasons, {n: F.expr(c) for n, c in POPULATIONS.items()}, [N().alias("n"), F.count_distinct("actor_id").alias("actors"), F.count_distinct("team_id").alias("teams"), F.count_distinct("season").alias("seasons_seen"), F.sum("volume").alias("volume")])


WIDE = ["success", "positive", "attempt"]
ATTRIBUTES = {"value": "value", "reliability": "denominator / (denominator + CAST(50 AS DOUBLE))", "missing": "CASE WHEN value IS NULL THEN 1 ELSE 0 END", "se": "sqrt(value * (1 - value) / denominator)", "low": "greatest(0.0, value - 1.96 * sqrt(value * (1 - value) / denominator))", "high": "least(1.0, value + 1.96 * sqrt(value * (1 - value) / denominator))", "weight": "denominator / (denominator + CAST(100 AS DOUBLE))"}
_ATTR_SQL = {n: x.replace("1.96", "1.96::DOUBLE") for n, x in ATTRIBUTES.items()}


@query("H02_multi_pivot", f"""WITH {PROFILES}, x AS (SELECT team_id, season, feature, {', '.join(f'round({e}, 7) AS {n}' for n, e in _ATTR_SQL.items() if n != 'missing')}, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS missing FROM l31 WHERE feature IN ({', '.join(f"'{n}'" for n in WIDE)}) AND denominator > 0)
SELECT team_id, season, {', '.join(f"max({a}) FILTER (WHERE feature = '{n}') AS {n}_{a}" for n in WIDE for a in ATTRIBUTES)} FROM x GROUP BY 1, 2""")
def _(t):
    x = team_profiles(t).where(C("feature").isin(WIDE) & (C("denominator") > 0))
    x = x.select("team_id", "season", "feature", *(F.expr(e).alias(n) if n == "missing" else F.round(F.expr(e), 7).alias(n) for n, e in ATTRIBUTES.items()))
    return reshape.pivot_wide(x, ["team_id", "season"], "feature", {a: f"_{a}" for a in ATTRIBUTES}, WIDE)


@query("J08_scheme_table", f"WITH {PROFILES} SELECT team_id, season, feature, category, value, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 5) AS z, category = 'usage' AS usage FROM l31 WINDOW w AS (PARTITION BY season, feature)")
def _(t):
    reg = t.spark.createDataFrame([(n, c == "usage") for n, c in CATEGORY.items()], "feature string, usage boolean")
    z = win.zscore(team_profiles(t).select("team_id", "season", "feature", "category", "value"), ["season", "feature"], "value", population=True)
    return joins.checked_join(z, F.broadcast(reg), ["feature"], cardinality="m:1").select("team_id", "season", "feature", "category", "value", F.round("z", 5).alias("z"), "usage")


#: the 24 rates and two values that an actor's profile has.
ACTOR_RATES = {n: v for n, v in ALL_RATES.items() if n != "attempt_peer"}
_NEED = 20


def _actor_sql() -> str:
    cols, num, den, ss = [], [], [], []
    for n, (_, hit, among) in ACTOR_RATES.items():
        cols += [f"count(*) FILTER (WHERE ({hit}) AND ({among})) AS {n}_n", f"count(*) FILTER (WHERE {among}) AS {n}_d"]
        num, den, ss = [*num, f"{n}_n"], [*den, f"{n}_d"], [*ss, f"{n}_n"]
    for n, among in (("value", "true"), ("attempt_value", "attempt")):
        cols += [f"CAST(sum(value) FILTER (WHERE {among}) AS BIGINT) AS {n}_n", f"count(*) FILTER (WHERE {among}) AS {n}_d", f"CAST(sum(value * value) FILTER (WHERE {among}) AS BIGINT) AS {n}_s"]
        num, den, ss = [*num, f"{n}_n"], [*den, f"{n}_d"], [*ss, f"{n}_s"]
    names = ", ".join(f"'{n}'" for n in [*ACTOR_RATES, "value", "attempt_value"])
    return f"aw AS (SELECT actor_id, team_id, season, {', '.join(cols)} FROM plays GROUP BY ALL), al AS (SELECT actor_id, team_id, season, unnest([{names}]) AS feature, unnest([{', '.join(num)}]) AS numerator, unnest([{', '.join(den)}]) AS denominator, unnest([{', '.join(ss)}]) AS sum_squares FROM aw), ap AS (SELECT *, CASE WHEN denominator > 0 THEN numerator::DOUBLE / denominator END AS raw, denominator >= {_NEED} AS qualified FROM al)"


ACTOR_PROFILES = _actor_sql()


def actor_profiles(t):
    """26 features of each actor, team and season, long, with sums of squares."""
    cols, features = [], {}
    for n, (_, hit, among) in ACTOR_RATES.items():
        cols += [F.count_if(F.expr(f"({hit}) AND ({among})")).alias(f"{n}_n"), F.count_if(F.expr(among)).alias(f"{n}_d")]
        features[n] = (C(f"{n}_n"), C(f"{n}_d"), C(f"{n}_n"), C(f"{n}_d") >= _NEED)
    for n, among in (("value", F.lit(True)), ("attempt_value", C("attempt"))):
        s, k, ss = rates.conditional_sums(C("value"), among)
        cols += [s.alias(f"{n}_n"), k.alias(f"{n}_d"), ss.alias(f"{n}_s")]
        features[n] = (C(f"{n}_n"), C(f"{n}_d"), C(f"{n}_s"), C(f"{n}_d") >= _NEED)
    keys = ["actor_id", "team_id", "season"]
    return reshape.profile_unpivot(t.plays.groupBy(*keys).agg(*cols), keys, features)


@query("J13_qb_profiles", f"WITH {ACTOR_PROFILES} SELECT * FROM ap")
def _(t):
    return actor_profiles(t)


#: feature -> expression over a play and its two enrichments, NULL where the enrichment has no row.
MERGED = {"attempt": "CAST(attempt AS INT)", "success": "CAST(success AS INT)", "high": "CAST(discount >= 8 AS INT)", "heavy": "CAST(tax >= 6 AS INT)", "home_won": "CAST(home_score > away_score AS INT)", "close": "CAST(abs(home_score - away_score) <= 7 AS INT)", "playoff": "CAST(game_type = 'POST' AS INT)", "large": "CAST(p_size >= 25 AS INT)", "dear": "CAST(p_retailprice >= 1200 AS INT)", "steel": "CAST(p_type LIKE '%STEEL' AS INT)"}


@query("J42_merged_play_fingerprint", f"""
WITH j AS (SELECT * FROM plays LEFT JOIN (SELECT game_id, home_score, away_score, game_type FROM games) USING (game_id) LEFT JOIN (SELECT p_partkey AS game_id, p_size, p_retailprice, p_type FROM part) USING (game_id))
SELECT team_id, season, count(*) AS n, {', '.join(f'round(avg({e}), 8) AS {n}, count({e})::DOUBLE / count(*) AS {n}_coverage' for n, e in MERGED.items())} FROM j GROUP BY 1, 2""")
def _(t):
    # the second enrichment covers few games; its share shows in the coverage
    g = t.games.select("game_id", "home_score", "away_score", "game_type")
    p = t.raw("part").select(C("p_partkey").alias("game_id"), "p_size", "p_retailprice", "p_type")
    j = joins.checked_join(joins.checked_join(t.plays, g, ["game_id"], "left", "m:1"), p, ["game_id"], "left", "m:1")
    cols = [x for n, e in MERGED.items() for x in (F.round(F.avg(F.expr(e)), 8).alias(n), (F.count(F.expr(e)) / N()).alias(f"{n}_coverage"))]
    return j.groupBy("team_id", "season").agg(N().alias("n"), *cols)


CONTEXT = {"discount": "discount", "tax": "tax", "play_id": "play_id", "period": "(week - 1) DIV 4", "size": "volume DIV 26"}
_CTX_SQL = {n: e.replace("DIV", "//") for n, e in CONTEXT.items()}
_CK = ", ".join(CONTEXT)


@query("J07_expected_rate_by_context", f"""
WITH c AS (SELECT season, {', '.join(f'CAST({e} AS INT) AS {n}' for n, e in _CTX_SQL.items())}, team_id, count(*) AS n, count(*) FILTER (WHERE attempt) AS h FROM plays GROUP BY ALL),
b AS (SELECT s.season, sum(h)::DOUBLE / sum(n)::DOUBLE AS base FROM seasons s JOIN c ON c.season < s.season AND c.season >= s.season - 5 GROUP BY 1),
e AS (SELECT s.season, {_CK}, (sum(h) + 50 * any_value(base)) / (sum(n) + 50) AS e FROM seasons s JOIN c ON c.season < s.season AND c.season >= s.season - 5 JOIN b ON b.season = s.season GROUP BY ALL)
SELECT c.team_id, c.season, CAST(sum(n) AS BIGINT) AS n, round(sum(h)::DOUBLE / sum(n)::DOUBLE, 8) AS observed, round(sum(n * coalesce(e, base)) / sum(n), 6) AS expected, round(sum(h)::DOUBLE / sum(n)::DOUBLE - sum(n * coalesce(e, base)) / sum(n), 6) AS over_expected, CAST(sum(n) FILTER (WHERE e IS NULL) AS BIGINT) AS unseen
FROM c JOIN b USING (season) LEFT JOIN e USING (season, {_CK}) GROUP BY 1, 2""")
def _(t):
    keys = list(CONTEXT)
    cells = t.plays.select("season", "team_id", "attempt", *(F.expr(e).cast("int").alias(n) for n, e in CONTEXT.items())).groupBy("season", *keys, "team_id").agg(N().alias("n"), F.count_if("attempt").alias("h"))
    # each season's counts serve the five seasons after it
    ahead = cells.groupBy("season", *keys).agg(F.sum("n").alias("n"), F.sum("h").alias("h")).withColumn("season", F.explode(F.sequence(C("season") + 1, C("season") + 5)))
    base = ahead.groupBy("season").agg((F.sum("h") / F.sum("n")).alias("base"))
    ctx = ahead.groupBy("season", *keys).agg(F.sum("h").alias("h"), F.sum("n").alias("n")).join(F.broadcast(base), "season").select("season", *keys, ((C("h") + 50 * C("base")) / (C("n") + 50)).alias("e"))
    j = cells.join(F.broadcast(base), "season").join(ctx, ["season", *keys], "left")
    seen, want = F.sum("h") / F.sum("n"), F.sum(C("n") * F.coalesce("e", "base")) / F.sum("n")
    return j.groupBy("team_id", "season").agg(F.sum("n").alias("n"), F.round(seen, 8).alias("observed"), F.round(want, 6).alias("expected"), F.round(seen - want, 6).alias("over_expected"), F.sum(F.when(C("e").isNull(), C("n"))).alias("unseen"))


@query("J36_feature_correlations", f"""WITH {PROFILES}, c AS (SELECT x.feature AS first_feature, y.feature AS second_feature, count(*) AS n, CASE WHEN var_pop(x.value) > 1e-18 AND var_pop(y.value) > 1e-18 THEN round(corr(x.value, y.value), 5) END AS r
  FROM l31 x JOIN l31 y ON x.team_id = y.team_id AND x.season = y.season AND x.feature < y.feature WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT *, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, first_feature, second_feature) AS rank FROM c""")
def _(t):
    # a team-season's features are one row, which gives all its pairs: an upper triangle with pairwise counts, no self-join
    wide = team_profiles(t).where("value IS NOT NULL").groupBy("team_id", "season").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("f"))
    pairs = F.expr("flatten(transform(f, (a, i) -> transform(slice(f, i + 2, size(f)), b -> struct(a.feature AS first_feature, b.feature AS second_feature, a.value AS u, b.value AS v))))")
    out = wide.select(F.explode(pairs).alias("p")).select("p.*").groupBy("first_feature", "second_feature").agg(F.count(F.lit(1)).alias("n"), F.var_pop("u").alias("vu"), F.var_pop("v").alias("vv"), F.covar_pop("u", "v").alias("c")).where("n >= 20")
    r = F.when((C("vu") > 1e-18) & (C("vv") > 1e-18), F.round(C("c") / F.sqrt(C("vu") * C("vv")), 5))
    out = out.select("first_feature", "second_feature", "n", r.alias("r"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.abs("r")), "first_feature", "second_feature")))  # a row a pair of features
