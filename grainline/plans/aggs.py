"""Queries of family D (aggregations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rates
from ..operators import aggs, joins
from .registry import query



def season_metrics(t):
    out = aggs.entity_metrics(t.plays, ["season", "actor_id", "team_id"], {"attempts": F.col("attempt"), "successes": F.col("success")}, {"volume": F.col("volume"), "value": F.col("value")}, {"value_rate": ("value", "volume"), "success_rate": ("successes", "attempts")}, {"games": "game_id"})
    return out.withColumn("qualifies", F.col("volume") >= 200)


SEASON = """sm AS (SELECT season, actor_id, team_id, count(*) FILTER (WHERE attempt) AS attempts, count(*) FILTER (WHERE success) AS successes, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(value) AS BIGINT) AS value, count(DISTINCT game_id) AS games,
  CASE WHEN sum(volume) > 0 THEN sum(value)::DOUBLE / sum(volume)::DOUBLE END AS value_rate, CASE WHEN count(*) FILTER (WHERE attempt) > 0 THEN (count(*) FILTER (WHERE success))::DOUBLE / count(*) FILTER (WHERE attempt) END AS success_rate, sum(volume) >= 200 AS qualifies
  FROM plays GROUP BY season, actor_id, team_id)"""


@query("D02_entity_season_metrics", f"WITH {SEASON} SELECT * FROM sm")
def _(t):
    return season_metrics(t)


@query("D03_prior_season_deltas", f"""WITH {SEASON}, tot AS (SELECT season, actor_id, sum(volume) AS volume, sum(value) AS value FROM sm GROUP BY 1, 2),
r AS (SELECT season, actor_id, CASE WHEN volume >= 1500 THEN value::DOUBLE / volume::DOUBLE END AS rate FROM tot)
SELECT a.season, a.actor_id, round(a.rate, 9) AS rate, round(b.rate, 9) AS prior_rate, round(a.rate - b.rate, 9) AS delta FROM r a LEFT JOIN r b ON a.actor_id = b.actor_id AND a.season = b.season + 1""")
def _(t):
    from ..operators.joins import lag_join

    tot = season_metrics(t).groupBy("season", "actor_id").agg(F.sum("volume").alias("volume"), F.sum("value").alias("value"))
    r = tot.select("season", "actor_id", F.when(F.col("volume") >= 1500, F.col("value") / F.col("volume")).alias("rate"))
    out = lag_join(r, ["actor_id"], "season", ["rate"])
    return out.select("season", "actor_id", F.round("rate", 9).alias("rate"), F.round("prior_rate", 9).alias("prior_rate"), F.round(F.col("rate") - F.col("prior_rate"), 9).alias("delta"))


@query("D04_safe_rate", "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_partkey::DOUBLE / (p_size % 5) END AS rate FROM part")
def _(t):
    return t.raw("part").select("p_partkey", rates.safe_rate(F.col("p_partkey"), F.col("p_size") % 5).alias("rate"))


@query("D05_sum_if_observed", "SELECT actor_id, CAST(sum(CASE WHEN discount = 0 AND actor_id % 3 = 0 THEN value END) AS BIGINT) AS observed, CAST(coalesce(sum(CASE WHEN discount = 0 AND actor_id % 3 = 0 THEN value END), 0) AS BIGINT) AS or_zero FROM plays GROUP BY 1")
def _(t):
    v = F.when((F.col("discount") == 0) & (F.col("actor_id") % 3 == 0), F.col("value"))
    return t.plays.groupBy("actor_id").agg(rates.sum_if_observed(v).alias("observed"), rates.sum_or_zero(v).alias("or_zero"))


@query("D06_conditional_sum", "SELECT team_id, CAST(sum(value) FILTER (WHERE attempt) AS BIGINT) AS s, count(value) FILTER (WHERE attempt) AS n, CAST(sum(value * value) FILTER (WHERE attempt) AS BIGINT) AS ss FROM plays GROUP BY 1")
def _(t):
    s, n, ss = rates.conditional_sums(F.col("value"), F.col("attempt"))
    return t.plays.groupBy("team_id").agg(s.alias("s"), n.alias("n"), ss.alias("ss"))


@query("D07_distinct_struct_filtered", "SELECT team_id, count(DISTINCT CASE WHEN attempt THEN (season, actor_id) END) AS pairs, count(DISTINCT actor_id) AS actors FROM plays GROUP BY 1")
def _(t):
    return t.plays.groupBy("team_id").agg(F.count_distinct(F.when(F.col("attempt"), F.struct("season", "actor_id"))).alias("pairs"), F.count_distinct("actor_id").alias("actors"))


@query("D08_weighted_mean", "SELECT team_id, round(sum(value * volume)::DOUBLE / sum(volume)::DOUBLE, 6) AS m FROM plays WHERE discount > 0 GROUP BY 1")
def _(t):
    p = t.plays.withColumn("x", F.when(F.col("discount") > 0, F.col("value")))
    return p.groupBy("team_id").agg(F.round(aggs.weighted_mean("x", "volume"), 6).alias("m"))


SIDES = """sides AS (SELECT game_id, season, game_type, home_team AS team, home_score AS own, away_score AS other FROM games UNION ALL SELECT game_id, season, game_type, away_team, away_score, home_score FROM games)"""


def sides(t):
    c = F.col
    return aggs.unpivot_sides(t.games, ["game_id", "season", "game_type"], [{"team": c("home_team"), "own": c("home_score"), "other": c("away_score")}, {"team": c("away_team"), "own": c("away_score"), "other": c("home_score")}])


RECORD = "count(*) AS games, count(*) FILTER (WHERE own > other) AS wins, count(*) FILTER (WHERE own < other) AS losses, count(*) FILTER (WHERE own = other) AS ties, CAST(sum(own) AS BIGINT) AS points_for, CAST(sum(other) AS BIGINT) AS points_against"


@query("D09_home_away_unpivot", f"WITH {SIDES} SELECT season, team, {RECORD} FROM sides GROUP BY 1, 2")
def _(t):
    return aggs.record(sides(t), ["season", "team"], "own", "other")


@query("D10_starter_record", f"""WITH {SIDES}, st AS (SELECT game_id, team_id, min(actor_id) AS actor_id FROM plays GROUP BY 1, 2)
SELECT actor_id, {RECORD} FROM st JOIN sides s ON st.game_id = s.game_id AND st.team_id = s.team GROUP BY 1""")
def _(t):
    st = t.plays.groupBy("game_id", "team_id").agg(F.min("actor_id").alias("actor_id")).withColumnRenamed("team_id", "team")
    return aggs.record(st.join(sides(t), ["game_id", "team"]), ["actor_id"], "own", "other")


@query("D11_box_totals", "SELECT actor_id, team_id, season, CAST(sum(CASE WHEN tax < 8 THEN volume END) AS BIGINT) AS a, CAST(sum(CASE WHEN discount = 10 THEN value END) AS BIGINT) AS b FROM plays GROUP BY 1, 2, 3")
def _(t):
    return t.plays.groupBy("actor_id", "team_id", "season").agg(rates.sum_if_observed(F.when(F.col("tax") < 8, F.col("volume"))).alias("a"), rates.sum_if_observed(F.when(F.col("discount") == 10, F.col("value"))).alias("b"))


@query("D14_injury_weeks", "SELECT actor_id, season, count(DISTINCT week) AS listed, count(DISTINCT CASE WHEN tax = 0 THEN week END) AS out_weeks FROM plays WHERE discount >= 8 GROUP BY 1, 2")
def _(t):
    return t.plays.where("discount >= 8").groupBy("actor_id", "season").agg(F.count_distinct("week").alias("listed"), F.count_distinct(F.when(F.col("tax") == 0, F.col("week"))).alias("out_weeks"))


def _profile_sql(which: str) -> str:
    return f"""WITH w AS (SELECT team_id, season, count(*) FILTER (WHERE success AND attempt) AS n1, count(*) FILTER (WHERE attempt) AS d1, count(*) FILTER (WHERE value > 0 AND discount >= 5) AS n2, count(*) FILTER (WHERE discount >= 5) AS d2,
      CAST(sum(CASE WHEN tax > 2 THEN value END) AS BIGINT) AS n3, count(CASE WHEN tax > 2 THEN value END) AS d3, quantile_cont(CASE WHEN attempt THEN value END, 0.9) AS q4, count(CASE WHEN attempt THEN value END) AS d4 FROM plays GROUP BY 1, 2)
    SELECT * FROM (SELECT team_id, season, 'success' AS feature, n1 AS numerator, d1 AS denominator, round(CASE WHEN d1 > 0 THEN n1::DOUBLE / d1 END, 9) AS value FROM w
    UNION ALL SELECT team_id, season, 'positive', n2, d2, round(CASE WHEN d2 > 0 THEN n2::DOUBLE / d2 END, 9) FROM w
    UNION ALL SELECT team_id, season, 'mean_value', n3, d3, round(CASE WHEN d3 > 0 THEN n3::DOUBLE / d3 END, 9) FROM w
    UNION ALL SELECT team_id, season, 'value_p90', NULL, d4, round(q4::DOUBLE, 9) FROM w) WHERE {which}"""


def _rates():
    return {"success": (F.col("success"), F.col("attempt")), "positive": (F.col("value") > 0, F.col("discount") >= 5)}


def _means():
    return {"mean_value": F.when(F.col("tax") > 2, F.col("value"))}


def _quantiles():
    return {"value_p90": (F.when(F.col("attempt"), F.col("value")), 0.9)}


@query("D15_profile_rate", _profile_sql("feature IN ('success', 'positive')"))
def _(t):
    return aggs.profile_long(t.plays, ["team_id", "season"], _rates())


@query("D16_profile_mean", _profile_sql("feature = 'mean_value'"))
def _(t):
    return aggs.profile_long(t.plays, ["team_id", "season"], {}, _means())


@query("D17_profile_quantile", _profile_sql("feature = 'value_p90'"))
def _(t):
    return aggs.profile_long(t.plays, ["team_id", "season"], {}, {}, _quantiles())


@query("D19_category_share_grid", """
WITH c AS (SELECT team_id, tax, count(*) AS n FROM plays WHERE tax IS NOT NULL GROUP BY 1, 2), g AS (SELECT team_id, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1)
SELECT g.team_id, k.tax, coalesce(n, 0) AS n, total, coalesce(n, 0)::DOUBLE / total AS share FROM g CROSS JOIN (SELECT DISTINCT tax FROM c) k LEFT JOIN c ON c.team_id = g.team_id AND c.tax = k.tax""")
def _(t):
    return aggs.category_shares(t.plays, ["team_id"], "tax")


@query("D21_string_set_agg", "SELECT team_id, season, string_agg(DISTINCT role::VARCHAR, '|' ORDER BY role::VARCHAR) AS roles FROM intervals GROUP BY 1, 2")
def _(t):
    return t.intervals.groupBy("team_id", "season").agg(aggs.string_set(F.col("role")).alias("roles"))


@query("D22_coverage_matrix_status", """
WITH w AS (SELECT season, team_id, role, status, unnest(range(start_week, end_week + 1)) AS wk FROM intervals),
s AS (SELECT season, team_id, role, count(DISTINCT CASE WHEN status = 'verified' THEN wk END) AS v, count(DISTINCT CASE WHEN status <> 'unresolved' THEN wk END) AS s, count(DISTINCT wk) AS a FROM w WHERE wk BETWEEN 1 AND 8 GROUP BY 1, 2, 3),
g AS (SELECT season, n_nationkey AS team_id, CAST(role AS INT) AS role FROM seasons CROSS JOIN nation CROSS JOIN (SELECT unnest(range(4)) AS role))
SELECT season, team_id, role, coalesce(v, 0) AS verified_weeks, coalesce(a, 0) AS any_weeks, CASE WHEN v IS NULL THEN 'absent' WHEN v = 8 THEN 'verified' WHEN s = 8 THEN 'supported' WHEN v > 0 THEN 'partly_verified' WHEN s > 0 THEN 'partly_supported' ELSE 'unresolved' END AS coverage
FROM g LEFT JOIN s USING (season, team_id, role)""")
def _(t):
    roles = t.spark.range(4).select(F.col("id").cast("int").alias("role"))
    g = t.seasons.crossJoin(t.raw("nation").select(F.col("n_nationkey").alias("team_id"))).crossJoin(roles)
    return aggs.coverage_status(t.intervals, 8, g, ["season", "team_id", "role"])


@query("D23_coverage_matrix_basic", """
WITH c AS (SELECT interval_id, count(*) AS n FROM intervals JOIN pages ON page_id = owner_id GROUP BY 1),
o AS (SELECT season, team_id, role, count(*) AS n, bool_or(shared) AS any_shared, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'unresolved') AS unresolved, coalesce(CAST(sum(c.n) AS BIGINT), 0) AS citations,
  '[' || string_agg('{"start":' || start_week || ',"end":' || end_week || ',"id":"' || interval_id || '"}', ',' ORDER BY start_week, end_week, interval_id) || ']' AS intervals_json FROM intervals LEFT JOIN c USING (interval_id) GROUP BY 1, 2, 3)
SELECT season, n_nationkey AS team_id, CAST(g.role AS INT) AS role, coalesce(n, 0) AS n, coalesce(any_shared, false) AS any_shared, coalesce(verified, 0) AS verified, coalesce(citations, 0) AS citations,
  CASE WHEN n IS NULL THEN 'missing' WHEN unresolved > 0 THEN 'conflicting' WHEN verified < n THEN 'provisional' ELSE 'verified' END AS status, coalesce(intervals_json, '[]') AS intervals_json
FROM seasons CROSS JOIN nation CROSS JOIN (SELECT unnest(range(4)) AS role) g LEFT JOIN o USING (season, role) WHERE o.team_id = n_nationkey
UNION ALL SELECT season, n_nationkey, CAST(g.role AS INT), 0, false, 0, 0, 'missing', '[]' FROM seasons CROSS JOIN nation CROSS JOIN (SELECT unnest(range(4)) AS role) g WHERE (season, n_nationkey, g.role) NOT IN (SELECT (season, team_id, role) FROM o)""")
def _(t):
    item = F.struct(F.col("start_week").alias("start"), F.col("end_week").alias("end"), F.col("interval_id").alias("id"))
    cited = t.raw("pages").groupBy(F.col("page_id").alias("owner_id")).agg(F.count(F.lit(1)).alias("cited"))
    o = t.intervals.join(cited, "owner_id", "left").groupBy("season", "team_id", "role").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("shared").alias("any_shared"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "unresolved").alias("unresolved"), F.coalesce(F.sum("cited"), F.lit(0)).alias("citations"), F.to_json(F.sort_array(F.collect_list(item))).alias("intervals_json"))
    roles = t.spark.range(4).select(F.col("id").cast("int").alias("role"))
    full = joins.grid([t.seasons, t.raw("nation").select(F.col("n_nationkey").alias("team_id")), roles], o, ["season", "team_id", "role"], {"n": 0, "any_shared": False, "verified": 0, "unresolved": 0, "citations": 0, "intervals_json": "[]"})
    status = F.when(F.col("n") == 0, "missing").when(F.col("unresolved") > 0, "conflicting").when(F.col("verified") < F.col("n"), "provisional").otherwise("verified")
    return full.select("season", "team_id", "role", "n", "any_shared", "verified", "citations", status.alias("status"), "intervals_json")


@query("D24_role_matrix_audit", """
WITH c AS (SELECT season, team_id, role, string_agg(interval_id, '|' ORDER BY interval_id) AS interval_ids, string_agg(DISTINCT owner_id::VARCHAR, '|' ORDER BY owner_id::VARCHAR) AS owners, bool_and(status <> 'unresolved') AS resolved FROM intervals GROUP BY 1, 2, 3),
g AS (SELECT season, n_nationkey AS team_id, CAST(role AS INT) AS role FROM seasons CROSS JOIN nation CROSS JOIN (SELECT unnest(range(4)) AS role))
SELECT season, team_id, role, coalesce(interval_ids, '') AS interval_ids, coalesce(owners, '') AS owners, coalesce(NOT resolved, true) AS queued FROM g LEFT JOIN c USING (season, team_id, role)""")
def _(t):
    from ..operators.joins import grid

    roles = t.spark.range(4).select(F.col("id").cast("int").alias("role"))
    seen = t.intervals.groupBy("season", "team_id", "role").agg(aggs.string_set(F.col("interval_id")).alias("interval_ids"), aggs.string_set(F.col("owner_id")).alias("owners"), (~F.bool_and(F.col("status") != "unresolved")).alias("queued"))
    return grid([t.seasons, t.raw("nation").select(F.col("n_nationkey").alias("team_id")), roles], seen, ["season", "team_id", "role"], {"interval_ids": "", "owners": "", "queued": True})


RECORDS = """recs AS (SELECT actor_id, season + 1 AS target, 'rate' AS feature, CASE WHEN volume % 4 <> 0 THEN value::DOUBLE / volume END AS value, season AS source FROM actor_seasons UNION ALL SELECT actor_id, season + 1, 'share', attempts::DOUBLE / plays, season FROM actor_seasons WHERE plays > 70)"""


def records(t):
    a = t.actor_seasons
    one = a.select("actor_id", (F.col("season") + 1).alias("target"), F.lit("rate").alias("feature"), F.when(F.col("volume") % 4 != 0, F.col("value") / F.col("volume")).alias("value"), F.col("season").alias("source"))
    return one.unionByName(a.where("plays > 70").select("actor_id", (F.col("season") + 1).alias("target"), F.lit("share").alias("feature"), (F.col("attempts") / F.col("plays")).alias("value"), F.col("season").alias("source")))


@query("D25_availability_by_target", f"""WITH {RECORDS}, s AS (SELECT target, feature, count(DISTINCT actor_id) AS entities, count(value) AS non_null, count(*) AS n, bool_and(source < target) AS safe FROM recs GROUP BY 1, 2),
g AS (SELECT season AS target, feature FROM seasons CROSS JOIN (SELECT unnest(['rate', 'share', 'depth']) AS feature))
SELECT target, feature, coalesce(entities, 0) AS entities, coalesce(non_null, 0) AS non_null, round(coalesce(non_null::DOUBLE / n, 0), 9) AS coverage, coalesce(safe, true) AS as_of_safe,
  CASE WHEN n IS NULL AND target = 1995 THEN 'no_history' WHEN n IS NULL THEN 'not_collected' WHEN non_null < n THEN 'partly_missing' END AS reason FROM g LEFT JOIN s USING (target, feature)""")
def _(t):
    s = records(t).groupBy("target", "feature").agg(F.count_distinct("actor_id").alias("entities"), F.count("value").alias("non_null"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("source") < F.col("target")).alias("safe"))
    g = t.seasons.withColumnRenamed("season", "target").withColumn("feature", F.explode(F.array(F.lit("rate"), F.lit("share"), F.lit("depth"))))
    reason = F.when(F.col("n").isNull() & (F.col("target") == 1995), "no_history").when(F.col("n").isNull(), "not_collected").when(F.col("non_null") < F.col("n"), "partly_missing")
    zero = F.lit(0)
    return g.join(s, ["target", "feature"], "left").select("target", "feature", F.coalesce("entities", zero).alias("entities"), F.coalesce("non_null", zero).alias("non_null"), F.round(F.coalesce(F.col("non_null") / F.col("n"), F.lit(0.0)), 9).alias("coverage"), F.coalesce("safe", F.lit(True)).alias("as_of_safe"), reason.alias("reason"))


@query("D26_missingness_summary", f"WITH {RECORDS} SELECT feature, CASE WHEN value IS NULL THEN 'excluded' ELSE 'present' END AS reason, count(*) AS n, min(target) AS first_target, max(target) AS last_target FROM recs GROUP BY 1, 2")
def _(t):
    reason = F.when(F.col("value").isNull(), "excluded").otherwise("present")
    return records(t).groupBy("feature", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first_target"), F.max("target").alias("last_target"))


ERA = "CASE WHEN season <= 1996 THEN 'early' WHEN season <= 1998 THEN 'middle' ELSE 'late' END"


def era():
    return rates.era(F.col("season"), [(1996, "early"), (1998, "middle")], "late")


@query("D27_play_weighted_coverage", f"""
WITH c AS (SELECT season, count(*) AS eligible, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.season = p.season AND i.team_id = p.team_id AND i.role = 1 AND p.week BETWEEN i.start_week AND i.end_week)) AS attributed FROM plays p GROUP BY 1)
SELECT dimension, grp, CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(attributed) AS BIGINT) AS attributed FROM (
  SELECT 'season' AS dimension, season::VARCHAR AS grp, * FROM c UNION ALL SELECT 'era', {ERA}, * FROM c UNION ALL SELECT 'all', 'all', * FROM c UNION ALL SELECT 'recent', CASE WHEN season >= 1999 THEN 'recent' ELSE 'before' END, * FROM c) GROUP BY 1, 2""")
def _(t):
    cells = t.plays.groupBy("season", "team_id", "week").agg(F.count(F.lit(1)).alias("n"))
    cover = t.intervals.where("role = 1").withColumn("week", F.explode(F.sequence("start_week", "end_week"))).select("season", "team_id", "week").distinct().withColumn("hit", F.lit(1))
    joined = cells.join(cover, ["season", "team_id", "week"], "left")
    dims = {"season": F.col("season"), "era": era(), "all": F.lit("all"), "recent": F.when(F.col("season") >= 1999, "recent").otherwise("before")}
    return aggs.stacked_dimensions(joined, dims, [F.sum("n").alias("eligible"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("attributed")])


@query("D28_additive_reaggregation", "SELECT actor_id, season, CAST(sum(value) AS BIGINT) AS numerator, CAST(sum(volume) AS BIGINT) AS denominator, CAST(sum(value * value) AS BIGINT) AS sum_squares, round(sum(value)::DOUBLE / sum(volume)::DOUBLE, 9) AS rate, sum(volume) >= 2000 AS qualified FROM plays GROUP BY 1, 2")
def _(t):
    stints = t.plays.groupBy("actor_id", "season", "opponent_id").agg(F.sum("value").alias("a"), F.sum("volume").alias("b"), F.sum(F.col("value") * F.col("value")).alias("c"))
    out = stints.groupBy("actor_id", "season").agg(F.sum("a").alias("numerator"), F.sum("b").alias("denominator"), F.sum("c").alias("sum_squares"))
    return out.select("*", F.round(rates.safe_rate(F.col("numerator"), F.col("denominator")), 9).alias("rate"), (F.col("denominator") >= 2000).alias("qualified"))


@query("D29_overlap_diagnostics", "SELECT role, status, shared, count(*) AS n, count(DISTINCT owner_id) AS owners, CAST(sum(end_week - start_week + 1) AS BIGINT) AS weeks FROM intervals GROUP BY 1, 2, 3")
def _(t):
    return t.intervals.groupBy("role", "status", "shared").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("owner_id").alias("owners"), F.sum(F.col("end_week") - F.col("start_week") + 1).alias("weeks"))


@query("D30_single_owner_share", """
WITH g AS (SELECT role, season, team_id, count(DISTINCT owner_id) AS n FROM intervals GROUP BY 1, 2, 3)
SELECT role, count(*) AS groups, (count(*) FILTER (WHERE n = 1))::DOUBLE / count(*) AS single_share, (count(*) FILTER (WHERE n = 1))::DOUBLE / count(*) >= 0.9 AS confounded FROM g GROUP BY 1""")
def _(t):
    return aggs.single_owner_share(t.intervals, ["role"], ["season", "team_id"], "owner_id")


@query("D31_repeat_summary", """
WITH st AS (SELECT actor_id, season, opponent_id, CAST(sum(volume) AS BIGINT) AS v FROM plays GROUP BY 1, 2, 3), mo AS (SELECT actor_id, season, arg_max(opponent_id, (v, opponent_id)) AS main FROM st GROUP BY 1, 2),
p AS (SELECT DISTINCT actor_id, season, main FROM actor_seasons JOIN mo USING (actor_id, season) WHERE volume >= 1500), n AS (SELECT actor_id, count(*) AS seasons_n, count(DISTINCT main) AS teams_n FROM p GROUP BY 1),
c AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE a.main <> b.main) AS switches FROM p a JOIN p b ON a.actor_id = b.actor_id AND a.season = b.season + 1)
SELECT count(*) AS actors, count(*) FILTER (WHERE seasons_n >= 2) AS repeated, count(*) FILTER (WHERE teams_n >= 2) AS teams_repeated, count(*) FILTER (WHERE seasons_n = 1) AS one, count(*) FILTER (WHERE seasons_n = 2) AS two, count(*) FILTER (WHERE seasons_n = 3) AS three, count(*) FILTER (WHERE seasons_n >= 4) AS four_up, any_value(pairs) AS pairs, any_value(switches) AS switches FROM n CROSS JOIN c""")
def _(t):
    from pyspark.sql import Window

    stints = t.plays.groupBy("actor_id", "season", "opponent_id").agg(F.sum("volume").alias("v"))
    main = stints.groupBy("actor_id", "season").agg(F.max(F.struct("v", "opponent_id"))["opponent_id"].alias("main"))  # the team that switches are told by
    p = t.actor_seasons.where("volume >= 1500").select("actor_id", "season").distinct().join(main, ["actor_id", "season"])  # qualified seasons: they have gaps
    line = Window.partitionBy("actor_id").orderBy("season")
    step, moved = F.col("season") - F.lag("season").over(line), F.col("main") != F.lag("main").over(line)
    n = p.withColumn("next", step).withColumn("moved", moved).groupBy("actor_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("main").alias("teams"), F.count_if(F.col("next") == 1).alias("pairs"), F.count_if((F.col("next") == 1) & F.col("moved")).alias("switches"))
    count = lambda c: F.count_if(c)
    return n.agg(F.count(F.lit(1)).alias("actors"), count(F.col("n") >= 2).alias("repeated"), count(F.col("teams") >= 2).alias("teams_repeated"), count(F.col("n") == 1).alias("one"), count(F.col("n") == 2).alias("two"), count(F.col("n") == 3).alias("three"), count(F.col("n") >= 4).alias("four_up"), F.sum("pairs").alias("pairs"), F.sum("switches").alias("switches"))


@query("D32_filtered_record_view", f"""WITH {SIDES} SELECT season, team, count(*) FILTER (WHERE own > other AND game_type = 'REG') AS wins, count(*) FILTER (WHERE own < other AND game_type = 'REG') AS losses, CAST(coalesce(sum(own) FILTER (WHERE game_type = 'REG'), 0) AS BIGINT) AS points, count(*) FILTER (WHERE game_type = 'POST') AS playoff_games, count(*) FILTER (WHERE game_type = 'POST' AND own > other) AS playoff_wins FROM sides GROUP BY 1, 2""")
def _(t):
    return t.spark.sql("""SELECT season, team, count(*) FILTER (WHERE own > other AND game_type = 'REG') AS wins, count(*) FILTER (WHERE own < other AND game_type = 'REG') AS losses,
      coalesce(sum(own) FILTER (WHERE game_type = 'REG'), 0) AS points, count(*) FILTER (WHERE game_type = 'POST') AS playoff_games, count(*) FILTER (WHERE game_type = 'POST' AND own > other) AS playoff_wins FROM {rows} GROUP BY season, team""", rows=sides(t))


@query("D33_queue_summary", "SELECT status, role, shared, count(*) AS n FROM intervals WHERE status <> 'verified' GROUP BY 1, 2, 3")
def _(t):
    return t.intervals.where("status <> 'verified'").groupBy("status", "role", "shared").agg(F.count(F.lit(1)).alias("n"))


@query("D34_denominator_table", """
SELECT 'attempts' AS name, count(*) FILTER (WHERE attempt) AS numerator, count(*) AS denominator, (count(*) FILTER (WHERE attempt))::DOUBLE / count(*) AS rate FROM plays
UNION ALL SELECT 'verified', count(*) FILTER (WHERE status = 'verified'), count(*), (count(*) FILTER (WHERE status = 'verified'))::DOUBLE / count(*) FROM intervals
UNION ALL SELECT 'playoff', count(*) FILTER (WHERE game_type = 'POST'), count(*), (count(*) FILTER (WHERE game_type = 'POST'))::DOUBLE / count(*) FROM games""")
def _(t):
    row = lambda df, n, c: df.agg(F.count_if(c).alias("numerator"), F.count(F.lit(1)).alias("denominator")).select(F.lit(n).alias("name"), "numerator", "denominator", rates.safe_rate(F.col("numerator"), F.col("denominator")).alias("rate"))
    return row(t.plays, "attempts", F.col("attempt")).unionByName(row(t.intervals, "verified", F.col("status") == "verified")).unionByName(row(t.games, "playoff", F.col("game_type") == "POST"))


@query("D37_season_completeness", "SELECT season, count(*) AS cells, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'unresolved') AS unresolved, (count(*) FILTER (WHERE status = 'verified'))::DOUBLE / count(*) AS verified_rate FROM intervals GROUP BY 1")
def _(t):
    return t.intervals.groupBy("season").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "unresolved").alias("unresolved"), (F.count_if(F.col("status") == "verified") / F.count(F.lit(1))).alias("verified_rate"))


@query("D38_missingness_by_dimension", f"""
SELECT dimension, grp, count(*) AS cells, count(*) FILTER (WHERE status = 'verified') AS verified, (count(*) FILTER (WHERE status = 'verified'))::DOUBLE / count(*) AS rate FROM (
  SELECT 'role' AS dimension, role::VARCHAR AS grp, status FROM intervals UNION ALL SELECT 'era', {ERA}, status FROM intervals UNION ALL SELECT 'team', team_id::VARCHAR, status FROM intervals) GROUP BY 1, 2""")
def _(t):
    v = F.count_if(F.col("status") == "verified")
    return aggs.stacked_dimensions(t.intervals, {"role": F.col("role"), "era": era(), "team": F.col("team_id")}, [F.count(F.lit(1)).alias("cells"), v.alias("verified"), (v / F.count(F.lit(1))).alias("rate")])
