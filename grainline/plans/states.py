"""Preseason features, actor states, cohorts and tables that bring signals together (family J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rates
from ..operators import intervals, joins, reshape
from ..sources.shared import cut
from . import aggs as bound
from .domain import ATTR, PLACE, SPAN, assigned, cells, lines, of_intervals, owner_weeks, span_exposures
from .projection import PROJ, projections
from .registry import query
from .reliability import _MAIN
from .stats import COH, coh

C = F.col
N = lambda: F.count(F.lit(1))
R = lambda c, n=6: F.round(C(c), n).alias(c)

#: The bound registry: birth and debut of each actor.
BIRTH = "make_date(CAST(1965 + actor_id % 15 AS INT), CAST(1 + actor_id % 12 AS INT), 1)"
AGE = "round(date_diff('day', make_date(CAST(1965 + {a} % 15 AS BIGINT), CAST(1 + {a} % 12 AS BIGINT), 1), make_date(CAST({s} AS BIGINT), 9, 1)) / 365.2425, 4)"
_MN = _MAIN.split(", ch AS")[0].replace("st AS (", "stint AS (").replace("FROM st ", "FROM stint ")


def age(season="season"):
    return F.round(rates.age_at(C(season), F.expr(BIRTH)), 4)


def main_opponent(t):
    """actor_id, season, main: the opponent with most of the actor's volume; the team that moves are told by."""
    stints = t.plays.groupBy("actor_id", "season", "opponent_id").agg(F.sum("volume").alias("v"))
    return stints.groupBy("actor_id", "season").agg(F.max(F.struct("v", "opponent_id"))["opponent_id"].alias("main"))


_FLAGS = {"prior": "prior_plays", "prior_rate": "prior_rate", "before": "before_plays", "career": "career_plays", "injury": "listed_weeks", "out": "out_weeks", "team": "prior_main", "change": "changed", "share": "prior_share", "age": "age"}


@query("J01_preseason_features", f"""WITH {_MN}, inj AS (SELECT actor_id, season, count(DISTINCT week) AS listed, count(DISTINCT CASE WHEN tax = 0 THEN week END) AS out_weeks FROM plays WHERE discount >= 8 GROUP BY 1, 2),
h AS (SELECT a.actor_id, a.season, CAST(sum(b.plays) AS BIGINT) AS career_plays, CAST(sum(b.value) AS BIGINT) AS career_value, count(b.season) AS experience FROM actor_seasons a LEFT JOIN actor_seasons b ON a.actor_id = b.actor_id AND b.season < a.season GROUP BY 1, 2),
x AS (SELECT a.actor_id, a.team_id, a.season, p.plays AS prior_plays, p.value AS prior_value, CASE WHEN p.volume >= 1500 THEN round(p.value::DOUBLE / p.volume, 8) END AS prior_rate, round(p.attempts::DOUBLE / p.plays, 8) AS prior_share, q.plays AS before_plays, career_plays, career_value, experience, listed AS listed_weeks, inj.out_weeks, m1.main AS prior_main, m1.main <> m2.main AS changed, {AGE.format(a='a.actor_id', s='a.season')} AS age
  FROM actor_seasons a JOIN h USING (actor_id, season) LEFT JOIN actor_seasons p ON p.actor_id = a.actor_id AND p.season = a.season - 1 LEFT JOIN actor_seasons q ON q.actor_id = a.actor_id AND q.season = a.season - 2 LEFT JOIN inj ON inj.actor_id = a.actor_id AND inj.season = a.season - 1 LEFT JOIN mn m1 ON m1.actor_id = a.actor_id AND m1.season = a.season - 1 LEFT JOIN mn m2 ON m2.actor_id = a.actor_id AND m2.season = a.season - 2)
SELECT *, {', '.join(f'{c} IS NULL AS missing_{n}' for n, c in _FLAGS.items())}, CASE WHEN experience = 0 THEN 'new' WHEN experience <= 2 THEN 'early' ELSE 'established' END AS experience_group, CASE WHEN age < 24 THEN 'young' WHEN age < 30 THEN 'prime' ELSE 'old' END AS age_group FROM x""")
def _(t):
    a = t.actor_seasons.select("actor_id", "team_id", "season", "plays", "value", "volume", F.when(C("volume") >= 1500, F.round(C("value") / C("volume"), 8)).alias("rate"), F.round(C("attempts") / C("plays"), 8).alias("share"), F.lit(1).alias("one"))
    injuries = t.plays.where("discount >= 8").groupBy("actor_id", (C("season") + 1).alias("season")).agg(F.count_distinct("week").alias("listed_weeks"), F.count_distinct(F.when(C("tax") == 0, C("week"))).alias("out_weeks"))
    main = cut(main_opponent(t), "main")
    moved = main.select("actor_id", (C("season") + 1).alias("season"), C("main").alias("prior_main")).join(main.select("actor_id", (C("season") + 2).alias("season"), C("main").alias("before_main")), ["actor_id", "season"], "left")
    out = joins.lag_join(joins.lag_join(a, ["actor_id"], "season", ["plays", "value", "rate", "share"]), ["actor_id"], "season", ["plays"], by=2, prefix="before_")
    out = joins.as_of_totals(out, ["actor_id"], "season", ["plays", "value", "one"]).join(injuries, ["actor_id", "season"], "left").join(moved, ["actor_id", "season"], "left")
    n, own = F.coalesce("career_one", F.lit(0)), age()
    x = out.select("actor_id", "team_id", "season", "prior_plays", "prior_value", "prior_rate", "prior_share", "before_plays", "career_plays", "career_value", n.alias("experience"), "listed_weeks", "out_weeks", "prior_main", (C("prior_main") != C("before_main")).alias("changed"), own.alias("age"))
    return x.select("*", *(C(c).isNull().alias(f"missing_{k}") for k, c in _FLAGS.items()), F.when(C("experience") == 0, "new").when(C("experience") <= 2, "early").otherwise("established").alias("experience_group"), F.when(C("age") < 24, "young").when(C("age") < 30, "prime").otherwise("old").alias("age_group"))


_EXPECT = "ex AS (SELECT actor_id, season, y, p FROM pj WHERE outcome = 'y' AND model = 'level')"


def expectations(t):
    """actor_id, season, y, p: the out-of-sample expectation of each actor's season."""
    return projections(t).where("outcome = 'y' AND model = 'level'").select("actor_id", "season", "y", "p")


@query("J02_coach_exposures", f"""WITH {PROJ}, {_EXPECT}, {ATTR}, x AS (SELECT interval_id, j.actor_id, season, sum(n::DOUBLE / k) AS e, sum(v::DOUBLE / k) AS v, sum(vol::DOUBLE / k) AS vol FROM j GROUP BY 1, 2, 3),
lap AS (SELECT a.interval_id AS a_id, b.interval_id AS b_id, a.shared AND b.shared AS both_shared FROM intervals a JOIN intervals b ON a.season = b.season AND a.team_id = b.team_id AND a.role = 1 AND b.role = 1 AND a.interval_id < b.interval_id AND a.start_week <= b.end_week AND b.start_week <= a.end_week)
SELECT interval_id, CASE WHEN interval_id NOT IN (SELECT unnest([a_id, b_id]) FROM lap) THEN 'none' WHEN interval_id IN (SELECT unnest([a_id, b_id]) FROM lap WHERE NOT both_shared) THEN 'illegal' ELSE 'shared' END AS overlap, x.actor_id, round(e, 6) AS exposure, round(v, 3) AS value, round(p * vol, 1) AS expected, round(v - p * vol, 1) AS over_expected, CASE WHEN p IS NULL THEN 'no_expectation' WHEN e < 25 THEN 'below_minimum' END AS exclusion FROM x LEFT JOIN ex ON ex.actor_id = x.actor_id AND ex.season = x.season""")
def _(t):
    i = assigned(t)
    own = joins.checked_join(lines(cells(t, "actor_id"), i), expectations(t).drop("y"), ["actor_id", "season"], "left", "m:1")
    want = C("p") * C("vol")
    # what overlaps another owner's interval: legal where both are shared
    others = intervals.overlap_counts(i, PLACE, *SPAN, {"n": F.lit(1), "own": (~C("shared")).cast("int")})
    legal = others.withColumn("overlap", F.when(C("over_n") == 1, "none").when(C("shared") & (C("over_own") == 0), "shared").otherwise("illegal"))
    out = span_exposures(own, i).select(*PLACE, *SPAN, "actor_id", F.round("e", 6).alias("exposure"), F.round("v", 3).alias("value"), F.round(want, 1).alias("expected"), F.round(C("v") - want, 1).alias("over_expected"), F.when(C("p").isNull(), "no_expectation").when(C("e") < 25, "below_minimum").alias("exclusion"))
    return of_intervals(out, legal, "interval_id", "overlap").select("interval_id", "overlap", "actor_id", "exposure", "value", "expected", "over_expected", "exclusion")


@query("J06_inherited_environment", f"""WITH {bound.SIDES}, o AS (SELECT season, team, sum(other)::DOUBLE / count(*) AS allowed FROM sides GROUP BY 1, 2), q AS (SELECT season, team_id AS team, sum(value)::DOUBLE / sum(volume) AS quality, CAST(sum(plays) AS BIGINT) AS plays FROM actor_seasons WHERE plays >= 20 GROUP BY 1, 2),
f AS (SELECT season, opponent_id AS team, avg(value) AS conceded FROM plays GROUP BY 1, 2), sc AS (SELECT p.season, p.team_id AS team, avg(conceded) AS schedule FROM plays p JOIN f ON f.season = p.season AND f.team = p.opponent_id GROUP BY 1, 2), pr AS (SELECT season, team_id AS team, (count(*) FILTER (WHERE attempt AND value < -20000))::DOUBLE / nullif(count(*) FILTER (WHERE attempt), 0) AS losses FROM plays GROUP BY 1, 2), g AS (SELECT season, n_nationkey AS team FROM seasons CROSS JOIN nation)
SELECT g.season, g.team, coalesce(q.plays, 0) AS prior_plays, round(quality, 5) AS roster_quality, round(allowed, 6) AS prior_allowed, round(schedule, 4) AS schedule_strength, round(losses, 8) AS protection_losses, q.plays IS NULL AS no_prior FROM g
LEFT JOIN q ON q.team = g.team AND q.season = g.season - 1 LEFT JOIN o ON o.team = g.team AND o.season = g.season - 1 LEFT JOIN sc ON sc.team = g.team AND sc.season = g.season - 1 LEFT JOIN pr ON pr.team = g.team AND pr.season = g.season - 1""")
def _(t):
    k = ["season", "team"]
    allowed = bound.sides(t).groupBy(*k).agg((F.sum("other") / N()).alias("allowed"))
    q = t.actor_seasons.where("plays >= 20").groupBy("season", C("team_id").alias("team")).agg((F.sum("value") / F.sum("volume")).alias("quality"), F.sum("plays").alias("prior_plays"))
    # teams' meetings are counted before the opponents' values are joined: a row a pair of teams and season
    met = t.plays.groupBy("season", C("team_id").alias("team"), "opponent_id").agg(N().alias("n"), F.sum("value").alias("v"), F.count_if(C("attempt") & (C("value") < -20000)).alias("lost"), F.count_if("attempt").alias("tries"))
    met = cut(met, "meetings")
    conceded = met.groupBy("season", "opponent_id").agg((F.sum("v") / F.sum("n")).alias("conceded"))
    own = met.join(conceded, ["season", "opponent_id"]).groupBy(*k).agg((F.sum(C("n") * C("conceded")) / F.sum("n")).alias("schedule"), rates.safe_rate(F.sum("lost"), F.sum("tries")).alias("losses"))
    before = q.join(allowed, k, "full").join(own, k, "full").withColumn("season", C("season") + 1)
    grid = t.seasons.crossJoin(F.broadcast(t.raw("nation").select(C("n_nationkey").alias("team"))))
    out = grid.join(before, k, "left")
    return out.select("season", "team", F.coalesce("prior_plays", F.lit(0)).alias("prior_plays"), F.round("quality", 5).alias("roster_quality"), F.round("allowed", 6).alias("prior_allowed"), F.round("schedule", 4).alias("schedule_strength"), F.round("losses", 8).alias("protection_losses"), C("prior_plays").isNull().alias("no_prior"))


PAE = f"""{PROJ}, {_EXPECT}, mdl AS (SELECT s.season, avg((e.y - e.p) * (e.y - e.p)) AS model_var FROM seasons s JOIN ex e ON e.season < s.season GROUP BY 1),
sv AS (SELECT actor_id, season, count(*) AS n, CAST(sum(value) AS BIGINT) AS v, CAST(sum(value * value) AS BIGINT) AS vv, CAST(sum(volume) AS BIGINT) AS vol FROM plays GROUP BY 1, 2),
pae AS (SELECT ex.actor_id, ex.season, ex.y AS actual, ex.p AS expected, ex.y - ex.p AS pae, vol AS weight, CASE WHEN n > 1 THEN (vv - v::DOUBLE * v / n) / (n - 1) * n / (vol::DOUBLE * vol) END AS sampling_var, model_var FROM ex JOIN sv USING (actor_id, season) LEFT JOIN mdl USING (season))"""


def season_pae(t):
    """Actual less expected of every actor's season, with the sampling variance of the actual and the model's, from earlier seasons."""
    e = cut(expectations(t), "expectations")
    per = e.groupBy("season").agg(F.sum((C("y") - C("p")) * (C("y") - C("p"))).alias("q"), N().alias("k"))
    w = Window.orderBy("season").rangeBetween(Window.unboundedPreceding, -1)  # a row a season
    model = t.seasons.join(per, "season", "left").select("season", (F.sum("q").over(w) / F.sum("k").over(w)).alias("model_var"))
    s = t.actor_totals.groupBy("actor_id", "season").agg(F.sum("plays").alias("n"), F.sum("value").alias("v"), F.sum("squares").alias("vv"), F.sum("volume").alias("vol"))
    var = F.when(C("n") > 1, (C("vv") - C("v").cast("double") * C("v") / C("n")) / (C("n") - 1) * C("n") / (C("vol").cast("double") * C("vol")))
    return e.join(s, ["actor_id", "season"]).join(F.broadcast(model), "season", "left").select("actor_id", "season", C("y").alias("actual"), C("p").alias("expected"), (C("y") - C("p")).alias("pae"), C("vol").alias("weight"), var.alias("sampling_var"), "model_var")


@query("J14_season_pae", f"WITH {PAE} SELECT actor_id, season, round(actual, 4) AS actual, round(expected, 3) AS expected, round(pae, 3) AS pae, weight, round(sampling_var, 1) AS sampling_var, round(model_var, 1) AS model_var, round(sampling_var + model_var, 1) AS total_var FROM pae")
def _(t):
    return season_pae(t).select("actor_id", "season", R("actual", 4), R("expected", 3), R("pae", 3), "weight", R("sampling_var", 1), R("model_var", 1), F.round(C("sampling_var") + C("model_var"), 1).alias("total_var"))


_LATE = "FILTER (WHERE b.season >= a.season - 2)"
STATES = f"""{PAE}, st0 AS (SELECT a.actor_id, a.season, any_value(a.y) AS recent, any_value(a.w) AS recent_w, sum(b.y * b.w) / sum(b.w) AS career, CAST(sum(b.w) AS BIGINT) AS career_w, count(*) AS seasons_n, count(*) {_LATE} AS k, sum(b.w) {_LATE}::DOUBLE AS w, sum(b.w * (b.season - a.season)) {_LATE}::DOUBLE AS wx, sum(b.w * b.y) {_LATE} AS wy, sum(b.w * (b.season - a.season) * (b.season - a.season)) {_LATE}::DOUBLE AS wxx, sum(b.w * (b.season - a.season) * b.y) {_LATE} AS wxy, stddev_pop(b.y) {_LATE} AS spread
  FROM coh a JOIN coh b ON a.actor_id = b.actor_id AND b.season <= a.season GROUP BY 1, 2),
st AS (SELECT st0.*, st0.season + 1 AS target, CASE WHEN k >= 2 THEN (wxy / w - wx / w * wy / w) / (wxx / w - wx / w * wx / w) END AS trend, CASE WHEN k >= 2 THEN spread END AS stability, pae.pae, pae.weight AS pae_w FROM st0 LEFT JOIN pae USING (actor_id, season))"""


def states(t):
    """actor_id, season (the last one known), target (the next), and what is known by then: recent, career, trend and stability of the
    last three seasons, and the performance above expectation."""
    c = coh(t).select("actor_id", "season", "y", "w")
    every = Window.partitionBy("actor_id").orderBy("season").rangeBetween(Window.unboundedPreceding, 0)
    late = Window.partitionBy("actor_id").orderBy("season").rangeBetween(-2, 0)
    x, y, w = C("season") - 1998, C("y"), C("w")  # slopes do not change with the origin
    s = c.select("actor_id", "season", y.alias("recent"), w.alias("recent_w"), (F.sum(y * w).over(every) / F.sum(w).over(every)).alias("career"), F.sum(w).over(every).alias("career_w"), N().over(every).alias("seasons_n"), N().over(late).alias("k"), F.sum(w).over(late).alias("w"), F.sum(w * x).over(late).alias("wx"), F.sum(w * y).over(late).alias("wy"), F.sum(w * x * x).over(late).alias("wxx"), F.sum(w * x * y).over(late).alias("wxy"), F.stddev_pop(y).over(late).alias("spread"))
    enough, m = C("k") >= 2, lambda n: C(n) / C("w")
    trend = F.when(enough, (m("wxy") - m("wx") * m("wy")) / (m("wxx") - m("wx") * m("wx")))
    own = season_pae(t).select("actor_id", "season", "pae", C("weight").alias("pae_w"))
    return s.join(own, ["actor_id", "season"], "left").select("actor_id", "season", (C("season") + 1).alias("target"), "recent", "recent_w", "career", "career_w", "seasons_n", trend.alias("trend"), F.when(enough, C("spread")).alias("stability"), "pae", "pae_w")


@query("J15_state_features", f"""WITH {STATES}, lg AS (SELECT target, avg(pae) AS pae_mean, avg(career) AS career_mean FROM st GROUP BY 1)
SELECT actor_id, target, round(recent, 5) AS recent, round(career, 5) AS career, round(career_mean + career_w / (career_w + 500::DOUBLE) * (career - career_mean), 4) AS career_shrunk, round(trend, 3) AS trend, round(stability, 3) AS stability, round(pae, 3) AS pae, round(pae_mean + pae_w / (pae_w + 500::DOUBLE) * (pae - pae_mean), 3) AS pae_shrunk, CASE WHEN trend IS NULL THEN 'too_few_seasons' END AS trend_missing, CASE WHEN pae IS NULL AND seasons_n = 1 THEN 'no_history' WHEN pae IS NULL THEN 'no_expectation' END AS pae_missing FROM st JOIN lg USING (target)""")
def _(t):
    s = cut(states(t), "states")
    league = s.groupBy("target").agg(F.avg("pae").alias("pae_mean"), F.avg("career").alias("career_mean"))
    pull = lambda v, w: C(f"{v}_mean") + C(w) / (C(w) + 500.0) * (C(v) - C(f"{v}_mean"))
    return s.join(F.broadcast(league), "target").select("actor_id", "target", R("recent", 5), R("career", 5), F.round(pull("career", "career_w"), 4).alias("career_shrunk"), R("trend", 3), R("stability", 3), R("pae", 3), F.round(pull("pae", "pae_w"), 3).alias("pae_shrunk"), F.when(C("trend").isNull(), "too_few_seasons").alias("trend_missing"), F.when(C("pae").isNull() & (C("seasons_n") == 1), "no_history").when(C("pae").isNull(), "no_expectation").alias("pae_missing"))


_PARTS = ["recent", "career", "trend", "stability", "pae"]


@query("J16_player_states", f"""WITH {STATES} SELECT actor_id, target, seasons_n, career_w AS exposure, season AS last_season, {AGE.format(a='actor_id', s='target')} AS age, round(({' + '.join(f'({c} IS NOT NULL)::INT' for c in _PARTS)}) / 5.0::DOUBLE, 6) AS completeness, CASE WHEN career_w >= 6000 AND trend IS NOT NULL THEN 'established' WHEN seasons_n >= 2 THEN 'developing' ELSE 'new' END AS status FROM st""")
def _(t):
    have = sum((C(c).isNotNull().cast("int") for c in _PARTS), F.lit(0))
    status = F.when((C("career_w") >= 6000) & C("trend").isNotNull(), "established").when(C("seasons_n") >= 2, "developing").otherwise("new")
    return states(t).select("actor_id", "target", "seasons_n", C("career_w").alias("exposure"), C("season").alias("last_season"), age("target").alias("age"), F.round(have / 5.0, 6).alias("completeness"), status.alias("status"))


@query("J24_forward_candidates", f"WITH {STATES}, la AS (SELECT max(season) AS last FROM st) SELECT actor_id, target, recent_w AS last_volume, seasons_n, round(recent, 5) AS recent, round(career, 5) AS career, round(trend, 3) AS trend, round(stability, 3) AS stability, round(pae, 3) AS pae, {AGE.format(a='actor_id', s='target')} AS age FROM st JOIN la ON season = last WHERE recent_w >= 800")
def _(t):
    last = t.seasons.agg(F.max("season").alias("season"))
    # those qualified in the last season, with the state that is known for the next one
    return states(t).join(F.broadcast(last), "season").where("recent_w >= 800").select("actor_id", "target", C("recent_w").alias("last_volume"), "seasons_n", R("recent", 5), R("career", 5), R("trend", 3), R("stability", 3), R("pae", 3), age("target").alias("age"))


@query("J22_predictors", f"""WITH {STATES}, {bound.RECORDS}, wide AS (SELECT actor_id, target, max(value) FILTER (WHERE feature = 'rate') AS rate, max(value) FILTER (WHERE feature = 'share') AS share, count(value) AS features_n FROM recs GROUP BY 1, 2), lg AS (SELECT s.season, sum(y * w) / sum(w) AS league FROM (SELECT DISTINCT target AS season FROM st) s JOIN coh c ON c.season < s.season GROUP BY 1)
SELECT st.actor_id, st.target, round(recent, 5) AS recent, round(career, 5) AS career, round(trend, 3) AS trend, round(rate, 8) AS rate, round(share, 8) AS share, round(ln(1 + seasons_n), 8) AS log_seasons, round(ln(1 + career_w), 8) AS log_volume, round(ln(1 + coalesce(features_n, 0)), 8) AS log_features, round(league, 4) AS league_baseline FROM st LEFT JOIN wide USING (actor_id, target) JOIN lg ON lg.season = st.target""")
def _(t):
    s = states(t)
    r = bound.records(t)
    wide = reshape.pivot_wide(r, ["actor_id", "target"], "feature", {"value": "value"}, ["rate", "share"]).join(r.groupBy("actor_id", "target").agg(F.count("value").alias("features_n")), ["actor_id", "target"])
    per = coh(t).groupBy("season").agg(F.sum(C("y") * C("w")).alias("v"), F.sum("w").alias("w"))
    w = Window.orderBy("season").rangeBetween(Window.unboundedPreceding, 0)  # a row a season
    league = per.select((C("season") + 1).alias("target"), (F.sum("v").over(w) / F.sum("w").over(w)).alias("league"))
    out = s.join(wide, ["actor_id", "target"], "left").join(F.broadcast(league), "target")
    return out.select("actor_id", "target", R("recent", 5), R("career", 5), R("trend", 3), R("rate", 8), R("share", 8), F.round(F.log1p("seasons_n"), 8).alias("log_seasons"), F.round(F.log1p("career_w"), 8).alias("log_volume"), F.round(F.log1p(F.coalesce("features_n", F.lit(0))), 8).alias("log_features"), F.round("league", 4).alias("league_baseline"))


COHORT_ALL = f"""{STATES}, {_MN}, mc AS (SELECT a.actor_id, a.season, a.team_id, a.value::DOUBLE / a.volume AS outcome, a.volume, s.recent, s.career, s.trend, s.seasons_n, p.attempts::DOUBLE / p.plays AS prior_share, ts.attempts::DOUBLE / ts.plays AS team_share, ts.value::DOUBLE / ts.volume AS team_value, ts.successes::DOUBLE / ts.plays AS scheme, t2.successes::DOUBLE / t2.plays AS prior_scheme, m1.main <> m2.main AS changed, CAST(1995 + a.actor_id % 7 AS INT) = a.season AS debut
  FROM actor_seasons a LEFT JOIN st s ON s.actor_id = a.actor_id AND s.target = a.season LEFT JOIN actor_seasons p ON p.actor_id = a.actor_id AND p.season = a.season - 1 LEFT JOIN team_seasons ts ON ts.team_id = a.team_id AND ts.season = a.season - 1 LEFT JOIN team_seasons t2 ON t2.team_id = a.team_id AND t2.season = a.season - 2 LEFT JOIN mn m1 ON m1.actor_id = a.actor_id AND m1.season = a.season LEFT JOIN mn m2 ON m2.actor_id = a.actor_id AND m2.season = a.season - 1)"""


def modeling_cohort(t):
    """A row an actor's season: its outcome, the state before it, the team's and the scheme's prior seasons, and moves."""
    a = t.actor_seasons.select("actor_id", "season", "team_id", (C("value") / C("volume")).alias("outcome"), "volume")
    s = states(t).select("actor_id", C("target").alias("season"), "recent", "career", "trend", "seasons_n")
    p = t.actor_seasons.select("actor_id", (C("season") + 1).alias("season"), (C("attempts") / C("plays")).alias("prior_share"))
    ts = t.team_seasons.select("team_id", (C("season") + 1).alias("season"), (C("attempts") / C("plays")).alias("team_share"), (C("value") / C("volume")).alias("team_value"), (C("successes") / C("plays")).alias("scheme"))
    t2 = ts.select("team_id", (C("season") + 1).alias("season"), C("scheme").alias("prior_scheme"))
    main = cut(main_opponent(t), "main")
    moved = joins.lag_join(main, ["actor_id"], "season", ["main"]).select("actor_id", "season", (C("main") != C("prior_main")).alias("changed"))
    out = joins.checked_join(joins.checked_join(a, s, ["actor_id", "season"], "left", "m:1", check=False), p, ["actor_id", "season"], "left", "m:1", check=False)  # keys of groupings
    out = out.join(ts, ["team_id", "season"], "left").join(t2, ["team_id", "season"], "left").join(moved, ["actor_id", "season"], "left")
    return out.withColumn("debut", (1995 + C("actor_id") % 7).cast("int") == C("season"))


@query("J19_modeling_cohort", f"""WITH {COHORT_ALL} SELECT actor_id, season, team_id, round(outcome, 6) AS outcome, round(recent, 5) AS recent, round(career, 5) AS career, round(trend, 3) AS trend, round(team_value, 6) AS team_value, round(scheme, 9) AS scheme, round(prior_scheme, 9) AS prior_scheme, round(prior_share * team_share, 9) AS share_by_team, round(recent * scheme, 5) AS recent_by_scheme, round(scheme - prior_scheme, 9) AS scheme_change, round(team_share - prior_share, 9) AS share_change, changed,
  recent IS NOT NULL AS has_state, team_share IS NOT NULL AS has_team, volume >= 1500 AS has_outcome, recent IS NOT NULL AND team_share IS NOT NULL AND volume >= 1500 AS eligible FROM mc""")
def _(t):
    c = reshape.interactions(modeling_cohort(t), {"share_by_team": ("prior_share", "team_share"), "recent_by_scheme": ("recent", "scheme")})
    state, team, outcome = C("recent").isNotNull(), C("team_share").isNotNull(), C("volume") >= 1500
    return c.select("actor_id", "season", "team_id", R("outcome"), R("recent", 5), R("career", 5), R("trend", 3), R("team_value"), R("scheme", 9), R("prior_scheme", 9), R("share_by_team", 9), R("recent_by_scheme", 5), F.round(C("scheme") - C("prior_scheme"), 9).alias("scheme_change"), F.round(C("team_share") - C("prior_share"), 9).alias("share_change"), "changed", state.alias("has_state"), team.alias("has_team"), outcome.alias("has_outcome"), (state & team & outcome).alias("eligible"))


_CATEGORY = "CASE WHEN debut AND recent IS NULL THEN 'rookie' WHEN recent IS NULL THEN 'new' WHEN changed THEN 'changer' ELSE 'returning' END"


@query("J20_target_coverage", f"""WITH {COHORT_ALL}, x AS (SELECT *, {_CATEGORY} AS category, recent IS NOT NULL AND team_share IS NOT NULL AS covered FROM mc), d AS (SELECT 'season' AS dimension, season::VARCHAR AS grp, covered FROM x UNION ALL SELECT 'category', category, covered FROM x UNION ALL SELECT 'season_category', season || '|' || category, covered FROM x
  UNION ALL SELECT 'source', 'state', recent IS NOT NULL FROM x UNION ALL SELECT 'source', 'team', team_share IS NOT NULL FROM x UNION ALL SELECT 'source', 'scheme', prior_scheme IS NOT NULL FROM x UNION ALL SELECT 'source', 'trend', trend IS NOT NULL FROM x)
SELECT dimension, grp, count(*) AS n, count(*) FILTER (WHERE covered) AS covered, round((count(*) FILTER (WHERE covered))::DOUBLE / count(*), 9) AS coverage FROM d GROUP BY 1, 2""")
def _(t):
    category = F.expr(_CATEGORY)
    x = modeling_cohort(t).withColumn("category", category).withColumn("covered", C("recent").isNotNull() & C("team_share").isNotNull())
    tag = lambda d, g, ok: F.struct(F.lit(d).alias("dimension"), g.alias("grp"), ok.alias("ok"))
    season = C("season").cast("string")
    tags = [tag("season", season, C("covered")), tag("category", C("category"), C("covered")), tag("season_category", F.concat_ws("|", season, "category"), C("covered"))]
    tags += [tag("source", F.lit(n), C(c).isNotNull()) for n, c in (("state", "recent"), ("team", "team_share"), ("scheme", "prior_scheme"), ("trend", "trend"))]
    rows = x.select(F.explode(F.array(*tags)).alias("t")).select("t.*")
    return rows.groupBy("dimension", "grp").agg(N().alias("n"), F.count_if("ok").alias("covered"), F.round(F.count_if("ok") / N(), 9).alias("coverage"))


@query("J23_scenario_cohort", f"""WITH {COH}, sn AS (SELECT actor_id, season, opponent_id, CAST(sum(value) AS BIGINT) AS v, CAST(sum(volume) AS BIGINT) AS vol FROM plays GROUP BY 1, 2, 3), sb AS (SELECT actor_id, season, list(DISTINCT opponent_id) AS seen FROM plays GROUP BY 1, 2)
SELECT sn.actor_id, sn.season, sn.opponent_id, round(v::DOUBLE / vol - c.y, 3) AS residual, round(ts.attempts::DOUBLE / ts.plays, 9) AS destination_share, round(ts.value::DOUBLE / ts.volume, 6) AS destination_value, coalesce(list_contains(seen, sn.opponent_id), false) AS known, CASE WHEN c.y IS NULL THEN 'no_prior' WHEN ts.plays IS NULL THEN 'no_destination' WHEN vol < 50 THEN 'too_small' END AS exclusion
FROM sn LEFT JOIN coh c ON c.actor_id = sn.actor_id AND c.season = sn.season - 1 LEFT JOIN team_seasons ts ON ts.team_id = sn.opponent_id AND ts.season = sn.season - 1 LEFT JOIN sb ON sb.actor_id = sn.actor_id AND sb.season = sn.season - 1""")
def _(t):
    sn = cut(t.plays.groupBy("actor_id", "season", "opponent_id").agg(F.sum("value").alias("v"), F.sum("volume").alias("vol")), "stints")
    prior = coh(t).select("actor_id", (C("season") + 1).alias("season"), C("y").alias("base"))
    place = t.team_seasons.select(C("team_id").alias("opponent_id"), (C("season") + 1).alias("season"), (C("attempts") / C("plays")).alias("ds"), (C("value") / C("volume")).alias("dv"))
    seen = sn.groupBy("actor_id", (C("season") + 1).alias("season")).agg(F.collect_set("opponent_id").alias("seen"))
    out = sn.join(prior, ["actor_id", "season"], "left").join(place, ["opponent_id", "season"], "left").join(seen, ["actor_id", "season"], "left")
    return out.select("actor_id", "season", "opponent_id", F.round(C("v") / C("vol") - C("base"), 3).alias("residual"), F.round("ds", 9).alias("destination_share"), F.round("dv", 6).alias("destination_value"), reshape.list_contains(C("seen"), C("opponent_id")).alias("known"), F.when(C("base").isNull(), "no_prior").when(C("ds").isNull(), "no_destination").when(C("vol") < 50, "too_small").alias("exclusion"))


@query("J26_research_table", f"""WITH {PAE}, {ATTR}, e AS (SELECT interval_id, owner_id, team_id, season, actor_id, sum(n::DOUBLE / k) AS exposure, sum(v::DOUBLE / k) AS value FROM j GROUP BY ALL), mv AS (SELECT team_id, season, avg(value) FILTER (WHERE attempt) - avg(value) FILTER (WHERE NOT attempt) AS call_value FROM plays GROUP BY 1, 2)
SELECT interval_id, owner_id, e.actor_id, round(exposure, 6) AS exposure, round(e.value, 3) AS value, round(c.y - b.y, 5) AS movement, round(pae, 3) AS pae, round(ts.value::DOUBLE / ts.volume, 6) AS environment_value, round(ts.attempts::DOUBLE / ts.plays, 9) AS environment_share, round(call_value, 5) AS call_value
FROM e JOIN coh c ON c.actor_id = e.actor_id AND c.season = e.season LEFT JOIN coh b ON b.actor_id = e.actor_id AND b.season = e.season - 1 LEFT JOIN pae ON pae.actor_id = e.actor_id AND pae.season = e.season LEFT JOIN team_seasons ts ON ts.team_id = e.team_id AND ts.season = e.season - 1 JOIN mv ON mv.team_id = e.team_id AND mv.season = e.season""")
def _(t):
    i = assigned(t)
    move = joins.lag_join(coh(t).select("actor_id", "season", "y"), ["actor_id"], "season", ["y"]).select("actor_id", "season", (C("y") - C("prior_y")).alias("movement"))
    place = t.team_seasons.select("team_id", (C("season") + 1).alias("season"), (C("value") / C("volume")).alias("ev"), (C("attempts") / C("plays")).alias("es"))
    call = t.plays.groupBy("team_id", "season").agg((F.avg(F.when(C("attempt"), C("value"))) - F.avg(F.when(~C("attempt"), C("value")))).alias("call_value"))
    # signals of an actor's and a team's season join a row an actor and season, before spans and intervals
    own = joins.checked_join(lines(cells(t, "actor_id"), i), move, ["actor_id", "season"], cardinality="m:1").join(season_pae(t).select("actor_id", "season", "pae"), ["actor_id", "season"], "left")
    own = joins.checked_join(joins.checked_join(own, place, ["team_id", "season"], "left", "m:1"), call, ["team_id", "season"], cardinality="m:1")
    out = span_exposures(own, i).select(*PLACE, *SPAN, "actor_id", F.round("e", 6).alias("exposure"), F.round("v", 3).alias("value"), R("movement", 5), R("pae", 3), F.round("ev", 6).alias("environment_value"), F.round("es", 9).alias("environment_share"), R("call_value", 5))
    names = ["actor_id", "exposure", "value", "movement", "pae", "environment_value", "environment_share", "call_value"]
    return of_intervals(out, i, "interval_id", "owner_id").select("interval_id", "owner_id", *names)


@query("J28_common_signal_table", f"""WITH {ATTR}, s AS (SELECT owner_id, team_id, season, sum(v::DOUBLE / k) / sum(n::DOUBLE / k) AS q, sum(h::DOUBLE / k) / sum(n::DOUBLE / k) AS p, sum(n::DOUBLE / k) AS exposure FROM j GROUP BY 1, 2, 3),
h AS (SELECT *, count(*) OVER (PARTITION BY owner_id ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM s), la AS (SELECT DISTINCT owner_id, season FROM s)
SELECT h.owner_id, h.team_id, h.season, round(h.q, 5) AS q, round(h.p, 8) AS p, round(h.exposure, 5) AS exposure, history, dense_rank() OVER (ORDER BY h.season) AS fold, round(f.q, 5) AS future_q, round(f.p, 8) AS future_p, b.q IS NOT NULL AS repeats, b.q IS NULL AND la.owner_id IS NOT NULL AS transition
FROM h LEFT JOIN s f ON f.owner_id = h.owner_id AND f.team_id = h.team_id AND f.season = h.season + 1 LEFT JOIN s b ON b.owner_id = h.owner_id AND b.team_id = h.team_id AND b.season = h.season - 1 LEFT JOIN la ON la.owner_id = h.owner_id AND la.season = h.season - 1""")
def _(t):
    k = ["owner_id", "team_id", "season"]
    share = lambda c: F.sum(C(c) * C("c") / C("k"))
    both = cells(t).join(owner_weeks(assigned(t)), [*PLACE, "week"])
    s = cut(both.groupBy(*k).agg((share("v") / share("n")).alias("q"), (share("h") / share("n")).alias("p"), share("n").alias("exposure")), "signals")
    past = Window.partitionBy("owner_id").orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    folds = s.select("season").distinct().withColumn("fold", F.dense_rank().over(Window.orderBy("season")))  # a row a season
    out = s.withColumn("history", N().over(past)).join(F.broadcast(folds), "season")
    out = joins.lag_join(joins.lag_join(out, k[:2], "season", ["q", "p"], by=-1, prefix="future_"), k[:2], "season", ["q"])
    anywhere = s.select("owner_id", (C("season") + 1).alias("season"), F.lit(True).alias("before")).distinct()
    out = out.join(anywhere, ["owner_id", "season"], "left")
    repeats = C("prior_q").isNotNull()
    return out.select(*k, R("q", 5), R("p", 8), R("exposure", 5), "history", "fold", R("future_q", 5), R("future_p", 8), repeats.alias("repeats"), (~repeats & C("before").isNotNull()).alias("transition"))
