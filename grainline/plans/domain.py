"""Queries of family J (domain pipelines): composites of the other families over the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggs, fuzzy, intervals, joins, reshape, stats
from ..operators import windows as win
from ..sources.shared import cut
from . import aggs as bound
from .registry import query

C = F.col
R = lambda c, n=6: F.round(C(c), n).alias(c)
N = lambda: F.count(F.lit(1))


ATTR = """cell AS (SELECT season, team_id, week, actor_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS v, CAST(sum(volume) AS BIGINT) AS vol, count(*) FILTER (WHERE attempt) AS h FROM plays GROUP BY ALL),
j AS (SELECT c.*, i.interval_id, i.owner_id, count(*) OVER (PARTITION BY c.season, c.team_id, c.week, c.actor_id) AS k FROM cell c JOIN intervals i ON c.season = i.season AND c.team_id = i.team_id AND i.role = 1 AND c.week BETWEEN i.start_week AND i.end_week)"""


PLACE, SPAN = ["season", "team_id"], ("start_week", "end_week")


def cells(t, *by):
    """Weekly totals of plays by team and `by`."""
    return t.plays.groupBy("season", "team_id", "week", *by).agg(N().alias("n"), F.sum("value").alias("v"), F.sum("volume").alias("vol"), F.count_if("attempt").alias("h"))


def assigned(t):
    return assigned_of(t.intervals)


def assigned_of(i):
    return i.where("role = 1").select("season", "team_id", "interval_id", "owner_id", "start_week", "end_week", "shared")


def owner_weeks(i):
    """season, team_id, week, owner_id, c (intervals of the owner that hold the week), k (intervals of all owners)."""
    k = intervals.cover_points(i, PLACE, *SPAN, "week")
    return intervals.cover_points(i, [*PLACE, "owner_id"], *SPAN, "week").withColumnRenamed("k", "c").join(k, [*PLACE, "week"])


EXPOSED = ["e", "v", "vol"]


def lines(part, i):
    """season, team_id, actor_id and the running sums of an actor's weeks (of cells): plays, values and volumes, all divided by the number of
    intervals that hold the week."""
    k = intervals.cover_points(i, PLACE, *SPAN, "week")
    own = part.join(F.broadcast(k), [*PLACE, "week"])  # a row a team and week
    return intervals.lines(own.select(*PLACE, "week", "actor_id", *((C(c) / C("k")).alias(n) for c, n in zip(("n", "v", "vol"), EXPOSED))), PLACE, "actor_id", "week", EXPOSED)


def span_exposures(own, i):
    """The columns of own (lines and what is joined to them), start_week, end_week, points, e, v, vol: a row an actor and span of weeks that an interval has."""
    return intervals.span_sums(own, i, PLACE, *SPAN, EXPOSED)


def of_intervals(rows, i, *keep):
    """Rows of spans for each interval of the span, with the columns `keep` of the intervals. Rows are final but for this: they grow with actors times intervals."""
    return intervals.of_spans(rows, i.select(*PLACE, *SPAN, *keep), PLACE, *SPAN)


@query("J03_pressure_and_defence", """
WITH o AS (SELECT season, team_id, avg(attempt::INT) AS rate FROM plays GROUP BY 1, 2), d AS (SELECT season, opponent_id AS team_id, avg(value) AS allowed FROM plays GROUP BY 1, 2)
SELECT season, team_id, round(rate, 8) AS rate, round(allowed, 5) AS allowed, round((rate - avg(rate) OVER w) / stddev_samp(rate) OVER w, 5) AS rate_z, round(-(allowed - avg(allowed) OVER w) / stddev_samp(allowed) OVER w, 5) AS defence_z FROM o JOIN d USING (season, team_id) WINDOW w AS (PARTITION BY season)""")
def _(t):
    o = t.plays.groupBy("season", "team_id").agg(F.avg(C("attempt").cast("int")).alias("rate"))
    d = t.plays.groupBy("season", C("opponent_id").alias("team_id")).agg(F.avg("value").alias("allowed"))
    z = win.zscore(win.zscore(o.join(d, ["season", "team_id"]), ["season"], "rate", "rate_z"), ["season"], "allowed", "az")
    return z.select("season", "team_id", R("rate", 8), R("allowed", 5), R("rate_z", 5), F.round(-C("az"), 5).alias("defence_z"))


@query("J04_opening_roster", "SELECT DISTINCT season, team_id, actor_id, CASE actor_id % 4 WHEN 0 THEN 'WR' WHEN 1 THEN 'TE' WHEN 2 THEN 'RB' END AS grp FROM plays WHERE week = 1 AND actor_id % 4 < 3")
def _(t):
    from ..functions.rates import position_group

    k = C("actor_id") % 4
    code = F.when(k == 0, "wr").when(k == 1, "te1").when(k == 2, "fb").otherwise("qb")
    return t.plays.where("week = 1").select("season", "team_id", "actor_id", position_group(code).alias("grp")).where("grp IS NOT NULL").distinct()


@query("J05_skill_production", """
WITH s AS (SELECT season, CAST(actor_id % 3 AS INT) AS grp, actor_id, value::DOUBLE / 1000 + 6.0::DOUBLE * attempts AS production, plays FROM actor_seasons),
z AS (SELECT *, (production - avg(production) OVER w) / stddev_samp(production) OVER w AS z FROM s WINDOW w AS (PARTITION BY season, grp)) SELECT season, grp, actor_id, round(z, 5) AS z, round(z * plays / (plays + 25), 5) AS shrunk FROM z""")
def _(t):
    s = t.actor_seasons.select("season", (C("actor_id") % 3).cast("int").alias("grp"), "actor_id", (C("value") / 1000 + 6.0 * C("attempts")).alias("production"), "plays")
    z = win.zscore(s, ["season", "grp"], "production")
    return z.select("season", "grp", "actor_id", R("z", 5), F.round(C("z") * C("plays") / (C("plays") + 25), 5).alias("shrunk"))


LONG = """l AS (SELECT team_id, season, unnest(['attempt', 'success']) AS feature, unnest([attempts::DOUBLE / plays, successes::DOUBLE / plays]) AS v FROM team_seasons)"""


def long(t):
    return t.team_seasons.select("team_id", "season", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), (C(c) / C("plays")).alias("v")) for n, c in (("attempt", "attempts"), ("success", "successes"))))).alias("x")).select("team_id", "season", "x.*")


TRAIL = f"""{LONG}, m AS (SELECT a.season, a.feature, avg(b.v) AS m, stddev_pop(b.v) AS s, min(b.season) AS fit_first FROM (SELECT DISTINCT season, feature FROM l) a JOIN l b ON a.feature = b.feature AND b.season BETWEEN a.season - 4 AND a.season GROUP BY 1, 2),
fr AS (SELECT team_id, l.season + 1 AS target, l.feature, l.season AS source, fit_first, round((v - m) / s, 5) AS z FROM l JOIN m ON l.season = m.season AND l.feature = m.feature)"""


def trail(t):
    l = long(t)
    sums = l.groupBy("season", "feature").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(C("v") * C("v")).alias("q"))
    w = Window.partitionBy("feature").orderBy("season").rangeBetween(-4, 0)
    n, s, q = (F.sum(c).over(w) for c in "nsq")
    fit = sums.select("season", "feature", (s / n).alias("m"), F.sqrt(q / n - (s / n) * (s / n)).alias("sd"), F.min("season").over(w).alias("fit_first"))
    return l.join(F.broadcast(fit), ["season", "feature"]).select("team_id", (C("season") + 1).alias("target"), "feature", C("season").alias("source"), "fit_first", F.round((C("v") - C("m")) / C("sd"), 5).alias("z"))


@query("J09_feature_records", f"WITH {TRAIL} SELECT * FROM fr")
def _(t):
    return trail(t)


FEATURES = ("attempt", "success")


def feature_store(records, target: int, names: list[str], known=FEATURES):
    """part ('request' for the target, 'train' for earlier ones), team_id, target and a column a requested feature. A name that isn't known or
    repeats is an error, and so is a record whose source isn't before its target."""
    if not names or len(set(names)) < len(names) or not set(names) <= set(known):
        raise ValueError(f"request some of {known}, each once")
    if not records.where("source >= target").isEmpty():
        raise ValueError("a record's source is not before its target")
    rows = reshape.pivot_wide(records.where(C("target") <= target), ["team_id", "target"], "feature", {"z": "z"}, list(names))
    return rows.select(F.when(C("target") == target, "request").otherwise("train").alias("part"), "team_id", "target", *names)


@query("J10_asof_feature_store", f"WITH {TRAIL} SELECT CASE WHEN target = 2000 THEN 'request' ELSE 'train' END AS part, team_id, target, max(z) FILTER (WHERE feature = 'attempt') AS attempt, max(z) FILTER (WHERE feature = 'success') AS success FROM fr WHERE target <= 2000 AND source < target GROUP BY 1, 2, 3")
def _(t):
    return feature_store(trail(t), 2000, list(FEATURES))


@query("J11_coach_scheme_association", f"WITH {LONG} SELECT interval_id, feature, end_week - start_week + 1 AS weeks, round(v, 9) AS v FROM intervals JOIN l USING (season, team_id)")
def _(t):
    return t.intervals.join(long(t), ["season", "team_id"]).select("interval_id", "feature", (C("end_week") - C("start_week") + 1).alias("weeks"), R("v", 9))


@query("J12_state_universe", """
WITH f AS (SELECT actor_id, min(season) AS first FROM actor_seasons GROUP BY 1), e AS (SELECT s_suppkey AS actor_id, CAST(1995 + s_suppkey % 7 AS INT) AS drafted FROM supplier), d AS (SELECT l_suppkey AS actor_id, min(l_shipdate) AS seen FROM lineitem GROUP BY 1)
SELECT actor_id, season AS target, concat_ws('|', CASE WHEN first < season THEN 'history' END, CASE WHEN drafted <= season THEN 'draft' END, CASE WHEN seen < make_date(season, 9, 1) THEN 'evidence' END) AS basis FROM f FULL JOIN e USING (actor_id) FULL JOIN d USING (actor_id) CROSS JOIN seasons WHERE first < season OR drafted <= season OR seen < make_date(season, 9, 1)""")
def _(t):
    f = t.actor_seasons.groupBy("actor_id").agg(F.min("season").alias("first"))
    e = t.raw("supplier").select(C("s_suppkey").alias("actor_id"), (1995 + C("s_suppkey") % 7).cast("int").alias("drafted"))
    d = t.raw("lineitem").groupBy(C("l_suppkey").alias("actor_id")).agg(F.min("l_shipdate").alias("seen"))
    u = f.join(e, "actor_id", "full").join(d, "actor_id", "full").crossJoin(F.broadcast(t.seasons.withColumnRenamed("season", "target")))
    basis = F.array_compact(F.array(F.when(C("first") < C("target"), "history"), F.when(C("drafted") <= C("target"), "draft"), F.when(C("seen") < F.make_date("target", F.lit(9), F.lit(1)), "evidence")))
    return u.select("actor_id", "target", F.array_join(basis, "|").alias("basis")).where("basis <> ''")


@query("J17_feature_availability", f"""WITH {bound.RECORDS}, u AS (SELECT DISTINCT actor_id, season + 1 AS target FROM actor_seasons)
SELECT u.actor_id, u.target, f.feature, r.value IS NOT NULL AS available, CASE WHEN r.actor_id IS NULL THEN 'no_record' WHEN r.value IS NULL THEN 'excluded' END AS reason FROM u CROSS JOIN (SELECT unnest(['rate', 'share']) AS feature) f LEFT JOIN recs r ON r.actor_id = u.actor_id AND r.target = u.target AND r.feature = f.feature""")
def _(t):
    u = t.actor_seasons.select("actor_id", (C("season") + 1).alias("target")).distinct().withColumn("feature", F.explode(F.array(F.lit("rate"), F.lit("share"))))
    r = bound.records(t).select("actor_id", "target", "feature", "value", F.lit(True).alias("hit"))
    return u.join(r, ["actor_id", "target", "feature"], "left").select("actor_id", "target", "feature", C("value").isNotNull().alias("available"), F.when(C("hit").isNull(), "no_record").when(C("value").isNull(), "excluded").alias("reason"))


@query("J18_evaluation_links", "SELECT a.actor_id, a.season, EXISTS (SELECT 1 FROM actor_seasons b WHERE b.actor_id = a.actor_id AND b.season < a.season AND b.volume > 1700) AS in_universe FROM actor_seasons a")
def _(t):
    first = t.actor_seasons.where("volume > 1700").groupBy("actor_id").agg(F.min("season").alias("first"))
    return t.actor_seasons.join(first, "actor_id", "left").select("actor_id", "season", F.coalesce(C("first") < C("season"), F.lit(False)).alias("in_universe"))


@query("J21_outcome_aggregation", """
WITH o AS (SELECT actor_id, season, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(value) AS BIGINT) AS value, count(DISTINCT opponent_id) AS teams, arg_max(opponent_id, (v, opponent_id)) AS main FROM (SELECT actor_id, season, opponent_id, sum(volume) AS volume, sum(value) AS value, CAST(sum(volume) AS BIGINT) AS v FROM plays GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT a.actor_id, a.season, a.volume, a.value, a.teams, CASE WHEN b.main IS NULL THEN 'first' WHEN a.main = b.main THEN 'stayed' ELSE 'changed' END AS change FROM o a LEFT JOIN o b ON a.actor_id = b.actor_id AND a.season = b.season + 1 WHERE a.volume >= 1500""")
def _(t):
    stints = t.plays.groupBy("actor_id", "season", "opponent_id").agg(F.sum("volume").alias("volume"), F.sum("value").alias("value"))
    o = stints.groupBy("actor_id", "season").agg(F.sum("volume").alias("volume"), F.sum("value").alias("value"), F.count_distinct("opponent_id").alias("teams"), F.max(F.struct("volume", "opponent_id"))["opponent_id"].alias("main"))
    out = joins.lag_join(o, ["actor_id"], "season", ["main"])
    change = F.when(C("prior_main").isNull(), "first").when(C("main") == C("prior_main"), "stayed").otherwise("changed")
    return out.where("volume >= 1500").select("actor_id", "season", "volume", "value", "teams", change.alias("change"))


@query("J25_rookie_cohort", """
WITH u AS (SELECT s_suppkey AS actor_id, CAST(1995 + s_suppkey % 7 AS INT) AS draft FROM supplier), j AS (SELECT u.actor_id, draft, volume FROM u LEFT JOIN actor_seasons a ON a.actor_id = u.actor_id AND a.season = draft AND a.volume > 1500)
SELECT draft, count(*) AS drafted, count(volume) AS observed, count(*) FILTER (WHERE volume >= 1700) AS qualified, round(count(volume)::DOUBLE / count(*), 9) AS coverage FROM j GROUP BY 1""")
def _(t):
    u = t.raw("supplier").select(C("s_suppkey").alias("actor_id"), (1995 + C("s_suppkey") % 7).cast("int").alias("season"))
    j = u.join(t.actor_seasons.where("volume > 1500").select("actor_id", "season", "volume"), ["actor_id", "season"], "left")
    return j.groupBy(C("season").alias("draft")).agg(N().alias("drafted"), F.count("volume").alias("observed"), F.count_if(C("volume") >= 1700).alias("qualified"), F.round(F.count("volume") / N(), 9).alias("coverage"))


@query("J27_q_availability", f"WITH {ATTR} SELECT owner_id, team_id, season, CAST(sum(n) AS BIGINT) AS exposure, round(sum(v)::DOUBLE / sum(n)::DOUBLE, 6) AS signal FROM j GROUP BY 1, 2, 3")
def _(t):
    # a row a team and week meets a row a team, week and owner
    both = cells(t).join(owner_weeks(assigned(t)), [*PLACE, "week"])
    return both.groupBy("owner_id", "team_id", "season").agg(F.sum(C("n") * C("c")).alias("exposure"), F.round(F.sum(C("v") * C("c")) / F.sum(C("n") * C("c")), 6).alias("signal"))


@query("J29_verified_attribution", f"""WITH {ATTR} SELECT CASE WHEN k = 1 THEN 'attributed' ELSE 'ambiguous' END AS outcome, season, CAST(sum(n // 1) AS BIGINT) AS plays_n FROM (SELECT DISTINCT season, team_id, week, actor_id, n, k FROM j) GROUP BY 1, 2
UNION ALL SELECT 'missing', season, CAST(sum(n) AS BIGINT) FROM cell c WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.season = c.season AND j.team_id = c.team_id AND j.week = c.week) GROUP BY season""")
def _(t):
    j = intervals.covered(cells(t), intervals.cover_points(assigned(t), PLACE, *SPAN, "week"), [*PLACE, "week"])
    outcome = F.when(C("k").isNull(), "missing").when(C("k") == 1, "attributed").otherwise("ambiguous")
    return j.groupBy(outcome.alias("outcome"), "season").agg(F.sum("n").alias("plays_n"))


@query("J30_strict_attribution", f"""WITH {ATTR} SELECT season, team_id, week, actor_id, owner_id, any_value(n) AS n, round(count(*)::DOUBLE / any_value(k), 9) AS weight, round(count(*) * any_value(n)::DOUBLE / any_value(k), 6) AS weighted, CASE WHEN any_value(k) = 1 THEN 'sole' ELSE 'split' END AS reason FROM j GROUP BY 1, 2, 3, 4, 5
UNION ALL SELECT season, team_id, week, actor_id, NULL, n, NULL, NULL, 'uncovered' FROM cell WHERE (season, team_id, week) NOT IN (SELECT (season, team_id, week) FROM j)""")
def _(t):
    return strict_attribution(t)


def strict_attribution(t, strict=False):
    """Each actor's week of plays by owner, with the owner's share of it; what no owner covers stays with its reason, or is an error."""
    out = intervals.covered(cells(t, "actor_id"), owner_weeks(assigned(t)), [*PLACE, "week"], strict)
    share = C("c") / C("k")
    return out.select(*PLACE, "week", "actor_id", "owner_id", "n", F.round(share, 9).alias("weight"), F.round(C("n") * share, 6).alias("weighted"), F.when(C("k").isNull(), "uncovered").when(C("k") == 1, "sole").otherwise("split").alias("reason"))


@query("J31_league_centred_value", "WITH o AS (SELECT season, actor_id % 40 AS owner, CAST(sum(value) AS BIGINT) AS v, count(*) AS n FROM plays GROUP BY 1, 2), l AS (SELECT season, sum(v)::DOUBLE / sum(n)::DOUBLE AS weighted, avg(v::DOUBLE / n) AS plain FROM o GROUP BY 1) SELECT season, owner, round(v::DOUBLE / n - weighted, 6) AS centred, round(v::DOUBLE / n - plain, 5) AS centred_plain FROM o JOIN l USING (season)")
def _(t):
    o = t.plays.groupBy("season", (C("actor_id") % 40).alias("owner")).agg(F.sum("value").alias("v"), N().alias("n"))
    l = o.groupBy("season").agg((F.sum("v") / F.sum("n")).alias("weighted"), F.avg(C("v") / C("n")).alias("plain"))
    return o.join(F.broadcast(l), "season").select("season", "owner", F.round(C("v") / C("n") - C("weighted"), 6).alias("centred"), F.round(C("v") / C("n") - C("plain"), 5).alias("centred_plain"))


@query("J37_feature_availability_class", f"WITH {bound.RECORDS} SELECT feature, count(value) AS present, round(count(value)::DOUBLE / count(*), 9) AS coverage, count(DISTINCT target) AS targets, CASE WHEN count(value)::DOUBLE / count(*) >= 0.95 THEN 'available' WHEN count(value) > 0 THEN 'partial' ELSE 'absent' END AS status FROM recs GROUP BY 1")
def _(t):
    r = bound.records(t).groupBy("feature").agg(F.count("value").alias("present"), F.round(F.count("value") / N(), 9).alias("coverage"), F.count_distinct("target").alias("targets"))
    return r.withColumn("status", F.when(C("coverage") >= 0.95, "available").when(C("present") > 0, "partial").otherwise("absent"))


@query("J38_cell_structure", """
WITH c AS (SELECT season, team_id, role, string_agg(DISTINCT owner_id::VARCHAR, '|' ORDER BY owner_id::VARCHAR) AS owners, count(*) AS n, count(*) FILTER (WHERE status <> 'unresolved') AS supporting, count(*) FILTER (WHERE status = 'verified') AS verified FROM intervals GROUP BY 1, 2, 3),
w AS (SELECT season, team_id, count(DISTINCT week) AS weeks FROM plays GROUP BY 1, 2)
SELECT a.season, a.team_id, a.role, a.owners, a.n, a.supporting, a.verified, coalesce(weeks, 0) AS weeks, a.season < 1998 AS early_era, a.season >= 2000 AS late_era, CASE WHEN b.owners IS NULL THEN 'unknown' WHEN a.owners = b.owners THEN 'same' ELSE 'changed' END AS continuity
FROM c a LEFT JOIN c b ON a.team_id = b.team_id AND a.role = b.role AND a.season = b.season + 1 LEFT JOIN w ON w.season = a.season AND w.team_id = a.team_id""")
def _(t):
    c = t.intervals.groupBy("season", "team_id", "role").agg(aggs.string_set(C("owner_id")).alias("owners"), N().alias("n"), F.count_if(C("status") != "unresolved").alias("supporting"), F.count_if(C("status") == "verified").alias("verified"))
    weeks = t.plays.groupBy("season", "team_id").agg(F.count_distinct("week").alias("weeks"))
    out = joins.lag_join(c, ["team_id", "role"], "season", ["owners"]).join(weeks, PLACE, "left")
    continuity = F.when(C("prior_owners").isNull(), "unknown").when(C("owners") == C("prior_owners"), "same").otherwise("changed")
    return out.select(*PLACE, "role", "owners", "n", "supporting", "verified", F.coalesce("weeks", F.lit(0)).alias("weeks"), (C("season") < 1998).alias("early_era"), (C("season") >= 2000).alias("late_era"), continuity.alias("continuity"))


@query("J39_research_priority", """
WITH q AS (SELECT season, team_id, plays * CASE WHEN season >= 1999 THEN 3 ELSE 1 END AS score FROM team_seasons WHERE value > 0), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, season DESC, team_id) AS rank FROM q)
SELECT season, team_id, score, rank, CAST(sum(score) OVER (ORDER BY rank) AS BIGINT) AS reached, CASE WHEN rank <= 10 THEN 'first' WHEN rank <= 40 THEN 'second' ELSE 'third' END AS tier FROM k""")
def _(t):
    q = t.team_seasons.where("value > 0").select("season", "team_id", (C("plays") * F.when(C("season") >= 1999, 3).otherwise(1)).alias("score"))
    w = Window.orderBy(F.desc("score"), F.desc("season"), "team_id")  # a row a team-season
    k = q.withColumn("rank", F.row_number().over(w)).withColumn("reached", F.sum("score").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return k.withColumn("tier", F.when(C("rank") <= 10, "first").when(C("rank") <= 40, "second").otherwise("third"))


@query("J40_season_readiness", "SELECT s.season, count(DISTINCT ts.team_id) AS teams, coalesce(CAST(sum(ts.plays) AS BIGINT), 0) AS plays_n, count(DISTINCT ts.team_id) >= 20 AND s.season >= 1997 AS eligible, CASE WHEN s.season < 1997 THEN 'too_early' WHEN count(DISTINCT ts.team_id) < 20 THEN 'few_teams' END AS reason FROM seasons s LEFT JOIN team_seasons ts ON ts.season = s.season AND ts.plays > 250 GROUP BY 1")
def _(t):
    p = t.team_seasons.where("plays > 250").groupBy("season").agg(F.count_distinct("team_id").alias("teams"), F.sum("plays").alias("plays_n"))
    out = t.seasons.join(p, "season", "left").fillna(0)
    return out.select("*", ((C("teams") >= 20) & (C("season") >= 1997)).alias("eligible"), F.when(C("season") < 1997, "too_early").when(C("teams") < 20, "few_teams").alias("reason"))


@query("J43_evidence_ceiling_class", "SELECT interval_id, CASE WHEN status = 'verified' THEN 'done' WHEN shared THEN 'shared' WHEN status = 'supported' AND end_week > 8 THEN 'likely' WHEN status = 'supported' THEN 'possible' ELSE 'unknown' END AS ceiling FROM intervals")
def _(t):
    from ..functions.rates import ordered_when

    s = C("status")
    return t.intervals.select("interval_id", ordered_when([(s == "verified", "done"), (C("shared"), "shared"), ((s == "supported") & (C("end_week") > 8), "likely"), (s == "supported", "possible")], "unknown").alias("ceiling"))


@query("M01_entity_exact_or_candidates", """
WITH e AS (SELECT n_nationkey AS id, lower(n_name) AS k FROM nation UNION ALL SELECT 100 + r_regionkey, lower(r_name) FROM region UNION ALL SELECT 1000 + p_partkey, lower(p_name) FROM part),
m AS (SELECT id AS mention, CASE id % 7 WHEN 0 THEN k WHEN 1 THEN substr(k, 1, length(k) - 1) WHEN 2 THEN string_split(k, ' ')[1] WHEN 3 THEN 'x' || substr(k, 2) WHEN 4 THEN 'q' || k WHEN 5 THEN substr(k, 1, 3) || substr(k, 5) ELSE id::VARCHAR END AS said FROM e UNION ALL SELECT -1, 'zzzz' UNION ALL SELECT -2, 'united'),
x1 AS (SELECT DISTINCT mention, id, 1.0::DOUBLE AS score, 'exact' AS method FROM m JOIN e ON said = k OR said = id::VARCHAR),
t AS (SELECT DISTINCT mention, unnest(string_split(said, ' ')) AS word, len(string_split(said, ' ')) AS n FROM m WHERE mention NOT IN (SELECT mention FROM x1)), w AS (SELECT DISTINCT id, unnest(string_split(k, ' ')) AS word, len(string_split(k, ' ')) AS k FROM e),
x2 AS (SELECT mention, id, any_value(n)::DOUBLE / any_value(k) AS score, 'partial' AS method FROM t JOIN w USING (word) GROUP BY mention, id HAVING count(DISTINCT word) = any_value(n)),
r AS (SELECT * FROM m WHERE mention NOT IN (SELECT mention FROM x1) AND mention NOT IN (SELECT mention FROM x2)),
s AS (SELECT said, k, 1 - levenshtein(said, k)::DOUBLE / greatest(length(said), length(k)) AS score FROM (SELECT DISTINCT said FROM r) CROSS JOIN (SELECT DISTINCT k FROM e)),
x3 AS (SELECT mention, id, score, 'fuzzy' AS method FROM r JOIN s USING (said) JOIN e USING (k) WHERE score >= 0.8),
x AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3), b AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY mention) AS found FROM x)
SELECT m.mention, b.id, round(b.score, 6) AS score, b.method, coalesce(r, 0) AS rank, coalesce(found, 0) AS found, CASE WHEN b.id IS NULL THEN 'not_found' WHEN b.method = 'exact' AND found = 1 THEN 'exact' ELSE 'ambiguous' END AS status FROM m LEFT JOIN b ON b.mention = m.mention AND r <= 5""")
def _(t):
    words = lambda c: F.split(c, " ")
    name = lambda df, key, label: df.select(key.cast("long").alias("id"), F.lower(label).alias("k"))
    e = name(t.raw("nation"), C("n_nationkey"), "n_name").unionByName(name(t.raw("region"), C("r_regionkey") + 100, "r_name")).unionByName(name(t.raw("part"), C("p_partkey") + 1000, "p_name"))
    kind = C("id") % 7
    said = F.when(kind == 0, C("k")).when(kind == 1, F.expr("substr(k, 1, length(k) - 1)")).when(kind == 2, words(C("k"))[0]).when(kind == 3, F.expr("'x' || substr(k, 2)")).when(kind == 4, F.concat(F.lit("q"), "k")).when(kind == 5, F.expr("substr(k, 1, 3) || substr(k, 5)")).otherwise(C("id").cast("string"))
    m = e.select(C("id").alias("mention"), said.alias("said")).unionByName(t.spark.createDataFrame([(-1, "zzzz"), (-2, "united")], "mention long, said string"))
    # each way is tried on the mentions that the ways before it left, text by text: equality of label or id, all words in the label, likeness.
    # Of the ids that share a label the first five are shown, with how many there are
    labels = e.groupBy("k").agg(N().alias("times")).withColumn("words", F.array_distinct(words(C("k")))).withColumn("k_words", F.size(words(C("k"))))
    texts = m.select("said").distinct()
    ids = e.select(C("id").cast("string").alias("said"), "id")
    by_label = texts.join(labels.select(C("k").alias("said"), "times"), "said").select("said", C("said").alias("k"), F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
    by_id = texts.join(ids, "said").select("said", F.lit(1.0).alias("score"), F.lit("exact").alias("method"), "id")
    rest = texts.join(by_label, "said", "left_anti").join(by_id, "said", "left_anti")
    own = rest.select("said", F.explode(F.array_distinct(words(C("said")))).alias("word"), F.size(words(C("said"))).alias("n"))
    partial = own.join(labels.select("k", "k_words", F.explode("words").alias("word")), "word").groupBy("said", "k").agg(N().alias("c"), F.first("n").alias("n"), F.first("k_words").alias("k_words")).where("c = n").select("said", "k", (C("n") / C("k_words")).alias("score"), F.lit("partial").alias("method"))
    rest = rest.join(partial, "said", "left_anti")
    close = fuzzy.alike(rest, labels, "said", "k", "said", "k", (1, 5)).withColumn("method", F.lit("fuzzy"))
    found = cut(by_label.unionByName(partial).unionByName(close), "candidates")
    first = win.top_per_group(e, ["k"], [F.asc("id")], 5)
    totals = found.join(labels.select("k", "times"), "k").select("said", "times").unionByName(by_id.select("said", F.lit(1).cast("long").alias("times"))).groupBy("said").agg(F.sum("times").alias("found"))
    x = found.join(first.select("k", "id"), "k").select("said", "id", "score", "method").unionByName(by_id.select("said", "id", "score", "method"))
    b = x.withColumn("rank", F.row_number().over(Window.partitionBy("said").orderBy(F.desc("score"), "id"))).where("rank <= 5").join(totals, "said")
    status = F.when(C("id").isNull(), "not_found").when((C("method") == "exact") & (C("found") == 1), "exact").otherwise("ambiguous")
    return m.join(b, "said", "left").select("mention", "id", F.round("score", 6).alias("score"), "method", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("found", F.lit(0)).alias("found"), status.alias("status"))
