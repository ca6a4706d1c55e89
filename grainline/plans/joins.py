"""Queries of family C (joins)."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals, joins
from ..sources.shared import cut
from .registry import query


@query("C01_checked_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    c = t.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.checked_join(t.raw("orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], cardinality="m:1").select("o_orderkey", "c_mktsegment")


@query("C02_interval_join", """
SELECT game_id, play_id, interval_id, owner_id, count(*) AS n FROM plays p JOIN intervals i ON p.season = i.season AND p.team_id = i.team_id AND p.week BETWEEN i.start_week AND i.end_week WHERE i.role = 1 GROUP BY 1, 2, 3, 4""")
def _(t):
    return held_plays(t.plays_by_game, t.intervals.where("role = 1"))


def held_plays(plays, i):
    """game_id, play_id, interval_id, owner_id, n: how many plays of that id the interval holds. Repeated plays are counted first, and both sides meet
    by week too. A row that the join makes is a row of the result, and goes nowhere else, where a play's id stands for one week of its team and season and
    an interval's for one row. The rest is added up, and plays are read or dealt again only where there is one."""
    own, place, play = ["interval_id", "owner_id"], ["season", "team_id"], ["game_id", "play_id", "season", "team_id"]
    i = i.groupBy(*own, *place, "start_week", "end_week").agg(F.count(F.lit(1)).alias("m"))
    i = cut(i.join(i.groupBy(*own).agg((F.count(F.lit(1)) > 1).alias("several")), own), "intervals")
    ids = cut(plays.groupBy(*play).agg(F.count("week").alias("n"), F.min("week").alias("week"), F.max("week").alias("last")), "plays")
    one, odd = ids.where("week = last").drop("last"), ids.where("week < last").select(*(F.col(c).alias(f"_{c}") for c in play))
    met = lambda p, i: intervals.point_join(p, i, place, "week", "start_week", "end_week").select("game_id", "play_id", *own, (F.col("n") * F.col("m")).alias("n"))
    out, rest = met(one, i.where("NOT several")), []
    if not i.where("several").isEmpty():
        rest.append(met(one, i.where("several")))
    if not odd.isEmpty():
        same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in play))
        rest.append(met(plays.join(odd, same, "left_semi").groupBy(*play, "week").agg(F.count(F.lit(1)).alias("n")), i))
    if rest:
        out = out.unionByName(functools.reduce(DataFrame.unionByName, rest).groupBy("game_id", "play_id", *own).agg(F.sum("n").alias("n")))
    return out


PARTIAL = "part AS (SELECT * FROM actor_seasons WHERE volume >= 1500)"


def partial(t):
    """The seasons in which an actor qualifies: they have gaps."""
    return t.actor_seasons.where("volume >= 1500")


@query("C03_lag_season_join", f"""WITH {PARTIAL}
SELECT a.actor_id, a.season, a.plays, a.value, b.plays AS prior_plays, b.value AS prior_value FROM part a LEFT JOIN part b ON a.actor_id = b.actor_id AND a.season = b.season + 1""")
def _(t):
    p = partial(t).select("actor_id", "season", "plays", "value")
    return joins.lag_join(p, ["actor_id"], "season", ["plays", "value"])


@query("C04_consecutive_pairs_inner", f"""WITH {PARTIAL}
SELECT a.actor_id, a.season, a.value, b.value AS prior_value FROM part a JOIN part b ON a.actor_id = b.actor_id AND a.season = b.season + 1""")
def _(t):
    return joins.lag_join(partial(t).select("actor_id", "season", "value"), ["actor_id"], "season", ["value"], how="inner")


@query("C05_semi_anti_filters", """
SELECT c_custkey, 'active' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT c_custkey, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def _(t):
    c = t.raw("customer").select("c_custkey")
    o = t.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("kind", F.lit("active")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("idle")))


@query("C06_full_outer_coalesce", """
WITH a AS (SELECT team_id, season, plays FROM team_seasons WHERE plays >= 330), b AS (SELECT team_id, season, volume FROM team_seasons WHERE volume >= 8500)
SELECT coalesce(a.team_id, b.team_id) AS team_id, coalesce(a.season, b.season) AS season, plays, volume FROM a FULL JOIN b ON a.team_id = b.team_id AND a.season = b.season""")
def _(t):
    a = t.team_seasons.where("plays >= 330").select("team_id", "season", "plays")
    b = t.team_seasons.where("volume >= 8500").select("team_id", "season", "volume")
    return a.join(b, ["team_id", "season"], "full")


@query("C07_grid_cross_join", """
SELECT season, n_nationkey AS team_id, role, coalesce(n, 0) AS n FROM seasons CROSS JOIN nation CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS role)
LEFT JOIN (SELECT season, team_id, role, count(*) AS n FROM intervals WHERE shared GROUP BY 1, 2, 3) o USING (season, role) WHERE o.team_id = n_nationkey OR o.team_id IS NULL
UNION ALL SELECT season, n_nationkey, role, 0 FROM seasons CROSS JOIN nation CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS role) WHERE (season, n_nationkey, role) NOT IN (SELECT (season, team_id, role) FROM intervals WHERE shared)
  AND (season, role) IN (SELECT (season, role) FROM intervals WHERE shared)""")
def _(t):
    observed = t.intervals.where("shared").groupBy("season", "team_id", "role").agg(F.count(F.lit(1)).alias("n"))
    roles = t.spark.range(4).select(F.col("id").cast("int").alias("role"))
    return joins.grid([t.seasons, t.raw("nation").select(F.col("n_nationkey").alias("team_id")), roles], observed, ["season", "team_id", "role"], {"n": 0})


OVERLAPS = """lapping AS (SELECT a.season, a.team_id, a.role, a.interval_id AS a_id, b.interval_id AS b_id, greatest(a.start_week, b.start_week) AS overlap_start, least(a.end_week, b.end_week) AS overlap_end, a.shared AS a_shared, b.shared AS b_shared
FROM intervals a JOIN intervals b ON a.season = b.season AND a.team_id = b.team_id AND a.role = b.role AND a.interval_id < b.interval_id AND a.start_week <= b.end_week AND b.start_week <= a.end_week)"""


def overlaps(t, shared=None):
    out = intervals.conflict_pairs(t.intervals, ["season", "team_id", "role"], "interval_id", "start_week", "end_week", ["shared"], shared)
    return out.select("season", "team_id", "role", F.col("a_interval_id").alias("a_id"), F.col("b_interval_id").alias("b_id"), "overlap_start", "overlap_end", "a_shared", "b_shared")


@query("C08_overlap_self_join", f"WITH {OVERLAPS} SELECT * FROM lapping")
def _(t):
    return overlaps(t)


@query("C09_illegal_overlap_check", f"WITH {OVERLAPS} SELECT season, team_id, role, a_id, b_id FROM lapping WHERE NOT (a_shared AND b_shared)")
def _(t):
    return overlaps(t, "shared").select("season", "team_id", "role", "a_id", "b_id")


@query("C10_alias_validity_overlap", """
WITH v AS (SELECT s_suppkey AS k, s_nationkey AS alias, DATE '1995-01-01' + CAST(s_suppkey * 20 % 2000 AS INT) AS valid_from, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(s_suppkey * 20 % 2000 + 300 AS INT) END AS valid_to FROM supplier)
SELECT a.alias, a.k AS a_k, b.k AS b_k, strftime(greatest(a.valid_from, b.valid_from), '%Y-%m-%d') AS since FROM v a JOIN v b ON a.alias = b.alias AND a.k < b.k AND a.valid_from <= coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from <= coalesce(a.valid_to, DATE '9999-12-31')""")
def _(t):
    k = F.col("s_suppkey")
    first = F.date_add(F.lit("1995-01-01").cast("date"), (k * 20 % 2000).cast("int"))
    v = t.raw("supplier").select(k.alias("k"), F.col("s_nationkey").alias("alias"), first.alias("valid_from"), F.coalesce(F.when(k % 4 != 0, F.date_add(first, 300)), F.lit("9999-12-31").cast("date")).alias("valid_to"))
    out = intervals.conflict_pairs(v, ["alias"], "k", "valid_from", "valid_to", [], width=64)
    return out.select("alias", "a_k", "b_k", F.date_format("overlap_start", "yyyy-MM-dd").alias("since"))


@query("C11_exists_anchor", "SELECT season, team_id, plays FROM team_seasons f WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.season = f.season AND i.team_id = f.team_id AND i.role = 2 AND i.status = 'verified')")
def _(t):
    return joins.exists_anchor(t.team_seasons.select("season", "team_id", "plays"), t.intervals, ["season", "team_id"], (F.col("role") == 2) & (F.col("status") == "verified"))


@query("C12_values_scope_join", "SELECT f.season, f.team_id, f.value FROM team_seasons f JOIN (VALUES (1996, 3), (1997, 4), (2000, 24)) s(season, team_id) ON f.season = s.season AND f.team_id = s.team_id")
def _(t):
    scope = t.spark.createDataFrame([(1996, 3), (1997, 4), (2000, 24)], "season int, team_id int")
    return t.team_seasons.select("season", "team_id", "value").join(F.broadcast(scope), ["season", "team_id"])


@query("C13_as_of_history", f"""WITH {PARTIAL}
SELECT a.actor_id, a.season, CAST(sum(b.plays) AS BIGINT) AS career_plays, CAST(sum(b.value) AS BIGINT) AS career_value FROM part a LEFT JOIN part b ON a.actor_id = b.actor_id AND b.season < a.season GROUP BY 1, 2""")
def _(t):
    return joins.as_of_totals(partial(t), ["actor_id"], "season", ["plays", "value"]).select("actor_id", "season", "career_plays", "career_value")


@query("C14_as_of_evidence", """
WITH tg AS (SELECT DISTINCT user_id, '2024-01-' || lpad((10 + user_id % 15)::VARCHAR, 2, '0') AS cutoff FROM events),
e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS v, CAST(event_id % 2 AS INT) AS stage FROM events),
j AS (SELECT * FROM tg JOIN e USING (user_id) WHERE day <= cutoff),
b AS (SELECT user_id, max(stage || day) AS m FROM j GROUP BY 1),
c AS (SELECT j.user_id, any_value(stage) AS stage, any_value(day) AS day, count(DISTINCT v) AS n, min(v) AS v FROM j JOIN b ON j.user_id = b.user_id AND stage || day = m GROUP BY 1)
SELECT tg.user_id, cutoff, stage, day, CASE WHEN n = 1 THEN v END AS v, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'resolved' ELSE 'none' END AS status FROM tg LEFT JOIN c USING (user_id)""")
def _(t):
    e = t.raw("events")
    targets = e.select("user_id").distinct().withColumn("cutoff", F.concat(F.lit("2024-01-"), F.lpad((10 + F.col("user_id") % 15).cast("string"), 2, "0")))
    ev = e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("v"), (F.col("event_id") % 2).cast("int").alias("stage"))
    return joins.as_of_evidence(targets, ev, "user_id", "cutoff", "day", "v", "stage")


@query("C15_current_publication_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 = 2")
def _(t):
    pointer = t.spark.createDataFrame([(2,)], "load_id bigint")
    return t.raw("orders").withColumn("load_id", F.col("o_orderkey") % 4).join(F.broadcast(pointer), "load_id").select("o_orderkey", "o_totalprice")


@query("C16_replace_cells", """
WITH n AS (SELECT season, team_id, plays * 10 AS plays FROM team_seasons WHERE team_id % 6 = 1)
SELECT season, team_id, plays FROM team_seasons WHERE (season, team_id) NOT IN (SELECT (season, team_id) FROM n) UNION ALL SELECT * FROM n""")
def _(t):
    base = t.team_seasons.select("season", "team_id", "plays")
    return joins.replace_cells(base, base.where("team_id % 6 = 1").withColumn("plays", F.col("plays") * 10), ["season", "team_id"])


@query("C17_coalesced_override", """
SELECT i.interval_id, CASE WHEN s % 9 = 0 THEN 'verified' ELSE status END AS status, s % 9 IN (0, 1) AS researched FROM (SELECT *, CAST(split_part(interval_id, '-', 1) AS INT) AS s FROM intervals) i""")
def _(t):
    k = F.split_part("interval_id", F.lit("-"), F.lit(1)).cast("int")
    review = t.intervals.select("interval_id", k.alias("k")).where("k % 9 < 2").select("interval_id", F.when(F.col("k") % 9 == 0, "verified").alias("status"))
    return joins.override(t.intervals.select("interval_id", "status"), review, ["interval_id"], "status")


OWNERS = "o AS (SELECT DISTINCT owner_id, role, season, CAST((team_id + CASE WHEN owner_id % 3 = 0 THEN season ELSE 0 END) % 25 AS INT) AS team FROM intervals)"


def owners(t):
    team = ((F.col("team_id") + F.when(F.col("owner_id") % 3 == 0, F.col("season")).otherwise(0)) % 25).cast("int")
    return t.intervals.select("owner_id", "role", "season", team.alias("team")).distinct()


@query("C18_move_self_join", f"""WITH {OWNERS}
SELECT a.owner_id, a.role, a.season, a.team AS from_team, b.team AS to_team FROM o a JOIN o b ON a.owner_id = b.owner_id AND a.role = b.role AND b.season = a.season + 1 AND a.team <> b.team""")
def _(t):
    return joins.moves(owners(t), "owner_id", "role", "season", "team")


@query("C19_multi_role_intersection", """
WITH b AS (SELECT DISTINCT season, team_id, role FROM intervals)
SELECT * FROM b UNION ALL SELECT season, team_id, 9 FROM b WHERE role IN (0, 1, 2) GROUP BY 1, 2 HAVING count(*) = 3""")
def _(t):
    return joins.role_intersection(t.intervals, ["season", "team_id"], "role", [0, 1, 2], 9)


@query("C20_joinability_counts", """
WITH e AS (SELECT DISTINCT season, team_id, role FROM intervals WHERE status <> 'unresolved')
SELECT role, count(DISTINCT (game_id, play_id)) AS facts, count(DISTINCT actor_id) AS actors, count(DISTINCT team_id) AS teams, count(DISTINCT season) AS seasons_seen FROM plays JOIN e USING (season, team_id) GROUP BY role""")
def _(t):
    return joins.joinability(t.plays, t.intervals.where("status <> 'unresolved'"), ["season", "team_id"], "role", {"facts": ["game_id", "play_id"], "actors": ["actor_id"], "teams": ["team_id"], "seasons_seen": ["season"]})
