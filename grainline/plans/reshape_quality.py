"""Queries of families G (sets), H (reshaping) and I (quality)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, quality, reshape
from ..operators import windows as win
from . import aggs as bound
from .domain import ATTR, PLACE, assigned, owner_weeks
from .registry import query

C = F.col


@query("G01_union_diagonal", "SELECT season, team_id, plays, NULL::BIGINT AS games FROM team_seasons UNION ALL SELECT season, NULL, NULL, count(*) FROM games GROUP BY season")
def _(t):
    return reshape.union_diagonal([t.team_seasons.select("season", "team_id", "plays"), t.games.groupBy("season").agg(F.count(F.lit(1)).alias("games"))])


@query("G02_union_vertical_checked", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT n_nationkey, n_regionkey FROM nation")
def _(t):
    return reshape.union_vertical([t.raw("supplier").select(C("s_suppkey").alias("k"), C("s_acctbal").alias("v")), t.raw("nation").select(C("n_nationkey").alias("k"), C("n_regionkey").alias("v"))], {"k": "long", "v": "double"})


@query("G03_distinct_rows", "SELECT DISTINCT season, week, team_id, attempt FROM plays")
def _(t):
    return t.plays.select("season", "week", "team_id", "attempt").distinct()


@query("G04_symmetric_difference", """
SELECT season, week, 'left' AS side FROM (SELECT season, unnest(range(1, 13))::INT AS week FROM seasons EXCEPT SELECT season, week FROM games)
UNION ALL SELECT season, week, 'right' FROM (SELECT DISTINCT season, week FROM games WHERE week <= 12 EXCEPT SELECT season, unnest(range(1, 13))::INT FROM seasons)""")
def _(t):
    expected = t.seasons.withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return reshape.symmetric_difference(expected, t.games.select("season", "week").distinct())


@query("G05_population_identity", """
WITH s AS (SELECT 'a' AS model, actor_id, season FROM actor_seasons UNION ALL SELECT 'b', actor_id, season FROM actor_seasons WHERE actor_id % 10 <> 3 UNION ALL SELECT 'c', actor_id, season FROM actor_seasons),
k AS (SELECT DISTINCT actor_id, season FROM s), m AS (SELECT DISTINCT model FROM s)
SELECT m.model, count(s.model) AS rows_scored, count(*) - count(s.model) AS missing, count(*) = count(s.model) AS identical FROM m CROSS JOIN k LEFT JOIN s ON s.model = m.model AND s.actor_id = k.actor_id AND s.season = k.season GROUP BY 1""")
def _(t):
    a = t.actor_seasons.select("actor_id", "season")
    tags = F.filter(F.array(F.lit("a"), F.when(C("actor_id") % 10 != 3, "b"), F.lit("c")), lambda x: x.isNotNull())
    return reshape.population_identity(a.withColumn("model", F.explode(tags)), "model", ["actor_id", "season"])


def profiles(t):
    from ..operators.aggs import profile_long

    return profile_long(t.plays, ["team_id", "season"], bound._rates(), bound._means())


WIDE = """count(*) FILTER (WHERE attempt) AS d1, count(*) FILTER (WHERE success AND attempt) AS n1, count(*) FILTER (WHERE discount >= 5) AS d2, count(*) FILTER (WHERE value > 0 AND discount >= 5) AS n2"""


@query("H01_pivot_feature_wide", f"SELECT team_id, season, round(n1::DOUBLE / d1, 9) AS success, round(n2::DOUBLE / d2, 9) AS positive, NULL::DOUBLE AS absent FROM (SELECT team_id, season, {WIDE} FROM plays GROUP BY 1, 2)")
def _(t):
    return reshape.pivot_wide(profiles(t), ["team_id", "season"], "feature", {"value": "value"}, ["success", "positive", "absent"])


@query("H03_profile_unpivot", """
WITH w AS (SELECT actor_id, season, CAST(sum(value) AS BIGINT) AS v, CAST(sum(value * value) AS BIGINT) AS vv, count(*) AS n, count(*) FILTER (WHERE attempt) AS a FROM plays GROUP BY 1, 2)
SELECT actor_id, season, 'value' AS feature, v AS numerator, n AS denominator, vv AS sum_squares, v::DOUBLE / n AS raw, n >= 60 AS qualified FROM w UNION ALL SELECT actor_id, season, 'attempt', a, n, a, a::DOUBLE / n, n >= 60 FROM w""")
def _(t):
    w = t.plays.groupBy("actor_id", "season").agg(F.sum("value").alias("v"), F.sum(C("value") * C("value")).alias("vv"), F.count(F.lit(1)).alias("n"), F.count_if("attempt").alias("a"))
    q = C("n") >= 60
    return reshape.profile_unpivot(w, ["actor_id", "season"], {"value": (C("v"), C("n"), C("vv"), q), "attempt": (C("a"), C("n"), C("a"), q)})


@query("H04_fingerprint_wide", f"""
WITH w AS (SELECT team_id, season, {WIDE} FROM plays GROUP BY 1, 2), l AS (SELECT team_id, season, round(n1::DOUBLE / d1, 9) AS success, round(n2::DOUBLE / d2, 9) AS positive FROM w)
SELECT team_id, season, success, positive, round((success - avg(success) OVER p) / stddev_pop(success) OVER p, 6) AS success_z, round((positive - avg(positive) OVER p) / stddev_pop(positive) OVER p, 6) AS positive_z FROM l WINDOW p AS (PARTITION BY season)""")
def _(t):
    from ..operators.windows import zscore

    z = zscore(profiles(t), ["season", "feature"], "value", population=True).withColumn("z", F.round("z", 6))
    return reshape.pivot_wide(z, ["team_id", "season"], "feature", {"value": "", "z": "_z"}, ["success", "positive"])


@query("H05_delimited_explode", "SELECT DISTINCT team_id, role::VARCHAR AS member FROM intervals")
def _(t):
    from ..operators.aggs import string_set

    rows = t.intervals.groupBy("team_id", "season").agg(string_set(C("role")).alias("roles"))
    return reshape.delimited_members(rows, "team_id", "roles")


@query("H06_list_contains", "WITH l AS (SELECT team_id, list(DISTINCT actor_id) FILTER (WHERE attempt AND play_id = 7) AS ids FROM plays GROUP BY 1) SELECT s_suppkey, coalesce(list_contains(ids, s_suppkey), false) AS hit FROM supplier LEFT JOIN l ON s_nationkey = team_id AND s_suppkey % 4 <> 0")
def _(t):
    ids = t.plays.groupBy(C("team_id").alias("s_nationkey")).agg(F.collect_set(F.when(C("attempt") & (C("play_id") == 7), C("actor_id"))).alias("ids"))
    s = t.raw("supplier").join(ids, "s_nationkey", "left").withColumn("ids", F.when(C("s_suppkey") % 4 != 0, C("ids")))
    return s.select("s_suppkey", reshape.list_contains(C("ids"), C("s_suppkey")).alias("hit"))


@query("H07_json_payload", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS payload FROM events")
def _(t):
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("payload"))


@query("H08_regex_extract_key", "SELECT interval_id, CAST(regexp_extract('team:' || team_id || ':season:' || season, 'team:([0-9]+):season', 1) AS INT) AS team FROM intervals")
def _(t):
    text = F.concat(F.lit("team:"), "team_id", F.lit(":season:"), "season")
    return t.intervals.select("interval_id", F.regexp_extract(text, "team:([0-9]+):season", 1).cast("int").alias("team"))


@query("H09_pad_key_build", "SELECT c_custkey, concat_ws('-', lpad((c_custkey % 20)::VARCHAR, 2, '0'), regexp_replace(c_name, '^Customer#0*', ''), c_nationkey::VARCHAR) AS k FROM customer")
def _(t):
    return t.raw("customer").select("c_custkey", F.concat_ws("-", F.lpad((C("c_custkey") % 20).cast("string"), 2, "0"), F.regexp_replace("c_name", "^Customer#0*", ""), C("c_nationkey").cast("string")).alias("k"))


@query("H10_horizontal_any_sum", """
WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS a, CASE WHEN p_partkey % 2 <> 0 THEN p_partkey % 17 END AS b FROM part)
SELECT p_partkey, a IS NOT NULL OR b IS NOT NULL AS any_present, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN (coalesce(a, 0) + coalesce(b, 0))::DOUBLE END AS sum_present, least(a, b)::DOUBLE AS min_present,
  round(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN sqrt((coalesce(a * a, 0) + coalesce(b * b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT)) END, 8) AS rms FROM x""")
def _(t):
    k = C("p_partkey")
    rows = t.raw("part").select("p_partkey", F.when(k % 3 != 0, C("p_size")).alias("a"), F.when(k % 2 != 0, k % 17).alias("b"))
    return reshape.horizontal(rows, ["a", "b"]).drop("a", "b").withColumn("rms", F.round("rms", 8))


@query("H11_interaction_products", "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size END * (p_partkey % 7) AS ab FROM part")
def _(t):
    rows = t.raw("part").select("p_partkey", F.when(C("p_size") % 4 != 0, C("p_size")).alias("a"), (C("p_partkey") % 7).alias("b"))
    return reshape.interactions(rows, {"ab": ("a", "b")}).select("p_partkey", "ab")


@query("I01_quality_report", """
WITH r AS (SELECT 'negative_value' AS name, 'warning' AS severity, count(*) FILTER (WHERE value < 0) AS failure_count FROM plays UNION ALL SELECT 'no_team', 'error', count(*) FILTER (WHERE team_id IS NULL) FROM plays
  UNION ALL SELECT 'same_team', 'error', count(*) FILTER (WHERE home_team = away_team) FROM games)
SELECT *, CASE WHEN failure_count = 0 THEN 'pass' WHEN severity = 'error' THEN 'fail' ELSE 'warning' END AS status FROM r""")
def _(t):
    return quality.quality_report([("negative_value", t.plays, C("value") < 0, "warning"), ("no_team", t.plays, C("team_id").isNull(), "error"), ("same_team", t.games, C("home_team") == C("away_team"), "error")])


@query("I02_feature_frame_leakage", """
WITH m AS (SELECT actor_id, season, count(DISTINCT opponent_id) > 1 AS several FROM plays GROUP BY 1, 2), f AS (SELECT actor_id, season, season - CASE WHEN actor_id % 23 = 0 THEN 0 ELSE 1 END AS as_of, season - CASE WHEN actor_id % 19 = 0 THEN 0 ELSE 1 END AS source, CASE WHEN actor_id % 17 = 0 THEN 1 END AS destination, several FROM actor_seasons JOIN m USING (actor_id, season))
SELECT actor_id, season, unnest(list_filter([CASE WHEN as_of <> season - 1 THEN 'as_of' END, CASE WHEN source >= season THEN 'source' END, CASE WHEN several AND destination IS NOT NULL THEN 'destination' END], lambda x: x IS NOT NULL)) AS rule FROM f""")
def _(t):
    several = t.plays.groupBy("actor_id", "season").agg((F.count_distinct("opponent_id") > 1).alias("several"))
    f = t.actor_seasons.join(several, ["actor_id", "season"]).select("actor_id", "season", (C("season") - F.when(C("actor_id") % 23 == 0, 0).otherwise(1)).alias("as_of"), (C("season") - F.when(C("actor_id") % 19 == 0, 0).otherwise(1)).alias("source"), F.when(C("actor_id") % 17 == 0, 1).alias("destination"), "several")
    # who has several teams in a season must not carry a feature of the destination
    return quality.rule_violations(f, ["actor_id", "season"], {"as_of": C("as_of") != C("season") - 1, "source": C("source") >= C("season"), "destination": C("several") & C("destination").isNotNull()})


@query("I03_arithmetic_reconcile", "SELECT season, team_id, 'sum' AS rule FROM team_seasons WHERE abs(value - (value // 2) - (value - value // 2 + CASE WHEN team_id = 7 THEN 1 ELSE 0 END)) > 0.5")
def _(t):
    half = F.expr("floor(value / 2)")
    rows = t.team_seasons.select("season", "team_id", "value", half.alias("a"), (C("value") - half + F.when(C("team_id") == 7, 1).otherwise(0)).alias("b"))
    return quality.rule_violations(rows, ["season", "team_id"], {"sum": F.abs(C("value") - C("a") - C("b")) > 0.5})


@query("I04_exposure_validation", f"""WITH {ATTR}, e AS (SELECT j.interval_id, actor_id, j.week, i.start_week, i.end_week - CASE WHEN j.owner_id % 7 = 0 THEN 2 ELSE 0 END AS claimed_end, j.season, j.season + CASE WHEN j.owner_id % 13 = 0 THEN 1 ELSE 0 END AS source, k, CASE WHEN j.owner_id % 11 = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / k END AS weight, count(*) OVER (PARTITION BY j.owner_id, actor_id, j.season, j.week) AS same FROM j JOIN intervals i USING (interval_id))
SELECT interval_id, actor_id, week, unnest(list_filter([CASE WHEN week < start_week OR week > claimed_end THEN 'outside' END, CASE WHEN abs(weight * k - 1) > 1e-9 THEN 'arithmetic' END, CASE WHEN same > 1 THEN 'repeated' END, CASE WHEN source > season THEN 'future' END], lambda x: x IS NOT NULL)) AS rule FROM e""")
def _(t):
    own = C("owner_id")
    i = assigned(t)
    # the rules speak of an interval and a week: they are judged there, and only what violates one meets the actors of the week
    e = i.withColumn("week", F.explode(F.sequence("start_week", "end_week"))).join(owner_weeks(i), [*PLACE, "owner_id", "week"])
    e = e.select("interval_id", *PLACE, "week", "start_week", "k", C("c").alias("same"), (C("end_week") - F.when(own % 7 == 0, 2).otherwise(0)).alias("claimed_end"), (C("season") + F.when(own % 13 == 0, 1).otherwise(0)).alias("source"), F.when(own % 11 == 0, F.lit(1.0)).otherwise(1.0 / C("k")).alias("weight"))
    found = quality.rule_violations(e, ["interval_id", *PLACE, "week"], {"outside": ~C("week").between(C("start_week"), C("claimed_end")), "arithmetic": F.abs(C("weight") * C("k") - 1) > 1e-9, "repeated": C("same") > 1, "future": C("source") > C("season")})
    # a place and week has few plays of one actor in a task: they are dealt as they are, and the actors told apart where they meet what was found
    actors = intervals.dealt(t.plays.select(*PLACE, "week", "actor_id"), [*PLACE, "week"]).distinct()
    return actors.join(intervals.dealt(found, [*PLACE, "week"]), [*PLACE, "week"]).select("interval_id", "actor_id", "week", "rule")


@query("I05_feature_record_validation", f"""WITH {bound.RECORDS}, reg AS (SELECT 'rate' AS feature, 'preseason' AS timing, 1 AS lag, 3 AS span, true AS allowed, false AS nullable UNION ALL SELECT 'share', 'season_end', 2, 2, false, true),
r AS (SELECT *, CASE WHEN actor_id % 29 = 0 THEN 'in_season' ELSE 'preseason' END AS timing_used, CASE WHEN actor_id % 31 = 0 THEN NULL ELSE source END AS lineage, target - source + CASE WHEN actor_id % 37 = 0 THEN 3 ELSE 0 END AS reach FROM recs)
SELECT actor_id, target, feature, unnest(list_filter([CASE WHEN timing_used <> timing THEN 'timing_class' END, CASE WHEN target - source <> lag THEN 'wrong_lag' END, CASE WHEN reach > span THEN 'outside_window' END, CASE WHEN NOT allowed THEN 'not_permitted' END, CASE WHEN lineage IS NULL THEN 'no_lineage' END, CASE WHEN value IS NULL AND NOT nullable THEN 'missing_value' END], lambda x: x IS NOT NULL)) AS rule FROM r JOIN reg USING (feature)""")
def _(t):
    reg = t.spark.createDataFrame([("rate", "preseason", 1, 3, True, False), ("share", "season_end", 2, 2, False, True)], "feature string, timing string, lag int, span int, allowed boolean, nullable boolean")
    a = C("actor_id")
    rows = bound.records(t).join(F.broadcast(reg), "feature").select("*", F.when(a % 29 == 0, "in_season").otherwise("preseason").alias("timing_used"), F.when(a % 31 != 0, C("source")).alias("lineage"), (C("target") - C("source") + F.when(a % 37 == 0, 3).otherwise(0)).alias("reach"))
    return quality.rule_violations(rows, ["actor_id", "target", "feature"], {"timing_class": C("timing_used") != C("timing"), "wrong_lag": C("target") - C("source") != C("lag"), "outside_window": C("reach") > C("span"), "not_permitted": ~C("allowed"), "no_lineage": C("lineage").isNull(), "missing_value": C("value").isNull() & ~C("nullable")})


@query("I06_leakage_audit", f"WITH {bound.RECORDS} SELECT target, count(*) AS row_count, count(DISTINCT actor_id) AS entities, min(source) AS first_source, max(source) AS last_source, count(*) FILTER (WHERE source >= target) AS illegal, true AS passed FROM recs GROUP BY 1")
def _(t):
    return quality.leakage_audit(bound.records(t), "target", "source", "actor_id")


GATES = {"null_key": "actor_id IS NULL OR season IS NULL", "volume": "volume < 1000", "rates": "attempts > plays OR successes > plays", "value_range": "abs(value) > 100000 * plays", "no_team": "team_id IS NULL", "thin": "plays < 30", "one_sided": "attempts = 0 OR attempts = plays", "repeated_key": "n > 1"}


@query("I07_cohort_gates", "WITH r AS (SELECT *, count(*) OVER (PARTITION BY actor_id, season) AS n FROM actor_seasons) SELECT gate, failures, failures = 0 AS passed FROM (" + " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER (WHERE {c}) AS failures FROM r" for g, c in GATES.items()) + ")")
def _(t):
    rows = win.group_count(t.actor_seasons, ["actor_id", "season"], "n")
    return quality.gates(rows, {g: F.expr(c) for g, c in GATES.items()})


@query("I08_verified_needs_source", "SELECT interval_id FROM intervals WHERE status = 'verified' AND interval_id NOT IN (SELECT interval_id FROM intervals WHERE start_week % 2 = 0)")
def _(t):
    sources = t.intervals.where("start_week % 2 = 0").select("interval_id")
    return quality.orphans(t.intervals.where("status = 'verified'").select("interval_id"), sources, ["interval_id"])


@query("I09_child_parent_lineage", """
WITH c AS (SELECT interval_id, team_id + CASE WHEN start_week = 3 THEN 1 ELSE 0 END AS team, start_week - CASE WHEN role = 2 THEN 1 ELSE 0 END AS s, end_week AS e FROM intervals WHERE season >= 1999),
p AS (SELECT * FROM intervals WHERE season <= 2000)
SELECT c.interval_id, unnest(list_filter([CASE WHEN p.interval_id IS NULL THEN 'no_parent' END, CASE WHEN c.s < p.start_week OR c.e > p.end_week THEN 'outside' END, CASE WHEN c.team <> p.team_id THEN 'team_differs' END], lambda x: x IS NOT NULL)) AS rule FROM c LEFT JOIN p USING (interval_id)""")
def _(t):
    child = t.intervals.where("season >= 1999").select("interval_id", (C("team_id") + F.when(C("start_week") == 3, 1).otherwise(0)).alias("team"), (C("start_week") - F.when(C("role") == 2, 1).otherwise(0)).alias("s"), C("end_week").alias("e"))
    rules = {"outside": (C("s") < C("p_start_week")) | (C("e") > C("p_end_week")), "team_differs": C("team") != C("p_team_id")}
    return quality.lineage_violations(child, t.intervals.where("season <= 2000"), ["interval_id"], rules, ["interval_id"])


@query("I10_stint_lineage", """
SELECT i.interval_id, unnest(list_filter([CASE WHEN ts.plays IS NULL THEN 'no_parent' END, CASE WHEN ts.plays < 330 THEN 'thin' END], lambda x: x IS NOT NULL)) AS rule FROM intervals i LEFT JOIN team_seasons ts ON i.season = ts.season AND i.team_id = ts.team_id""")
def _(t):
    return quality.lineage_violations(t.intervals, t.team_seasons.select("season", "team_id", "plays"), ["season", "team_id"], {"thin": C("p_plays") < 330}, ["interval_id"])


@query("I11_exposure_lineage", """
WITH e AS (SELECT interval_id, owner_id, CASE WHEN end_week = 9 THEN NULL ELSE role END AS role FROM intervals)
SELECT e.interval_id, 'role_differs' AS rule FROM e JOIN intervals i USING (interval_id) WHERE e.role IS DISTINCT FROM i.role""")
def _(t):
    e = t.intervals.select("interval_id", "owner_id", F.when(C("end_week") != 9, C("role")).alias("role"))
    return quality.lineage_violations(e, t.intervals.select("interval_id", "owner_id", "role"), ["interval_id"], {"owner_differs": ~C("owner_id").eqNullSafe(C("p_owner_id")), "role_differs": ~C("role").eqNullSafe(C("p_role"))}, ["interval_id"])


@query("I12_prediction_timing", "SELECT actor_id, season FROM actor_seasons WHERE actor_id % 31 = 0")
def _(t):
    as_of = t.actor_seasons.select("actor_id", "season", (C("season") - F.when(C("actor_id") % 31 == 0, 0).otherwise(1)).alias("as_of"))
    return quality.rule_violations(as_of, ["actor_id", "season"], {"late": C("as_of") >= C("season")}).select("actor_id", "season")


@query("I13_table_checks", "SELECT season, team_id, unnest(list_filter([CASE WHEN attempts > plays THEN 'attempts' END, CASE WHEN successes::DOUBLE / plays NOT BETWEEN 0 AND 0.5 THEN 'rate' END], lambda x: x IS NOT NULL)) AS rule FROM team_seasons")
def _(t):
    return quality.rule_violations(t.team_seasons, ["season", "team_id"], {"attempts": C("attempts") > C("plays"), "rate": ~(C("successes") / C("plays")).between(0, 0.5)})


@query("I14_contract_keys", """
SELECT 'plays' AS table_name, '' AS missing, CAST(0 AS BIGINT) AS null_keys, (SELECT count(*) FROM (SELECT 1 FROM plays GROUP BY game_id, play_id HAVING count(*) > 1)) AS repeated_keys UNION ALL SELECT 'games', 'stadium', 0, 0 UNION ALL SELECT 'nation', '', 0, 0""")
def _(t):
    return quality.contract_keys({"plays": (t.plays, ["value"], ["game_id", "play_id"]), "games": (t.games, ["season", "stadium"], ["game_id"]), "nation": (t.raw("nation"), ["n_name"], ["n_nationkey"])})


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("I15_manual_data_validation", f"""
WITH ids AS (SELECT n_name AS name, CASE WHEN n_nationkey % 6 = 0 THEN n_name ELSE {_SLUG.format('n_name')} END AS id, CASE WHEN n_nationkey % 8 < 2 THEN 'shared alias' ELSE 'alias ' || n_nationkey END AS alias FROM nation)
SELECT 'identity' AS part, id AS key, 'not_a_slug' AS rule FROM ids WHERE id <> {_SLUG.format('name')} UNION ALL SELECT 'alias', alias, 'repeated' FROM ids GROUP BY alias HAVING count(DISTINCT id) > 1
UNION ALL SELECT 'source', page_id::VARCHAR, unnest(list_filter([CASE WHEN NOT regexp_matches(url, '^https://') THEN 'not_https' END, CASE WHEN contains(url, '#') THEN 'has_fragment' END, CASE WHEN regexp_matches(url, 'ref=') THEN 'has_tracking' END], lambda x: x IS NOT NULL)) FROM pages
UNION ALL SELECT 'role', season || '|' || n_nationkey || '|' || role, 'uncovered' FROM seasons CROSS JOIN nation CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS role) WHERE (season, n_nationkey, role) NOT IN (SELECT (season, team_id, role) FROM intervals)
UNION ALL SELECT 'interval', interval_id, unnest(list_filter([CASE WHEN end_week > 11 THEN 'out_of_range' END, CASE WHEN end_week < start_week THEN 'reversed' END, CASE WHEN status = 'unresolved' AND shared THEN 'open_review' END], lambda x: x IS NOT NULL)) FROM intervals""")
def _(t):
    from ..functions.rates import slug

    k = C("n_nationkey")
    ids = t.raw("nation").select(C("n_name").alias("name"), F.when(k % 6 == 0, C("n_name")).otherwise(slug(C("n_name"))).alias("id"), F.when(k % 8 < 2, "shared alias").otherwise(F.concat(F.lit("alias "), k)).alias("alias"))
    part = lambda df, name, key: df.select(F.lit(name).alias("part"), F.col(key).alias("key"), "rule")
    u = C("url")
    roles = t.seasons.crossJoin(F.broadcast(t.raw("nation").select(k.alias("team_id")))).withColumn("role", F.explode(F.array(*map(F.lit, range(4)))))
    bare = quality.orphans(roles, t.intervals, ["season", "team_id", "role"]).select(F.concat_ws("|", "season", "team_id", "role").alias("key"), F.lit("uncovered").alias("rule"))
    out = [
        part(quality.rule_violations(ids, ["id"], {"not_a_slug": C("id") != slug(C("name"))}), "identity", "id"),
        part(ids.groupBy("alias").agg(F.count_distinct("id").alias("n")).where("n > 1").withColumn("rule", F.lit("repeated")), "alias", "alias"),
        part(quality.rule_violations(t.raw("pages").withColumn("page_id", C("page_id").cast("string")), ["page_id"], {"not_https": ~u.rlike("^https://"), "has_fragment": F.contains(u, F.lit("#")), "has_tracking": u.rlike("ref=")}), "source", "page_id"),
        part(bare, "role", "key"),
        part(quality.rule_violations(t.intervals, ["interval_id"], {"out_of_range": C("end_week") > 11, "reversed": C("end_week") < C("start_week"), "open_review": (C("status") == "unresolved") & C("shared")}), "interval", "interval_id"),
    ]
    return reshape.union_vertical(out, {"part": "string", "key": "string", "rule": "string"})


@query("I16_temporary_role_inference", """
WITH o AS (SELECT team_id, role, season, min(owner_id) AS op FROM intervals WHERE start_week = 1 GROUP BY 1, 2, 3), f AS (SELECT team_id, role, season, min(start_week) AS fs FROM intervals GROUP BY 1, 2, 3)
SELECT interval_id, coalesce(start_week > 1 AND fs < start_week AND end_week >= 8 AND op IS NOT NULL AND op <> owner_id, false) AS temporary FROM intervals i LEFT JOIN f USING (team_id, role, season) LEFT JOIN o ON o.team_id = i.team_id AND o.role = i.role AND o.season = i.season + 1""")
def _(t):
    return quality.temporary_roles(t.intervals, ["team_id", "role"], "season", "owner_id", "start_week", "end_week", 1, 8).select("interval_id", "temporary")


@query("I17_grain_audit", """
WITH r AS (SELECT season, team_id, count(*) AS n FROM intervals WHERE role = 1 GROUP BY 1, 2), c AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
SELECT 'owners' AS stage, count(*) AS input_rows, count(n) AS matched, count(*) - count(n) AS unmatched, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS multiplied FROM team_seasons LEFT JOIN r USING (season, team_id)
UNION ALL SELECT 'customers', count(*), count(c_custkey), count(*) - count(c_custkey), 0 FROM orders LEFT JOIN c ON o_custkey = c_custkey""")
def _(t):
    c = t.raw("customer").where("c_acctbal >= 0").select(C("c_custkey").alias("o_custkey"))
    return quality.grain_audit([("owners", t.team_seasons, t.intervals.where("role = 1"), ["season", "team_id"]), ("customers", t.raw("orders"), c, ["o_custkey"])])


