"""Queries of families L (serving) and M (evidence lookups)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as win
from ..operators.intervals import overlap_links
from ..sources.shared import cut
from . import aggs as bound
from .registry import query
from .states import PAE, season_pae
from .stats import coh

C = F.col

VIEW = f"""{bound.SEASON}, view AS (SELECT sm.season, sm.actor_id, s_name AS actor_name, n_name AS team_name, sm.team_id, sm.attempts, sm.volume, sm.value, qualifies FROM sm JOIN supplier ON actor_id = s_suppkey JOIN nation ON team_id = n_nationkey WHERE season >= 1996)"""


def view(t):
    s = t.raw("supplier").select(C("s_suppkey").alias("actor_id"), C("s_name").alias("actor_name"))
    n = t.raw("nation").select(C("n_nationkey").alias("team_id"), C("n_name").alias("team_name"))
    m = bound.season_metrics(t).where("season >= 1996")
    return m.join(s, "actor_id").join(F.broadcast(n), "team_id").select("season", "actor_id", "actor_name", "team_name", "team_id", "attempts", "volume", "value", "qualifies")


@query("L01_statistics_view", f"WITH {VIEW} SELECT * FROM view")
def _(t):
    return view(t)


#: Orderings of the list of entities; each ends in a unique key.
ORDERS = {
    "name": "actor_name, season DESC, team_id, actor_id", "season": "season DESC, actor_name, team_id, actor_id", "team": "team_name, season DESC, actor_name, actor_id",
    **{c: f"{e} DESC NULLS LAST, actor_name, season DESC, team_id, actor_id" for c, e in {"attempts": "attempts", "volume": "volume", "value": "value", "rate": "rate", "attempt_value": "attempt_value", "eligible": "qualifies"}.items()},
}
_LISTED = "CASE WHEN volume > 0 THEN round(value::DOUBLE / volume, 8) END AS rate, CASE WHEN attempts > 0 THEN round(value::DOUBLE / attempts, 6) END AS attempt_value"


def list_entities(rows, search=None, team_id=None, season=None, eligible=None, sort="name", limit=50, offset=0):
    """One page of the entities that meet the filters which are given, in one of ORDERS, with the total. rows: of view()."""
    if sort not in ORDERS:
        raise ValueError(f"sort is one of {sorted(ORDERS)}")
    ok = F.lit(True)
    for given, test in ((search, C("actor_name").ilike(f"%{search}%")), (team_id, C("team_id") == team_id), (season, C("season") == season), (eligible, C("qualifies") == eligible)):
        ok = ok & test if given is not None else ok
    rate = rows.withColumn("rate", F.when(C("volume") > 0, F.round(C("value") / C("volume"), 8))).withColumn("attempt_value", F.when(C("attempts") > 0, F.round(C("value") / C("attempts"), 6)))
    keys = [(C(x.split()[0]), "DESC" in x) for x in ORDERS[sort].split(", ")]
    return win.page(rate, ok, [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in keys], limit, offset)


@query("L02_list_entities", f"WITH {VIEW}, v AS (SELECT *, {_LISTED} FROM view), r AS (SELECT * FROM v WHERE actor_name ILIKE '%0000000%' AND season = 1999 AND qualifies), "
       + "o AS (" + " UNION ALL ".join(f"SELECT '{n}' AS sort, actor_id, actor_name, season, team_id, rate, row_number() OVER (ORDER BY {o}) AS place FROM {'v' if n == 'name' else 'r'}{' WHERE team_id = 3' if n == 'name' else ''}" for n, o in ORDERS.items()) + ")"
       + " SELECT *, CASE sort WHEN 'name' THEN (SELECT count(*) FROM v WHERE team_id = 3) ELSE (SELECT count(*) FROM r) END AS total FROM o WHERE place BETWEEN 6 AND 25")
def _(t):
    from functools import reduce

    rows = cut(view(t), "entities")
    pages = []
    for sort in ORDERS:
        got = list_entities(rows, team_id=3, sort=sort, limit=20, offset=5) if sort == "name" else list_entities(rows, search="0000000", season=1999, eligible=True, sort=sort, limit=20, offset=5)
        order = [C(x.split()[0]).desc_nulls_last() if "DESC" in x else C(x.split()[0]).asc_nulls_last() for x in ORDERS[sort].split(", ")]
        pages.append(got.withColumn("place", (F.row_number().over(Window.orderBy(*order)) + 5).cast("long")).select(F.lit(sort).alias("sort"), "actor_id", "actor_name", "season", "team_id", "rate", "place", "total"))  # a page
    return reduce(lambda a, b: a.unionByName(b), pages)


@query("L03_entity_profile", f"WITH {VIEW} SELECT season, team_name, attempts, value FROM view WHERE actor_id = 7")
def _(t):
    return view(t).where("actor_id = 7").select("season", "team_name", "attempts", "value").orderBy("season")


@query("L04_pae_history", f"WITH {PAE} SELECT pae.season, s_name AS actor_name, round(actual, 4) AS actual, round(expected, 3) AS expected, round(pae, 3) AS pae, weight, model_var IS NOT NULL AS has_variance FROM pae JOIN supplier ON s_suppkey = actor_id WHERE actor_id = 7")
def _(t):
    own = season_pae(t).where("actor_id = 7")
    name = t.raw("supplier").select(C("s_suppkey").alias("actor_id"), C("s_name").alias("actor_name"))
    return own.join(name, "actor_id").select("season", "actor_name", F.round("actual", 4).alias("actual"), F.round("expected", 3).alias("expected"), F.round("pae", 3).alias("pae"), "weight", C("model_var").isNotNull().alias("has_variance")).orderBy("season")


@query("L05_list_owners", "SELECT DISTINCT owner_id, role FROM intervals WHERE ('owner-' || owner_id) ILIKE '%1%' ORDER BY 1, 2")
def _(t):
    return t.intervals.where(F.concat(F.lit("owner-"), "owner_id").ilike("%1%")).select("owner_id", "role").distinct()


EFFECT = "eff AS (SELECT owner_id, role, CAST(sum(end_week - start_week + 1) AS BIGINT) AS exposure, count(DISTINCT team_id) AS teams FROM intervals GROUP BY 1, 2)"


@query("L06_owner_impact", f"""WITH {PAE}, {EFFECT}, w AS (SELECT i.owner_id, i.role, sum(pae * weight) / sum(weight) AS effect, count(*) AS n FROM intervals i JOIN coh c ON c.team_id = i.team_id AND c.season = i.season JOIN pae ON pae.actor_id = c.actor_id AND pae.season = c.season GROUP BY 1, 2), x AS (SELECT eff.owner_id, eff.role, exposure, teams, round(effect, 4) AS effect, n FROM eff LEFT JOIN w USING (owner_id, role) WHERE exposure >= 60)
SELECT *, dense_rank() OVER (PARTITION BY role ORDER BY exposure DESC) AS by_exposure, CASE WHEN effect IS NOT NULL THEN dense_rank() OVER (PARTITION BY role ORDER BY effect DESC NULLS LAST) END AS by_effect, dense_rank() OVER (PARTITION BY role ORDER BY teams DESC) AS by_teams FROM x""")
def _(t):
    e = t.intervals.groupBy("owner_id", "role").agg(F.sum(C("end_week") - C("start_week") + 1).alias("exposure"), F.count_distinct("team_id").alias("teams")).where("exposure >= 60")
    p = season_pae(t).join(coh(t).select("actor_id", "season", "team_id"), ["actor_id", "season"])
    # a row a team-season carries what its owners share
    sums = p.groupBy("team_id", "season").agg(F.sum(C("pae") * C("weight")).alias("v"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("k"))
    effect = t.intervals.join(sums, ["team_id", "season"]).groupBy("owner_id", "role").agg(F.round(F.sum("v") / F.sum("w"), 4).alias("effect"), F.sum("k").alias("n"))
    out = e.join(effect, ["owner_id", "role"], "left")
    for measure in ("exposure", "effect", "teams"):
        out = win.dense_rank_eligible(out, ["role"], measure, C(measure).isNotNull(), f"by_{measure}")
    return out


@query("L07_team_season_list", "SELECT season, team_id, plays, value FROM team_seasons WHERE season BETWEEN 1997 AND 1999 AND plays > 200")
def _(t):
    return t.team_seasons.where("season BETWEEN 1997 AND 1999 AND plays > 200").select("season", "team_id", "plays", "value").orderBy("season", F.desc("value"), "team_id")


@query("L08_assignment_list", "SELECT interval_id, owner_id, start_week FROM intervals WHERE season = 1998 AND role = 2 AND status = 'verified'")
def _(t):
    return t.intervals.where("season = 1998 AND role = 2 AND status = 'verified'").select("interval_id", "owner_id", "start_week")


@query("L09_completeness_list", "SELECT season, team_id, role, count(*) AS n FROM intervals WHERE status IN ('verified', 'supported') GROUP BY 1, 2, 3")
def _(t):
    known = {"complete": ["verified", "supported"]}  # an older synonym of two statuses
    return t.intervals.where(C("status").isin(known["complete"])).groupBy("season", "team_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("L10_environment_list", "SELECT season, team_id, tax, discount FROM team_seasons WHERE season >= 1998 AND season < 2001")
def _(t):
    return t.team_seasons.where("season >= 1998 AND season < 2001").select("season", "team_id", "tax", "discount")


@query("L11_network_edges", "SELECT a.season, a.team_id, a.owner_id AS a, b.owner_id AS b, count(*) AS links FROM intervals a JOIN intervals b ON a.season = b.season AND a.team_id = b.team_id AND a.owner_id < b.owner_id AND a.start_week <= b.end_week AND b.start_week <= a.end_week GROUP BY 1, 2, 3, 4")
def _(t):
    return overlap_links(t.intervals, ["season", "team_id"], "owner_id", "start_week", "end_week", {"links": F.lit(True)})


#: Edges that a source node shows at most, the first by name; n_edges has how many there are.
MOST_EDGES = 25
_TEAM = "'team:' || team_id || ':' || season"
EDGES = f"""own AS (SELECT 'owner:' || owner_id AS src, {_TEAM} AS dst, 'owns' AS kind, count(*) AS weight, avg((status = 'verified')::INT) AS complete, owner_id AS cited FROM intervals GROUP BY ALL),
act AS (SELECT 'actor:' || actor_id AS src, {_TEAM} AS dst, 'plays_for' AS kind, plays AS weight, 1.0::DOUBLE AS complete, actor_id AS cited FROM actor_seasons),
pair AS (SELECT 'owner:' || a.owner_id AS src, 'owner:' || b.owner_id AS dst, 'works_with' AS kind, count(*) AS weight, avg((a.status = 'verified' AND b.status = 'verified')::INT) AS complete, a.owner_id AS cited FROM intervals a JOIN intervals b ON a.season = b.season AND a.team_id = b.team_id AND a.owner_id < b.owner_id AND a.start_week <= b.end_week AND b.start_week <= a.end_week GROUP BY ALL),
met AS (SELECT 'team:' || team_id || ':' || season AS src, 'team:' || opponent_id || ':' || season AS dst, 'meets' AS kind, count(*) AS weight, 1.0::DOUBLE AS complete, CAST(team_id AS BIGINT) AS cited FROM plays GROUP BY ALL),
every AS (SELECT 'owner' AS mode, * FROM own UNION ALL SELECT 'actor', * FROM act UNION ALL SELECT 'network', * FROM pair UNION ALL SELECT 'schedule', * FROM met),
edges AS (SELECT e.*, coalesce(c.n, 0) AS citations, row_number() OVER (PARTITION BY mode, src ORDER BY dst) AS k, count(*) OVER (PARTITION BY mode, src) AS n_edges FROM every e LEFT JOIN (SELECT page_id, count(*) AS n FROM pages GROUP BY 1) c ON c.page_id = cited)"""


def edges(t):
    """Edges of four modes (owners of teams, actors of teams, owners who work together, teams that meet) with weight, completeness and
    citations; of each source node the first MOST_EDGES, with how many it has."""
    node = lambda kind, *cols: F.concat_ws(":", F.lit(kind), *cols)
    n, one = F.count(F.lit(1)).alias("weight"), F.lit(1.0).alias("complete")
    verified = lambda c: F.avg(c.cast("int")).alias("complete")
    own = t.intervals.groupBy("owner_id", "team_id", "season").agg(n, verified(C("status") == "verified")).select(F.lit("owner").alias("mode"), node("owner", "owner_id").alias("src"), node("team", "team_id", "season").alias("dst"), F.lit("owns").alias("kind"), "weight", "complete", C("owner_id").alias("cited"))
    act = t.actor_seasons.select(F.lit("actor").alias("mode"), node("actor", "actor_id").alias("src"), node("team", "team_id", "season").alias("dst"), F.lit("plays_for").alias("kind"), C("plays").alias("weight"), one, C("actor_id").alias("cited"))
    p = overlap_links(t.intervals, ["season", "team_id"], "owner_id", "start_week", "end_week", {"links": F.lit(True), "verified": C("status") == "verified"})
    pair = p.groupBy("a", "b").agg(F.sum("links").alias("weight"), (F.sum("verified") / F.sum("links")).alias("complete")).select(F.lit("network").alias("mode"), node("owner", "a").alias("src"), node("owner", "b").alias("dst"), F.lit("works_with").alias("kind"), "weight", "complete", C("a").alias("cited"))
    met = t.plays.groupBy("team_id", "opponent_id", "season").agg(n).select(F.lit("schedule").alias("mode"), node("team", "team_id", "season").alias("src"), node("team", "opponent_id", "season").alias("dst"), F.lit("meets").alias("kind"), "weight", one, C("team_id").cast("long").alias("cited"))
    pages = t.raw("pages").groupBy(C("page_id").alias("cited")).agg(F.count(F.lit(1)).alias("citations"))
    every = cut(own.unionByName(act).unionByName(pair).unionByName(met), "edges").join(pages, "cited", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    counts = every.groupBy("mode", "src").agg(F.count(F.lit(1)).alias("n_edges"))
    return win.top_per_group(every, ["mode", "src"], [F.asc("dst")], MOST_EDGES).join(counts, ["mode", "src"])


@query("L12_relationship_graph", f"WITH {EDGES}, kept AS (SELECT * FROM edges WHERE k <= {MOST_EDGES}), nodes AS (SELECT mode, src AS node FROM kept UNION SELECT mode, dst FROM kept) SELECT 'edge' AS part, mode, src AS a, dst AS b, kind, weight, round(complete, 6) AS complete, citations, n_edges FROM kept UNION ALL SELECT 'node', mode, node, '', split_part(node, ':', 1), NULL, NULL, NULL, NULL FROM nodes")
def _(t):
    e = cut(edges(t), "edges")
    nodes = e.select("mode", F.explode(F.array("src", "dst")).alias("a")).distinct().select(F.lit("node").alias("part"), "mode", "a", F.lit("").alias("b"), F.split_part("a", F.lit(":"), F.lit(1)).alias("kind"))
    rows = e.select(F.lit("edge").alias("part"), "mode", C("src").alias("a"), C("dst").alias("b"), "kind", "weight", F.round("complete", 6).alias("complete"), "citations", "n_edges")
    return rows.unionByName(nodes, allowMissingColumns=True)


@query("L13_graph_appearances", "WITH a AS (SELECT DISTINCT owner_id, season, CAST(role AS INT) AS role FROM intervals) SELECT owner_id, role, season, lead(season) OVER w AS next_season, coalesce(lead(season) OVER w = season + 1, false) AS continuous FROM a WINDOW w AS (PARTITION BY owner_id, role ORDER BY season)")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("owner_id", "role").orderBy("season")
    a = t.intervals.select("owner_id", "role", "season").distinct()
    return a.withColumn("next_season", F.lead("season").over(w)).withColumn("continuous", F.coalesce(C("next_season") == C("season") + 1, F.lit(False)))


@query("L14_citations_list", "SELECT interval_id, page_id, url FROM intervals JOIN pages ON page_id = owner_id")
def _(t):
    p = t.raw("pages").select(C("page_id").alias("owner_id"), "url")
    return t.intervals.join(p, "owner_id").select("interval_id", C("owner_id").alias("page_id"), "url")


@query("L15_owner_rankings_view", f"WITH {EFFECT} SELECT owner_id, role, CASE WHEN teams >= 2 THEN dense_rank() OVER (PARTITION BY role, teams >= 2 ORDER BY exposure DESC) END AS rank FROM eff")
def _(t):
    e = t.intervals.groupBy("owner_id", "role").agg(F.sum(C("end_week") - C("start_week") + 1).alias("exposure"), F.count_distinct("team_id").alias("teams"))
    return win.dense_rank_eligible(e, ["role"], "exposure", C("teams") >= 2).select("owner_id", "role", "rank")


@query("M02_evidence_history", "SELECT season, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 5) AS se FROM plays WHERE actor_id = 11 GROUP BY 1")
def _(t):
    n = F.count(F.lit(1))
    return t.plays.where("actor_id = 11").groupBy("season").agg(n.alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value") / F.sqrt(n), 5).alias("se"))


@query("M03_best_or_recent_context", "WITH b AS (SELECT season, team_id, value FROM actor_seasons WHERE actor_id = 11 ORDER BY value DESC, season DESC LIMIT 3) SELECT b.season, b.value, interval_id, owner_id FROM b JOIN intervals i USING (season, team_id)")
def _(t):
    best = win.top_per_group(t.actor_seasons.where("actor_id = 11"), ["actor_id"], [F.desc("value"), F.desc("season")], 3).select("season", "team_id", "value")
    return t.intervals.join(F.broadcast(best), ["season", "team_id"]).select("season", "value", "interval_id", "owner_id")


@query("M04_owner_context_summary", "SELECT owner_id, count(DISTINCT (p.actor_id, p.team_id, p.season)) AS contexts, count(DISTINCT CASE WHEN p.actor_id % 2 = 0 THEN (p.actor_id, p.team_id, p.season) END) AS kept FROM intervals i JOIN actor_seasons p USING (season, team_id) GROUP BY 1")
def _(t):
    j = t.intervals.select("owner_id", "season", "team_id").distinct().join(t.actor_seasons.select("season", "team_id", "actor_id"), ["season", "team_id"])
    s = F.struct("actor_id", "team_id", "season")
    return j.groupBy("owner_id").agg(F.count_distinct(s).alias("contexts"), F.count_distinct(F.when(C("actor_id") % 2 == 0, s)).alias("kept"))


@query("M05_compare_entities", """
WITH m AS (SELECT actor_id, unnest(['attempts', 'plays', 'value']) AS metric, unnest([attempts, plays, value]) AS v FROM actor_seasons WHERE season = 1999 AND actor_id IN (3, 8))
SELECT metric, a.v AS first_value, b.v AS second_value, a.v - b.v AS difference FROM m a JOIN m b USING (metric) WHERE a.actor_id = 3 AND b.actor_id = 8""")
def _(t):
    m = t.actor_seasons.where("season = 1999 AND actor_id IN (3, 8)").unpivot(["actor_id"], ["attempts", "plays", "value"], "metric", "v")
    wide = m.groupBy("metric").pivot("actor_id", [3, 8]).agg(F.max("v")).where("`3` IS NOT NULL AND `8` IS NOT NULL")
    return wide.select("metric", C("3").alias("first_value"), C("8").alias("second_value"), (C("3") - C("8")).alias("difference"))


@query("M06_compare_teams", """
WITH m AS (SELECT team_id, unnest(['attempts', 'plays', 'tax']) AS feature, unnest([attempts, plays, tax]) AS v FROM team_seasons WHERE season = 1998 AND team_id IN (2, 9))
SELECT feature, a.v AS first_value, b.v AS second_value FROM m a JOIN m b USING (feature) WHERE a.team_id = 2 AND b.team_id = 9""")
def _(t):
    m = t.team_seasons.where("season = 1998 AND team_id IN (2, 9)").unpivot(["team_id"], ["attempts", "plays", "tax"], "feature", "v")
    wide = m.groupBy("feature").pivot("team_id", [2, 9]).agg(F.max("v")).where("`2` IS NOT NULL AND `9` IS NOT NULL")
    return wide.select("feature", C("2").alias("first_value"), C("9").alias("second_value"))


@query("M07_descriptive_alignment", """
WITH a AS (SELECT season, team_id, actor_id, 'rate' AS af, attempts AS av FROM actor_seasons WHERE actor_id = 5 UNION ALL SELECT season, team_id, actor_id, 'count', plays FROM actor_seasons WHERE actor_id = 5), t AS (SELECT season, team_id, 'team_rate' AS tf, attempts AS tv FROM team_seasons UNION ALL SELECT season, team_id, 'team_tax', tax FROM team_seasons),
m AS (SELECT unnest(['rate', 'count']) AS af, unnest(['team_rate', 'team_tax']) AS tf) SELECT season, af, tf, av, tv FROM a JOIN m USING (af) JOIN t USING (season, team_id, tf)""")
def _(t):
    a = t.actor_seasons.where("actor_id = 5").select("season", "team_id", F.explode(F.array(*(F.struct(F.lit(n).alias("af"), C(c).alias("av")) for n, c in (("rate", "attempts"), ("count", "plays"))))).alias("x")).select("season", "team_id", "x.*")
    s = t.team_seasons.select("season", "team_id", F.explode(F.array(*(F.struct(F.lit(n).alias("tf"), C(c).cast("long").alias("tv")) for n, c in (("team_rate", "attempts"), ("team_tax", "tax"))))).alias("x")).select("season", "team_id", "x.*")
    m = t.spark.createDataFrame([("rate", "team_rate"), ("count", "team_tax")], "af string, tf string")
    return a.join(F.broadcast(m), "af").join(s, ["season", "team_id", "tf"]).select("season", "af", "tf", "av", "tv")


@query("M08_bounded_package", """
WITH e AS (SELECT user_id, min(event_id) AS priority, count(*) AS n FROM events GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY priority, user_id) AS r FROM e)
SELECT user_id, priority, NULL::BIGINT AS omitted FROM k WHERE r <= 31 UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM k WHERE r > 31)""")
def _(t):
    e = t.raw("events").groupBy("user_id").agg(F.min("event_id").alias("priority"))
    kept = e.orderBy("priority", "user_id").limit(31)
    none = F.lit(None).cast("long")
    rest = e.agg(F.greatest(F.count(F.lit(1)) - 31, F.lit(0)).alias("omitted")).select(none.alias("user_id"), none.alias("priority"), "omitted")
    return kept.withColumn("omitted", none).unionByName(rest)


@query("M09_evidence_id", "SELECT interval_id, substr(sha256('{\"owner\":' || owner_id || ',\"role\":' || role || ',\"season\":' || season || '}'), 1, 16) AS evidence_id FROM intervals")
def _(t):
    return t.intervals.select("interval_id", F.substring(F.sha2(F.to_json(F.struct(C("owner_id").alias("owner"), "role", "season")), 256), 1, 16).alias("evidence_id"))


@query("N01_struct_udf", "SELECT p_partkey, p_size % 4 AS te, 2 AS wr FROM part")
def _(t):
    from ..operators.keys import personnel

    text = F.concat((C("p_size") % 3).cast("string"), F.lit(" RB, "), (C("p_size") % 4).cast("string"), F.lit(" TE, 2 WR"))
    return t.raw("part").select("p_partkey", text.alias("s")).select("p_partkey", personnel("s").alias("x")).select("p_partkey", "x.te", "x.wr")
