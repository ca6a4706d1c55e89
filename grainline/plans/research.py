"""Queries of sinks (A) and of research composites (J, K, M)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, order, stats
from ..sources import tables as src
from ..sources.shared import cut, new_dir
from .domain import TRAIL, trail
from .registry import query
from .stats import PAIRS, pairs

C = F.col
R = lambda c, n=6: F.round(C(c), n).alias(c)
N = lambda: F.count(F.lit(1))


@query("A01_scan_partitioned", "SELECT season, team_id, plays, CASE WHEN season >= 1999 THEN volume END AS volume FROM team_seasons WHERE season <> 1997")
def _(t):
    root = new_dir(t.spark, "scan")
    t.team_seasons.where("season < 1999").select("season", "team_id", "plays").write.partitionBy("season").parquet(f"{root}/teams")
    t.team_seasons.where("season >= 1999").select("season", "team_id", "plays", "volume").write.mode("append").partitionBy("season").parquet(f"{root}/teams")
    return src.scan_partitioned(t.spark, root, "teams", [r[0] for r in t.seasons.where("season <> 1997").collect()]).select("season", "team_id", "plays", "volume")  # the list is a row a season


@query("A05_scan_csv_typed", "SELECT s_suppkey, s_name, s_suppkey % 2 = 0 AS flag, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey * 2 AS INT) END AS n FROM supplier")
def _(t):
    path = new_dir(t.spark, "csv")
    k = C("s_suppkey")
    t.raw("supplier").select("s_suppkey", "s_name", F.when(k % 2 == 0, "true").otherwise("TRUE").alias("flag"), F.when(k % 3 != 0, (k * 2).cast("string")).otherwise("x").alias("n")).write.option("header", True).csv(path)
    return src.scan_csv_typed(t.spark, path, {"s_suppkey": "bigint", "s_name": "string", "flag": "boolean", "n": "int"})


@query("A13_versioned_sink", """SELECT 'v1' AS version, 'reused' AS status, season, team_id, plays FROM team_seasons UNION ALL SELECT 'v2', 'published', season, team_id, plays FROM team_seasons WHERE season >= 1998
UNION ALL SELECT 'v1', 'refused', NULL, NULL, count(*) FROM team_seasons UNION ALL SELECT 'v2', 'held', NULL, NULL, count(*) FROM team_seasons WHERE season >= 1998""")
def _(t):
    root = new_dir(t.spark, "sink")
    rows = t.team_seasons.select("season", "team_id", "plays")
    src.versioned_sink({"teams": rows}, root, "v1")
    again = src.versioned_sink({"teams": rows}, root, "v1")  # found, verified and of the same content
    new = src.versioned_sink({"teams": rows.where("season >= 1998")}, root, "v2")
    try:
        refused = src.versioned_sink({"teams": rows.where("false")}, root, "v1")
    except src.PublicationError:
        refused = "refused"
    read = lambda version, status: src.read_published(t.spark, root, "teams", version).select("version", F.lit(status).alias("status"), "season", "team_id", "plays")
    held = src.publications(t.spark, root).select("version", F.when(C("version") == "v1", refused).otherwise("held").alias("status"), C("row_count").alias("plays"))
    return read("v1", again).unionByName(read(None, new)).unionByName(held, allowMissingColumns=True)


@query("A16_season_incremental", "SELECT season, team_id, plays + CASE WHEN season > 1998 THEN 1 ELSE 0 END AS plays FROM team_seasons")
def _(t):
    path = new_dir(t.spark, "seasons")
    rows = t.team_seasons.select("season", "team_id", "plays")
    src.season_incremental(rows.where("season <= 1998"), rows.where("false"), path)
    done = t.spark.read.parquet(path).select("season").distinct()
    return src.season_incremental(rows.withColumn("plays", C("plays") + 1), done, path).select("season", "team_id", "plays")


COHORT = """ch AS (SELECT a.actor_id, a.season, a.team_id, p.attempts::DOUBLE / p.plays AS prior_share, ts.attempts::DOUBLE / ts.plays AS team_share, a.value::DOUBLE / a.volume AS outcome FROM actor_seasons a LEFT JOIN actor_seasons p ON p.actor_id = a.actor_id AND p.season = a.season - 1 LEFT JOIN team_seasons ts ON ts.team_id = a.team_id AND ts.season = a.season - 1)"""


def cohort(t):
    a = t.actor_seasons.select("actor_id", "season", "team_id", (C("value") / C("volume")).alias("outcome"))
    p = t.actor_seasons.select("actor_id", (C("season") + 1).alias("season"), (C("attempts") / C("plays")).alias("prior_share"))
    ts = t.team_seasons.select("team_id", (C("season") + 1).alias("season"), (C("attempts") / C("plays")).alias("team_share"))
    return a.join(p, ["actor_id", "season"], "left").join(ts, ["team_id", "season"], "left")


#: Features of the preprocessing, as SQL over the actor's row a of the season before and the team's row ts; the last two are rarely there and constant.
RAW = {"share": "a.attempts / a.plays", "success": "a.successes / a.plays", "level": "a.value / a.volume", "team_share": "ts.attempts / ts.plays", "peak": "CASE WHEN a.plays >= 105 THEN a.value / a.volume END", "era": "CASE WHEN a.plays > 0 THEN 1 END"}
LEAST_ROWS = 50
_RAW_SQL = ", ".join(f"({e.replace(' / ', '::DOUBLE / ')})::DOUBLE" for e in RAW.values())


@query("K04_fold_preprocess", f"""WITH x AS (SELECT c.actor_id, c.season, unnest([{', '.join(f"'{n}'" for n in RAW)}]) AS feature, unnest([{_RAW_SQL}]) AS v
  FROM actor_seasons c LEFT JOIN actor_seasons a ON a.actor_id = c.actor_id AND a.season = c.season - 1 LEFT JOIN team_seasons ts ON ts.team_id = c.team_id AND ts.season = c.season - 1),
f AS (SELECT s.season AS fold, feature, count(v) AS n, count(*) - count(v) AS missing, quantile_cont(v, 0.5) AS med, stddev_pop(v) AS spread FROM seasons s JOIN x ON x.season < s.season GROUP BY 1, 2),
g AS (SELECT f.fold, f.feature, avg(coalesce(v, med)) AS m, stddev_pop(coalesce(v, med)) AS sd FROM f JOIN x ON x.season < f.fold AND x.feature = f.feature GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN n < {LEAST_ROWS} THEN 'few' WHEN spread <= 1e-12 THEN 'constant' ELSE 'kept' END AS rule FROM f JOIN g USING (fold, feature))
SELECT actor_id, season, x.feature, rule, CASE WHEN rule = 'kept' THEN round((coalesce(v, med) - m) / sd, 5) END AS z, CASE WHEN rule = 'kept' AND missing > 0 THEN (v IS NULL)::INT END AS was_missing FROM x JOIN r ON r.fold = x.season AND r.feature = x.feature""")
def _(t):
    rows = t.actor_seasons.select("actor_id", "season", "team_id")
    before = lambda df, *keys: df.select(*keys, (C("season") + 1).alias("season"), F.struct("plays", "volume", "value", "attempts", "successes").alias("_x"))
    wide = rows.join(before(t.actor_seasons, "actor_id").withColumnRenamed("_x", "a"), ["actor_id", "season"], "left").join(before(t.team_seasons, "team_id").withColumnRenamed("_x", "ts"), ["team_id", "season"], "left")
    x = wide.select("actor_id", "season", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.expr(e).cast("double").alias("v")) for n, e in RAW.items()))).alias("f")).select("actor_id", "season", "f.*")
    return fold_features(cut(x, "features"), t.seasons)


def fold_features(x, seasons, least_rows=LEAST_ROWS):
    """x (actor_id, season, feature, v) by the rules of its season's fold, which come from the seasons before it alone: a feature with few values or one
    value is dropped, others have NULLs filled by the median, are standardised, and have an indicator where values were missing in the fold."""
    centre = x.groupBy("feature").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("c"))
    v = C("v") - C("c")
    per = x.join(F.broadcast(centre), "feature").groupBy("feature", "c", "season").agg(F.count("v").alias("n"), F.count_if(C("v").isNull()).alias("missing"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("q"))
    grid = seasons.select("season").crossJoin(F.broadcast(centre)).join(per.drop("c"), ["season", "feature"], "left")
    past = Window.partitionBy("feature").orderBy("season").rangeBetween(Window.unboundedPreceding, -1)  # a row a season
    fold = grid.select("season", "feature", "c", *(F.sum(k).over(past).alias(k) for k in ("n", "missing", "s", "q"))).where("n IS NOT NULL")
    med = order.cumulative_quantiles(x, ["feature"], "season", "v", 0.5, seasons).select("season", "feature", C("q").alias("med"))
    fold = fold.join(med, ["season", "feature"], "left")
    spread = F.when(C("n") > 0, F.sqrt(F.greatest(F.lit(0.0), C("q") / C("n") - (C("s") / C("n")) * (C("s") / C("n")))))
    rule = F.when(C("n") < least_rows, "few").when(spread <= 1e-12 + 1e-12 * F.abs("c"), "constant").otherwise("kept")
    total, filled = C("n") + C("missing"), C("missing") * F.coalesce(C("med") - C("c"), F.lit(0.0))
    mean = (C("s") + filled) / total
    square = (C("q") + filled * F.coalesce(C("med") - C("c"), F.lit(0.0))) / total
    fit = fold.select("season", "feature", rule.alias("rule"), "med", "missing", (C("c") + mean).alias("m"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("sd"))
    out = x.join(F.broadcast(fit), ["season", "feature"])
    kept = C("rule") == "kept"
    return out.select("actor_id", "season", "feature", "rule", F.when(kept, F.round((F.coalesce("v", "med") - C("m")) / C("sd"), 5)).alias("z"), F.when(kept & (C("missing") > 0), C("v").isNull().cast("int")).alias("was_missing"))


@query("K51_gate_comparison", f"""WITH {PAIRS}, c AS (SELECT 'y' AS system, count(*) AS n, corr(y, prior_y) AS r FROM pairs UNION ALL SELECT 'x1', count(*), corr(x1, prior_x1) FROM pairs),
g AS (SELECT system, 'rows' AS criterion, n >= 100 AS ok FROM c UNION ALL SELECT system, 'correlation', r >= 0.25 FROM c) SELECT system, criterion, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS result FROM g UNION ALL SELECT system, 'overall', CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END FROM g GROUP BY 1""")
def _(t):
    rows = pairs(t).select(F.explode(F.array(*(F.struct(F.lit(n).alias("system"), C(n).alias("a"), C(f"prior_{n}").alias("b")) for n in ("y", "x1")))).alias("s")).select("s.*")
    c = rows.groupBy("system").agg(N().alias("n"), stats.pearson("a", "b").alias("r"))
    ok = {"rows": C("n") >= 100, "correlation": C("r") >= 0.25}
    label = lambda x: F.when(x, "PASS").otherwise("FAIL")
    every = reduce(lambda a, b: a & b, ok.values())
    return c.select("system", F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), label(x).alias("result")) for n, x in {**ok, "overall": every}.items()))).alias("g")).select("system", "g.*")


@query("K67_readiness_gates", f"""WITH {PAIRS}, a AS (SELECT count(*) AS n, count(DISTINCT season) AS s, corr(y, prior_y) AS r FROM pairs), b AS (SELECT count(*) FILTER (WHERE p.actor_id IS NOT NULL)::DOUBLE / count(*) AS coverage FROM actor_seasons x LEFT JOIN pairs p ON p.actor_id = x.actor_id AND p.season = x.season WHERE x.season > (SELECT min(season) FROM seasons)),
g AS (SELECT 'rows' AS gate, n::DOUBLE AS measured, n >= 300 AS ok FROM a UNION ALL SELECT 'seasons', s, s >= 4 FROM a UNION ALL SELECT 'coverage', coverage, coverage >= 0.8 FROM b UNION ALL SELECT 'signal', r, r > 0.5 FROM a)
SELECT gate, round(measured, 5) AS measured, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS result FROM g UNION ALL SELECT 'verdict', count(*) FILTER (WHERE ok), CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END FROM g""")
def _(t):
    p = pairs(t)
    a = p.agg(N().alias("rows"), F.count_distinct("season").alias("seasons"), stats.pearson("y", "prior_y").alias("signal"))
    start = t.seasons.agg(F.min("season").alias("_first"))
    later = t.actor_seasons.crossJoin(F.broadcast(start)).where("season > _first").select("actor_id", "season").join(p.select("actor_id", "season", F.lit(1).alias("hit")), ["actor_id", "season"], "left")
    a = a.crossJoin(later.agg((F.count("hit") / N()).alias("coverage")))
    gates = {"rows": C("rows") >= 300, "seasons": C("seasons") >= 4, "coverage": C("coverage") >= 0.8, "signal": F.coalesce(C("signal") > 0.5, F.lit(False))}
    passed = sum((x.cast("int") for x in gates.values()), F.lit(0))
    row = lambda name, measured, ok: F.struct(F.lit(name).alias("gate"), F.round(measured.cast("double"), 5).alias("measured"), F.when(ok, "PASS").otherwise("FAIL").alias("result"))
    return a.select(F.explode(F.array(*(row(n, C(n), ok) for n, ok in gates.items()), row("verdict", passed, passed == len(gates)))).alias("g")).select("g.*")


@query("M10_analytical_bundle", f"""WITH {TRAIL}, own AS (SELECT team_id, season, CAST(sum(plays) AS BIGINT) AS plays, CAST(sum(attempts) AS BIGINT) AS attempts FROM actor_seasons WHERE actor_id % 53 <> 0 GROUP BY 1, 2), home AS (SELECT home_team AS team_id, season, count(*) AS games FROM games GROUP BY 1, 2)
SELECT fr.team_id, fr.target, fr.feature, z, ts.plays, coalesce(home.games, 0) AS games, coalesce(ts.plays = own.plays AND ts.attempts = own.attempts, false) AS reconciles, ts.plays - coalesce(own.plays, 0) AS difference FROM fr JOIN team_seasons ts ON ts.team_id = fr.team_id AND ts.season = fr.source LEFT JOIN own ON own.team_id = fr.team_id AND own.season = fr.source LEFT JOIN home ON home.team_id = fr.team_id AND home.season = fr.source""")
def _(t):
    # totals of a team are held against those of its actors, which come from another grouping; the rows of some actors are absent there
    ts = t.team_seasons.select("team_id", C("season").alias("source"), "plays", "attempts")
    own = t.actor_seasons.where("actor_id % 53 <> 0").groupBy("team_id", C("season").alias("source")).agg(F.sum("plays").alias("own_plays"), F.sum("attempts").alias("own_attempts"))
    home = t.games.groupBy(C("home_team").alias("team_id"), C("season").alias("source")).agg(N().alias("games"))
    k = ["team_id", "source"]
    j = joins.checked_join(joins.checked_join(joins.checked_join(trail(t), ts, k, cardinality="m:1"), own, k, "left", "m:1"), home, k, "left", "m:1")
    same = F.coalesce((C("plays") == C("own_plays")) & (C("attempts") == C("own_attempts")), F.lit(False))
    return j.select("team_id", "target", "feature", "z", "plays", F.coalesce("games", F.lit(0)).alias("games"), same.alias("reconciles"), (C("plays") - F.coalesce("own_plays", F.lit(0))).alias("difference"))
