"""One-year projections: four models of two outcomes on rolling folds, with intervals, gates, calibration and decisions (family K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import closed, joins, order, stats
from ..sources.shared import cut
from .folds import _PER, ALPHAS, OUTCOMES, SIGNALS, fold_predictions, fold_sql, inner_alpha, union
from .models import TRAIN, training
from .registry import query

C = F.col
N = lambda: F.count(F.lit(1))
R = lambda c, n=3: F.round(C(c), n).alias(c)
#: outcome -> the number of its own prior among SIGNALS.
OWN = {"y": 1, "share": 2}
PRIOR = {"y": "prior_y", "share": "prior_x1"}
LEVELS = {"r50": 0.5, "r80": 0.8, "r95": 0.95}
_sets = lambda o: {"league": [], "level": [OWN[o]], "all": [1, 2, 3]}
_FP = ", ".join(fold_sql(SIGNALS, _sets(o), ALPHAS, y, f"_{o}") for o, y in OUTCOMES.items())
_PA = " UNION ALL ".join(f"SELECT '{o}' AS outcome, actor_id, season, model, alpha, train_n, y, p FROM fp_{o}" for o in OUTCOMES)
_PRIORS = " UNION ALL ".join(f"SELECT '{o}', actor_id, season, 'prior', NULL, NULL, {y}, {PRIOR[o]} FROM tr" for o, y in OUTCOMES.items())
PROJ = f"""{TRAIN}, {_FP}, pa AS ({_PA}), pall AS (SELECT * FROM pa WHERE model = 'all'), {_PER.format(keys='outcome, ', fp='pall')},
pj AS (SELECT * FROM pa WHERE model <> 'all' AND alpha = 10 UNION ALL SELECT pall.* FROM pall JOIN best USING (outcome, season, alpha) UNION ALL {_PRIORS})"""


def _radii_sql(rows: str, keys: str) -> str:
    k = ", ".join(f"max(CASE WHEN k = CAST(ceil((n + 1) * {level}::DOUBLE) AS BIGINT) THEN r END) AS {name}" for name, level in LEVELS.items())
    w = f"(PARTITION BY {keys}, s.season"
    return f"SELECT {keys}, season, any_value(n) AS residuals, {k} FROM (SELECT {keys}, s.season, abs(y - p) AS r, row_number() OVER {w} ORDER BY abs(y - p)) AS k, count(*) OVER {w}) AS n FROM seasons s JOIN {rows} q ON q.season < s.season AND q.season >= s.season - 5) GROUP BY ALL"


RADII = f"rd AS ({_radii_sql('pj', 'outcome, model')})"


def projections(t):
    """outcome, model, actor_id, season, alpha, train_n, y, p: league mean, own prior, ridge on the own prior, and ridge on all signals
    with the alpha that did best on the folds before. All fits of an outcome come from one grouped pass."""
    rows = cut(training(t), "training")
    p = cut(union([fold_predictions(t, rows, SIGNALS, _sets(o), ALPHAS, y).select(F.lit(o).alias("outcome"), "actor_id", "season", "model", "alpha", "train_n", "y", "p") for o, y in OUTCOMES.items()]), "predictions")
    every = p.where("model = 'all'")
    best = inner_alpha(every, ["outcome"]).drop("mae")
    prior = union([rows.select(F.lit(o).alias("outcome"), "actor_id", "season", F.lit("prior").alias("model"), C(y).alias("y"), C(PRIOR[o]).alias("p")) for o, y in OUTCOMES.items()])
    tuned = every.join(F.broadcast(best), ["outcome", "season", "alpha"])
    return cut(p.where("model <> 'all' AND alpha = 10").unionByName(tuned).unionByName(prior, allowMissingColumns=True), "projections")


def with_radii(t, p, keys=("outcome", "model")):
    r = order.conformal_radii(p.withColumn("e", C("y") - C("p")), list(keys), "season", t.seasons, "e", LEVELS)
    return p.join(r, [*keys, "season"], "left")


_BOUNDS = [(name, n) for name, n in (("r50", 50), ("r80", 80), ("r95", 95))]


@query("K40_rolling_projection", f"WITH {PROJ}, {RADII} SELECT outcome, model, actor_id, season, alpha, train_n, residuals, round(y, 4) AS y, round(p, 3) AS p, {', '.join(f'round(p - {r}, 3) AS low_{n}, round(p + {r}, 3) AS high_{n}' for r, n in _BOUNDS)} FROM pj LEFT JOIN rd USING (outcome, model, season)")
def _(t):
    out = with_radii(t, projections(t))
    return out.select("outcome", "model", "actor_id", "season", "alpha", "train_n", "residuals", R("y", 4), R("p"), *(x for r, n in _BOUNDS for x in (F.round(C("p") - C(r), 3).alias(f"low_{n}"), F.round(C("p") + C(r), 3).alias(f"high_{n}"))))


_METRICS = """count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 4) AS r2, round(CASE WHEN var_pop(p) > 1e-12 THEN corr(y, p) END, 4) AS correlation,
  round(CASE WHEN var_pop(p) > 1e-12 THEN covar_pop(p, y) / var_pop(p) END, 3) AS slope, round(avg((sign(y) = sign(p))::INT), 6) AS direction, round(avg((y BETWEEN low AND high)::INT), 6) AS coverage"""
_BANDS = f"{PROJ}, {RADII}, bands AS (SELECT pj.*, p - r80 AS low, p + r80 AS high FROM pj LEFT JOIN rd USING (outcome, model, season))"


def bands(t):
    """Projections with the ends of their 80% intervals."""
    return with_radii(t, projections(t)).select("*", (C("p") - C("r80")).alias("low"), (C("p") + C("r80")).alias("high"))


def metrics(rows, keys):
    out = stats.regression_metrics(rows, keys, "y", "p", "low", "high")
    # one value a season has neither correlation nor slope: it differs over seasons only by what they do not share
    some = (C("model") != "league") | (C("spread") > 1e-12)
    out = out.join(rows.groupBy(*keys).agg(F.var_pop("p").alias("spread")), keys)
    return out.select(*keys, "n", R("mae", 4), R("rmse", 4), R("r2", 4), F.when(some, F.round("correlation", 4)).alias("correlation"), F.when(some, F.round("slope", 3)).alias("slope"), R("direction", 6), R("coverage", 6))


@query("K19_regression_metrics", f"WITH {_BANDS} SELECT outcome, model, season, {_METRICS} FROM bands GROUP BY 1, 2, 3")
def _(t):
    return metrics(bands(t), ["outcome", "model", "season"])


PERIODS = {"all": "true", "development": "season <= 1998", "validation": "season BETWEEN 1999 AND 2000", "last": "season >= 2001"}
SUBGROUPS = {
    "returning": "prior_plays > 0", "developing": "experience BETWEEN 0 AND 3", "experienced": "experience >= 4", "volume_low": "volume < 2000", "volume_middle": "volume >= 2000 AND volume < 2300", "volume_high": "volume >= 2300",
    "changer": "changer", "reliable": "career_plays >= 300",
}
_TAGGED = lambda tags, rows: " UNION ALL ".join(f"SELECT '{name}' AS grp, * FROM {rows} WHERE {test}" for name, test in tags.items())
_INFO = """st AS (SELECT actor_id, season, opponent_id, CAST(sum(volume) AS BIGINT) AS v FROM plays GROUP BY 1, 2, 3), mo AS (SELECT actor_id, season, arg_max(opponent_id, (v, opponent_id)) AS main FROM st GROUP BY 1, 2),
info AS (SELECT a.actor_id, a.season, any_value(a.volume) AS volume, a.season - min(b.season) AS experience, sum(b.plays) AS career_plays, max(CASE WHEN b.season = a.season - 1 THEN b.plays END) AS prior_plays, any_value(m.main <> l.main) AS changer
  FROM actor_seasons a JOIN actor_seasons b ON a.actor_id = b.actor_id AND b.season < a.season LEFT JOIN mo m ON m.actor_id = a.actor_id AND m.season = a.season LEFT JOIN mo l ON l.actor_id = a.actor_id AND l.season = a.season - 1 GROUP BY 1, 2)"""


def tagged(rows, tags):
    own = F.filter(F.array(*(F.when(F.expr(test), name) for name, test in tags.items())), lambda x: x.isNotNull())
    return rows.withColumn("grp", F.explode(own))


def actor_info(t):
    """actor_id, season, volume, experience, career_plays, prior_plays, changer: what subgroups of projections are told by."""
    a = t.actor_seasons.select("actor_id", "season", "plays", "volume")
    past = Window.partitionBy("actor_id").orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("actor_id").orderBy("season").rangeBetween(-1, -1)
    own = a.select("actor_id", "season", "volume", (C("season") - F.min("season").over(past)).alias("experience"), F.sum("plays").over(past).alias("career_plays"), F.max("plays").over(before).alias("prior_plays"))
    stints = t.plays.groupBy("actor_id", "season", "opponent_id").agg(F.sum("volume").alias("v"))
    main = stints.groupBy("actor_id", "season").agg(F.max(F.struct("v", "opponent_id"))["opponent_id"].alias("main"))
    moved = main.select("actor_id", "season", (C("main") != F.max("main").over(before)).alias("changer"))
    return own.join(moved, ["actor_id", "season"], "left")


@query("K41_period_metrics", f"WITH {_BANDS} SELECT grp AS period, outcome, model, {_METRICS} FROM ({_TAGGED(PERIODS, 'bands')}) GROUP BY 1, 2, 3")
def _(t):
    return metrics(tagged(bands(t), PERIODS).withColumnRenamed("grp", "period"), ["period", "outcome", "model"])


@query("K46_subgroup_metrics", f"WITH {_BANDS}, {_INFO}, late AS (SELECT bands.*, info.* EXCLUDE (actor_id, season) FROM bands JOIN info USING (actor_id, season) WHERE season > 1998) SELECT grp, outcome, model, {_METRICS} FROM ({_TAGGED(SUBGROUPS, 'late')}) GROUP BY 1, 2, 3")
def _(t):
    late = joins.checked_join(bands(t).where("season > 1998"), actor_info(t), ["actor_id", "season"], cardinality="m:1")
    return metrics(tagged(late, SUBGROUPS), ["grp", "outcome", "model"])


_COVER = "cv AS (SELECT outcome, model, level, count(*) AS n, count(*) FILTER (WHERE radius IS NULL) AS unavailable, avg(CASE WHEN radius IS NOT NULL THEN (abs(y - p) <= radius)::INT END) AS coverage, 2 * avg(radius) AS width FROM (SELECT pj.*, unnest([50, 80, 95]) AS level, unnest([r50, r80, r95]) AS radius FROM pj LEFT JOIN rd USING (outcome, model, season)) GROUP BY 1, 2, 3)"


def coverage(t, p):
    rows = with_radii(t, p).withColumn("_l", F.explode(F.array(*(F.struct(F.lit(n).alias("level"), C(r).alias("radius")) for r, n in _BOUNDS)))).select("outcome", "model", "y", "p", "_l.*")
    inside = F.when(C("radius").isNotNull(), (F.abs(C("y") - C("p")) <= C("radius")).cast("int"))
    return rows.groupBy("outcome", "model", "level").agg(N().alias("n"), F.count_if(C("radius").isNull()).alias("unavailable"), F.avg(inside).alias("coverage"), (2 * F.avg("radius")).alias("width"))


@query("K42_interval_coverage", f"WITH {PROJ}, {RADII}, {_COVER} SELECT outcome, model, level, n, unavailable, round(coverage, 6) AS coverage, round(width, 3) AS width FROM cv")
def _(t):
    return coverage(t, projections(t)).select("outcome", "model", "level", "n", "unavailable", R("coverage", 6), R("width"))


_GATES = """sg AS (SELECT o.outcome, o.model, o.season, avg(abs(b.y - b.p)) - avg(abs(o.y - o.p)) AS gain, avg(abs(b.y - b.p)) AS base FROM pj o JOIN pj b USING (outcome, actor_id, season) WHERE b.model = 'prior' AND o.model <> 'prior' GROUP BY 1, 2, 3),
al AS (SELECT o.outcome, o.model, sqrt(avg((o.y - o.p) * (o.y - o.p))) / sqrt(avg((b.y - b.p) * (b.y - b.p))) AS rmse_ratio, CASE WHEN var_pop(o.p) > 1e-12 THEN corr(o.y, o.p) END AS correlation, avg(abs(o.y - o.p)) AS mae FROM pj o JOIN pj b USING (outcome, actor_id, season) WHERE b.model = 'prior' AND o.model <> 'prior' GROUP BY 1, 2),
gt AS (SELECT outcome, model, count(*) AS folds, avg(gain) AS mean_gain, stddev_samp(gain) / sqrt(count(*)) AS se, avg(base) AS base_mae, avg((gain > 0)::INT) AS win_rate, any_value(rmse_ratio) AS rmse_ratio, any_value(correlation) AS correlation, any_value(mae) AS mae FROM sg JOIN al USING (outcome, model) GROUP BY 1, 2),
ga AS (SELECT *, coalesce(mean_gain > greatest(se, 0.02 * base_mae) AND win_rate >= 0.6 AND rmse_ratio <= 1 AND correlation > 0, false) AS accepted FROM gt),
gs AS (SELECT outcome, coalesce(arg_min(model, (round(mae, 6), model)) FILTER (WHERE accepted), 'prior') AS selected FROM ga GROUP BY 1)"""


def gated(t, p):
    """Per outcome and model the gates against the own prior on the same rows, and the outcome's selected model."""
    base = p.where("model = 'prior'").select("outcome", "actor_id", "season", (C("y") - C("p")).alias("b"))
    rows = p.where("model <> 'prior'").join(base, ["outcome", "actor_id", "season"]).withColumn("e", C("y") - C("p"))
    k = ["outcome", "model"]
    season = rows.groupBy(*k, "season").agg((F.avg(F.abs("b")) - F.avg(F.abs("e"))).alias("gain"), F.avg(F.abs("b")).alias("base"))
    whole = rows.groupBy(*k).agg((F.sqrt(F.avg(C("e") * C("e"))) / F.sqrt(F.avg(C("b") * C("b")))).alias("rmse_ratio"), F.when(F.var_pop("p") > 1e-12, stats.pearson("y", "p")).alias("correlation"), F.avg(F.abs("e")).alias("mae"))
    g = season.groupBy(*k).agg(N().alias("folds"), F.avg("gain").alias("mean_gain"), (F.stddev_samp("gain") / F.sqrt(N())).alias("se"), F.avg("base").alias("base_mae"), F.avg((C("gain") > 0).cast("int")).alias("win_rate")).join(whole, k)
    ok = (C("mean_gain") > F.greatest("se", 0.02 * C("base_mae"))) & (C("win_rate") >= 0.6) & (C("rmse_ratio") <= 1) & (C("correlation") > 0)
    g = cut(g.withColumn("accepted", F.coalesce(ok, F.lit(False))), "gates")
    chosen = g.groupBy("outcome").agg(F.coalesce(F.min(F.when(C("accepted"), F.struct(F.round("mae", 6).alias("m"), "model")))["model"], F.lit("prior")).alias("selected"))
    return g.join(F.broadcast(chosen), "outcome")


@query("K44_model_selection", f"WITH {PROJ}, {_GATES} SELECT outcome, model, folds, round(mean_gain, 3) AS mean_gain, round(se, 3) AS se, round(base_mae, 3) AS base_mae, round(win_rate, 6) AS win_rate, round(rmse_ratio, 5) AS rmse_ratio, round(correlation, 5) AS correlation, accepted, selected FROM ga JOIN gs USING (outcome)")
def _(t):
    return gated(t, projections(t)).select("outcome", "model", "folds", R("mean_gain"), R("se"), R("base_mae"), R("win_rate", 6), R("rmse_ratio", 5), R("correlation", 5), "accepted", "selected")


@query("K45_acceptance_decision", f"""WITH {PROJ}, {RADII}, {_COVER}, {_GATES}, iv AS (SELECT outcome, model, coalesce(abs(coverage - 0.8) <= 0.05 AND unavailable * 2 < n, false) AS intervals_ok FROM cv WHERE level = 80)
SELECT outcome, model, accepted AS point_ok, intervals_ok, CASE WHEN accepted AND intervals_ok THEN 'accepted' WHEN accepted THEN 'point_only' WHEN intervals_ok THEN 'interval_only' ELSE 'rejected' END AS status FROM ga JOIN iv USING (outcome, model)""")
def _(t):
    p = projections(t)
    iv = coverage(t, p).where("level = 80").select("outcome", "model", F.coalesce((F.abs(C("coverage") - 0.8) <= 0.05) & (C("unavailable") * 2 < C("n")), F.lit(False)).alias("intervals_ok"))
    a, b = C("accepted"), C("intervals_ok")
    status = F.when(a & b, "accepted").when(a, "point_only").when(b, "interval_only").otherwise("rejected")
    return gated(t, p).join(iv, ["outcome", "model"]).select("outcome", "model", a.alias("point_ok"), "intervals_ok", status.alias("status"))


_CAL = """lv AS (SELECT actor_id, season, y, p FROM pj WHERE outcome = 'y' AND model = 'level'), fc AS (SELECT s.season, avg(q.y - q.p) AS bias, CASE WHEN var_pop(q.p) > 1e-12 THEN regr_slope(q.y, q.p) END AS b, CASE WHEN var_pop(q.p) > 1e-12 THEN regr_intercept(q.y, q.p) END AS a FROM seasons s JOIN lv q ON q.season < s.season AND q.season >= s.season - 3 GROUP BY 1),
cl AS (SELECT actor_id, season, y, unnest(['none', 'bias', 'linear']) AS method, unnest([p, p + bias, a + b * p]) AS p FROM lv LEFT JOIN fc USING (season)), cq AS (SELECT * FROM cl WHERE p IS NOT NULL)"""


@query("K47_recalibration", f"WITH {PROJ}, {_CAL}, rc AS ({_radii_sql('cq', 'method')}) SELECT method, actor_id, season, round(y, 4) AS y, round(p, 3) AS p, round(p - r80, 3) AS low, round(p + r80, 3) AS high FROM cq LEFT JOIN rc USING (method, season)")
def _(t):
    p = projections(t).where("outcome = 'y' AND model = 'level'").select("actor_id", "season", "y", "p")
    # a fold's calibration needs sums only: seasons are summed once and the trailing window adds them up
    per = closed.sums(p.withColumn("one", F.lit(1.0)), ["p"], ["season"], "y", "one")
    past = closed.chain(closed.earlier(per, "season", t.seasons, 1, window=3), closed.moment_stages(1))
    slope = F.when(C("c11") > 1e-12, C("c1y") / C("c11"))
    line = cut(past.where("n > 0").select("season", (C("my") - C("m1")).alias("bias"), slope.alias("b"), (C("my") - slope * C("m1")).alias("a")), "calibration")
    each = F.array(F.struct(F.lit("none").alias("method"), C("p").alias("q")), F.struct(F.lit("bias").alias("method"), (C("p") + C("bias")).alias("q")), F.struct(F.lit("linear").alias("method"), (C("a") + C("b") * C("p")).alias("q")))
    rows = p.join(F.broadcast(line), "season", "left").withColumn("m", F.explode(each)).select("actor_id", "season", "y", "m.method", C("m.q").alias("p")).where("p IS NOT NULL")
    out = with_radii(t, cut(rows, "calibrated"), ("method",))
    return out.select("method", "actor_id", "season", R("y", 4), R("p"), F.round(C("p") - C("r80"), 3).alias("low"), F.round(C("p") + C("r80"), 3).alias("high"))
