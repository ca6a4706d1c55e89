"""Fits on folds of seasons, teams, actors and draws (family K), all in closed form over grouped sums; see operators/closed.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import closed, order, stats
from ..sources.shared import cut
from .models import FEATURES, TRAIN, training
from .registry import query
from .research import COHORT, cohort

C = F.col
N = lambda: F.count(F.lit(1))
R = lambda c, n=3: F.round(C(c), n).alias(c)
union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
SIGNALS = ["prior_y", "prior_x1", "prior_team"]
#: model -> numbers of its features among SIGNALS.
SETS = {"level": [1], "share": [2], "offence": [3], "level_share": [1, 2], "level_offence": [1, 3], "all": [1, 2, 3]}


def fits(moments, sets: dict[str, list[int]], alphas: list[float], p: int, keep: list[str]):
    """keep, model, alpha, n, b0 .. bp: every set and alpha on the same sums (a small table, written once)."""
    rows = cut(moments.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas)))), "moments")
    return cut(union([closed.fit(rows, [*keep, "alpha"], p, which, "alpha").withColumn("model", F.lit(name)) for name, which in sets.items()]), "fits")


def fits_sql(source: str, sets: dict[str, list[int]], alphas: list[float], p: int, keep: str) -> str:
    own = f"(SELECT *, unnest([{', '.join(f'{a}::DOUBLE' for a in alphas)}]) AS alpha FROM {source})"
    return " UNION ALL ".join(f"SELECT '{name}' AS model, * FROM ({closed.fit_sql(f'SELECT * FROM {own}', f'{keep}alpha, ', p, which, 'alpha')})" for name, which in sets.items())


def fold_predictions(t, rows, features: list[str], sets: dict[str, list[int]], alphas: list[float], y: str = "y"):
    """rows x models x alphas with p, the prediction of the fit on all earlier seasons, and train_n; no row where there is no fit."""
    rows = rows.withColumn("y", C(y)) if y != "y" else rows
    per = closed.sums(rows, features, ["season"])
    fit = fits(closed.earlier(per, "season", t.seasons, len(features)).where("n > 0"), sets, alphas, len(features), ["season"]).withColumnRenamed("n", "train_n").where("b0 IS NOT NULL")
    return rows.join(F.broadcast(fit), "season").withColumn("p", F.expr(closed.predicted(features)))


def fold_sql(features: list[str], sets: dict[str, list[int]], alphas: list[float], y: str = "y", tag: str = "") -> str:
    """CTEs fs (sums), ft (fits), fp (predictions) of the table tr."""
    return f"""fs{tag} AS ({closed.earlier_sql('tr', features, y=y)}), ft{tag} AS ({fits_sql(f'fs{tag}', sets, alphas, len(features), 'season, ')}),
fp{tag} AS (SELECT tr.*{'' if y == 'y' else f' REPLACE ({y} AS y)'}, model, alpha, f.n AS train_n, {closed.predicted(features)} AS p FROM tr JOIN ft{tag} f USING (season) WHERE b0 IS NOT NULL)"""


THREE = {"all": [1, 2, 3]}


@query("K01_ridge_weighted", f"WITH {TRAIN}, g AS (SELECT {', '.join(f'{e} AS {n}' for n, e in closed.sum_expressions(FEATURES).items())} FROM tr WHERE season < 2000), f AS ({closed.fit_sql('g', '', 3, [1, 2, 3], '1e1')}) SELECT actor_id, season, y, round({closed.predicted(FEATURES)}, 3) AS prediction FROM tr CROSS JOIN f WHERE season >= 2000")
def _(t):
    rows = cut(training(t), "training")
    f = closed.fit(closed.sums(rows.where("season < 2000"), FEATURES, []), [], 3, [1, 2, 3], "1e1").drop("n")
    return rows.where("season >= 2000").crossJoin(F.broadcast(f)).select("actor_id", "season", "y", F.round(F.expr(closed.predicted(FEATURES)), 3).alias("prediction"))


#: Effective degrees of freedom, 1 + p - alpha / w * trace((R + alpha / w)^-1), from the correlations of three features.
DF3 = [{"k": "1 + alpha / w"}, {"det": "k * k * k + 2 * r12 * r13 * r23 - k * (r12 * r12 + r13 * r13 + r23 * r23)"}, {"df": "4 - alpha / w * (3 * k * k - r12 * r12 - r13 * r13 - r23 * r23) / det"}]


@query("K03_ridge_effective_df", f"WITH {TRAIN}, g AS (SELECT {', '.join(f'{e} AS {n}' for n, e in closed.sum_expressions(FEATURES).items())} FROM tr), a AS (SELECT *, unnest([1::DOUBLE, 100::DOUBLE, 10000::DOUBLE]) AS alpha FROM g) SELECT alpha, round(df, 6) AS df FROM ({closed.chain_sql('a', [*closed.moment_stages(3), *DF3])})")
def _(t):
    g = closed.sums(training(t), FEATURES, []).withColumn("alpha", F.explode(F.array(F.lit(1.0), F.lit(100.0), F.lit(10000.0))))
    return closed.chain(g, [*closed.moment_stages(3), *DF3]).select("alpha", F.round("df", 6).alias("df"))


@query("K05_expanding_window", f"WITH {TRAIN}, {fold_sql(FEATURES, THREE, [1, 10])} SELECT actor_id, season, alpha, train_n, round(y, 6) AS y, round(p, 3) AS prediction FROM fp")
def _(t):
    return fold_predictions(t, training(t), FEATURES, THREE, [1, 10]).select("actor_id", "season", "alpha", "train_n", F.round("y", 6).alias("y"), F.round("p", 3).alias("prediction"))


ALPHAS = [0.1, 1, 10, 100]
_PER = "per AS (SELECT {keys}season, alpha, sum(abs(y - p)) AS e, count(*) AS n FROM {fp} GROUP BY ALL), seen AS (SELECT *, sum(e) OVER w / sum(n) OVER w AS mae FROM per WINDOW w AS (PARTITION BY {keys}alpha ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), best AS (SELECT {keys}season, arg_min(alpha, (round(mae, 6), -alpha)) AS alpha, min(round(mae, 6)) AS mae FROM seen WHERE mae IS NOT NULL GROUP BY ALL)"


def inner_alpha(p, keys: list[str]):
    """Per fold (and key) the alpha with the least mean absolute error over the folds before; ties take the larger."""
    per = p.groupBy(*keys, "season", "alpha").agg(F.sum(F.abs(C("y") - C("p"))).alias("e"), N().alias("n"))
    w = Window.partitionBy(*keys, "alpha").orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    seen = per.select(*keys, "season", "alpha", F.round(F.sum("e").over(w) / F.sum("n").over(w), 6).alias("mae")).where("mae IS NOT NULL")
    return seen.groupBy(*keys, "season").agg(F.min(F.struct("mae", (-C("alpha")).alias("a"))).alias("m")).select(*keys, "season", (-C("m.a")).alias("alpha"), C("m.mae").alias("mae"))


@query("K38_inner_tuning", f"WITH {TRAIN}, {fold_sql(FEATURES, THREE, ALPHAS)}, {_PER.format(keys='', fp='fp')} SELECT season, alpha, round(mae, 3) AS mae FROM best")
def _(t):
    return inner_alpha(fold_predictions(t, training(t), FEATURES, THREE, ALPHAS), []).select("season", "alpha", R("mae"))


@query("K29_movement_expectation", f"WITH {TRAIN.replace('SELECT a.actor_id, a.team_id', 'SELECT a.y - b.y AS move, a.actor_id, a.team_id')}, {fold_sql(FEATURES, THREE, [10], 'move')} SELECT actor_id, season, round(y, 4) AS move, round(p, 3) AS prediction, round(y - p, 3) AS development FROM fp")
def _(t):
    out = fold_predictions(t, training(t).withColumn("move", C("y") - C("prior_y")), FEATURES, THREE, [10], "move")
    return out.select("actor_id", "season", F.round("move", 4).alias("move"), F.round("p", 3).alias("prediction"), F.round(C("move") - C("p"), 3).alias("development"))


_MODEL_METRICS = "count(*) AS n, round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(CASE WHEN count(*) >= 2 AND var_pop(y) > 0 AND var_pop(p) > 0 THEN corr(y, p) END, 5) AS correlation"
_WEIGHTS = ["b1", "b2", "b3"]


def model_metrics():
    e = C("y") - C("p")
    return [N().alias("n"), F.round(F.avg(F.abs(e)), 3).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"), F.round(stats.pearson("y", "p"), 5).alias("correlation")]


@query("K30_future_signal_models", f"""WITH {TRAIN}, {fold_sql(SIGNALS, SETS, [10])}, x AS (SELECT fp.*, o.p AS po FROM fp JOIN (SELECT actor_id, season, p FROM fp WHERE model = 'offence') o USING (actor_id, season)),
m AS (SELECT model, season, {_MODEL_METRICS}, round(avg(abs(y - po)) - avg(abs(y - p)), 3) AS gain FROM x GROUP BY 1, 2 UNION ALL SELECT model, NULL, {_MODEL_METRICS}, round(avg(abs(y - po)) - avg(abs(y - p)), 3) FROM x GROUP BY 1)
SELECT m.*, {', '.join(f'round({b}, 3) AS weight_{i + 1}' for i, b in enumerate(_WEIGHTS))} FROM m LEFT JOIN ft ON ft.model = m.model AND ft.season = m.season""")
def _(t):
    # predictions of all models on the same rows; the rows of season NULL compare them over all folds
    p = cut(fold_predictions(t, training(t), SIGNALS, SETS, [10]).select("actor_id", "season", "model", "y", "p", *_WEIGHTS), "predictions")
    base = p.where("model = 'offence'").select("actor_id", "season", C("p").alias("po"))
    x = p.join(base, ["actor_id", "season"])
    gain = F.round(F.avg(F.abs(C("y") - C("po"))) - F.avg(F.abs(C("y") - C("p"))), 3).alias("gain")
    each = x.groupBy("model", "season").agg(*model_metrics(), gain, *(F.round(F.first(b), 3).alias(f"weight_{i + 1}") for i, b in enumerate(_WEIGHTS)))
    return each.unionByName(x.groupBy("model").agg(*model_metrics(), gain), allowMissingColumns=True)


#: models 0 (mean of the past) to 5 and the challenger, on the level, the share and the scheme.
CREDIBLE = ["prior_y", "prior_x1", "prior_scheme"]
CREDIBLE_SETS = {"0": [], "1": [1], "2": [2], "3": [3], "4": [1, 2], "5": [1, 2, 3], "challenger": [1, 3]}
DRAWS = 20
_BITS = "('0x' || substr(md5('{seed}|' || draw || '|' || {cluster}), 1, 8))::BIGINT"
_SPREAD = "count(*) AS fits_n, {cols}".format(cols=", ".join(f"round(avg(b{i}), 3) AS mean_{i}, round(stddev_samp(b{i}), 3) AS sd_{i}, round(min(b{i}), 3) AS low_{i}, round(max(b{i}), 3) AS high_{i}" for i in (1, 2, 3)))


def spread(df, keys):
    return df.groupBy(*keys).agg(N().alias("fits_n"), *(x for i in (1, 2, 3) for x in (F.round(F.avg(f"b{i}"), 3).alias(f"mean_{i}"), F.round(F.stddev_samp(f"b{i}"), 3).alias(f"sd_{i}"), F.round(F.min(f"b{i}"), 3).alias(f"low_{i}"), F.round(F.max(f"b{i}"), 3).alias(f"high_{i}"))))


def resampled_sql(features: list[str], clusters: dict[str, str], seed: str) -> str:
    """rs: sums of the rows by bootstrap draw (of the first cluster's rows) and with each unit of each cluster left out."""
    first = next(iter(clusters.values()))
    names = closed.sum_names(len(features))
    weight = closed.poisson_weight(_BITS.format(seed=seed, cluster=first))
    out = [f"SELECT 'bootstrap' AS variant, draw::VARCHAR AS unit, {', '.join(f'{e} AS {n}' for n, e in closed.sum_expressions(features, w='dw').items() if n != 'n')}, CAST(sum(k) AS BIGINT) AS n FROM (SELECT *, w * k AS dw FROM (SELECT *, {weight} AS k FROM tr CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw))) GROUP BY draw"]
    for name, key in clusters.items():
        own = f"(SELECT {key} AS unit, {', '.join(f'{e} AS {n}' for n, e in closed.sum_expressions(features).items())} FROM tr GROUP BY 1)"
        total = ", ".join(f"sum({n}) OVER () - {n} AS {n}" for n in names if n != "n")
        out.append(f"SELECT 'without_{name}' AS variant, unit::VARCHAR AS unit, {total}, CAST(sum(n) OVER () - n AS BIGINT) AS n FROM {own}")
    return " UNION ALL ".join(out)


def resampled(rows, features: list[str], clusters: dict[str, object], seed: str):
    """variant, unit and sums: bootstrap draws of whole clusters (the first of clusters), and the rows without each unit of each cluster.
    Sums are one row a unit; a unit left out is the total less its own sums."""
    names = closed.sum_names(len(features))
    _, key = next(iter(clusters.items()))
    own = closed.sums(rows, features, [key.alias("unit")])
    draws = stats.bootstrap_sums(own, "unit", names, DRAWS, seed).select(F.lit("bootstrap").alias("variant"), C("draw").cast("string").alias("unit"), *names)
    out = [draws]
    for name, key in clusters.items():
        own = closed.sums(rows, features, [key.alias("unit")])
        total = own.agg(*(F.sum(c).alias(f"t_{c}") for c in names))
        out.append(own.crossJoin(F.broadcast(total)).select(F.lit(f"without_{name}").alias("variant"), C("unit").cast("string").alias("unit"), *((C(f"t_{c}") - C(c)).alias(c) for c in names)))
    return union(out)


@query("K31_credible_fold_models", f"""WITH {TRAIN}, {fold_sql(CREDIBLE, CREDIBLE_SETS, [10])}, ok AS (SELECT season FROM fp WHERE model = '5' GROUP BY 1 HAVING count(*) >= 20 AND min(train_n) >= 60), rs AS ({resampled_sql(CREDIBLE, {'team': 'team_id'}, 'credible')}), rf AS ({closed.fit_sql('rs', 'variant, unit, ', 3, [1, 2, 3], '1e1')})
SELECT 'fold' AS part, model AS name, season, {_MODEL_METRICS}, NULL::BIGINT AS fits_n, {', '.join(f'NULL::DOUBLE AS {c}_{i}' for i in (1, 2, 3) for c in ('mean', 'sd', 'low', 'high'))} FROM fp WHERE season IN (SELECT season FROM ok) GROUP BY model, season
UNION ALL SELECT 'weights', variant, NULL, NULL, NULL, NULL, NULL, {_SPREAD} FROM rf GROUP BY variant""")
def _(t):
    rows = cut(training(t), "training")
    p = fold_predictions(t, rows, CREDIBLE, CREDIBLE_SETS, [10])
    ok = p.where("model = '5'").groupBy("season").agg(N().alias("n"), F.min("train_n").alias("m")).where("n >= 20 AND m >= 60").select("season")
    fold = p.join(F.broadcast(ok), "season").groupBy(C("model").alias("name"), "season").agg(*model_metrics()).withColumn("part", F.lit("fold"))
    weights = spread(closed.fit(resampled(rows, CREDIBLE, {"team": C("team_id")}, "credible"), ["variant", "unit"], 3, [1, 2, 3], "1e1"), ["variant"]).withColumnRenamed("variant", "name").withColumn("part", F.lit("weights"))
    return fold.unionByName(weights, allowMissingColumns=True)


@query("K65_weight_stability", f"""WITH {TRAIN}, {fold_sql(SIGNALS, THREE, [10])}, rs AS ({resampled_sql(SIGNALS, {'actor': 'actor_id', 'team': 'team_id', 'owner': 'actor_id % 40'}, 'stable')}), rf AS ({closed.fit_sql('rs', 'variant, unit, ', 3, [1, 2, 3], '1e1')} UNION ALL SELECT 'fold', season::VARCHAR, n, b0, b1, b2, b3 FROM ft)
SELECT variant, {_SPREAD} FROM rf WHERE b0 IS NOT NULL GROUP BY variant""")
def _(t):
    rows = cut(training(t), "training")
    fold = fits(closed.earlier(closed.sums(rows, SIGNALS, ["season"]), "season", t.seasons, 3).where("n > 0"), THREE, [10], 3, ["season"])
    other = closed.fit(resampled(rows, SIGNALS, {"actor": C("actor_id"), "team": C("team_id"), "owner": C("actor_id") % 40}, "stable"), ["variant", "unit"], 3, [1, 2, 3], "1e1")
    fold = fold.select(F.lit("fold").alias("variant"), C("season").cast("string").alias("unit"), "n", "b0", "b1", "b2", "b3")
    return spread(cut(other.unionByName(fold), "fits").where("b0 IS NOT NULL"), ["variant"])


NESTED = {"1": [1], "2": [1, 2], "3": [1, 2, 3]}
_BETA = ", ".join(f"round(b{i} * d{i} / sqrt(cyy), 5) AS beta_{i}" for i in (1, 2, 3))
_SUMS_TR = ", ".join(f"{e} AS {n}" for n, e in closed.sum_expressions(SIGNALS).items())


def _nested_sql() -> str:
    total = ", ".join(f"sum({n}) OVER () - {n} AS {n}" for n in closed.sum_names(3) if n != "n")
    own = f"(SELECT team_id, {_SUMS_TR} FROM tr GROUP BY 1)"
    parts, lefts = [], []
    for name, which in NESTED.items():
        stages = [*closed.moment_stages(3), *closed.solve_stages(which, "1e-9", 3)]
        parts.append(f"SELECT '{name}' AS controls, b0, b1, b2, b3, {_BETA} FROM ({closed.chain_sql('g', stages)})")
        lefts.append(f"SELECT '{name}' AS controls, * FROM ({closed.fit_sql('lo', 'team_id, ', 3, which, '1e-9')})")
    return f"g AS (SELECT {_SUMS_TR} FROM tr), lo AS (SELECT team_id, {total}, CAST(sum(n) OVER () - n AS BIGINT) AS n FROM {own}), f AS ({' UNION ALL '.join(parts)}), l AS ({' UNION ALL '.join(lefts)})"


_PF = closed.predicted(SIGNALS)


@query("K55_environment_models", f"""WITH {TRAIN}, {_nested_sql()},
a AS (SELECT controls, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM (SELECT controls, y, {_PF} AS p FROM tr CROSS JOIN f) GROUP BY 1), b AS (SELECT controls, sqrt(avg((y - p) * (y - p))) AS rmse FROM (SELECT controls, y, {_PF} AS p FROM tr JOIN l USING (team_id)) GROUP BY 1)
SELECT controls, round(a.rmse, 3) AS rmse, round(r2, 6) AS r2, round(b.rmse, 3) AS rmse_left_out, beta_1, beta_2, beta_3 FROM a JOIN b USING (controls) JOIN f USING (controls)""")
def _(t):
    rows = cut(training(t), "training")
    names = closed.sum_names(3)
    own = closed.sums(rows, SIGNALS, ["team_id"])
    total = cut(own.agg(*(F.sum(c).alias(c) for c in names)), "moments")
    rest = cut(own.crossJoin(F.broadcast(total.select(*(C(c).alias(f"t_{c}") for c in names)))).select("team_id", *((C(f"t_{c}") - C(c)).alias(c) for c in names)), "moments")
    whole, left = [], []
    for name, which in NESTED.items():
        solved = closed.chain(total, [*closed.moment_stages(3), *closed.solve_stages(which, "1e-9", 3)])
        whole.append(solved.select(F.lit(name).alias("controls"), "b0", "b1", "b2", "b3", *(F.round(C(f"b{i}") * C(f"d{i}") / F.sqrt("cyy"), 5).alias(f"beta_{i}") for i in (1, 2, 3))))
        left.append(closed.fit(rest, ["team_id"], 3, which, "1e-9").drop("n").withColumn("controls", F.lit(name)))
    f, e = union(whole), C("y") - F.expr(_PF)
    a = rows.crossJoin(F.broadcast(f)).groupBy("controls", "beta_1", "beta_2", "beta_3").agg(F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.avg(e * e) / F.var_pop("y")).alias("r2"))
    b = rows.join(F.broadcast(union(left)), "team_id").groupBy("controls").agg(F.sqrt(F.avg(e * e)).alias("out"))
    return a.join(b, "controls").select("controls", R("rmse"), R("r2", 6), F.round("out", 3).alias("rmse_left_out"), "beta_1", "beta_2", "beta_3")


@query("K56_environment_sensitivity", f"""WITH {TRAIN}, {fold_sql(SIGNALS, {'level': [1], 'all': [1, 2, 3]}, [10])}, b AS (SELECT x.season, round(x.p, 6) AS a, round(z.p, 6) AS b FROM fp x JOIN fp z USING (actor_id, season) WHERE x.model = 'level' AND z.model = 'all'),
r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY a) + (count(*) OVER (PARTITION BY season, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY season ORDER BY b) + (count(*) OVER (PARTITION BY season, b) - 1) / 2 AS rb FROM b)
SELECT season, count(*) AS n, round(corr(ra, rb), 5) AS spearman, round(avg((sign(a) = sign(b))::INT), 6) AS sign_agreement FROM r GROUP BY 1""")
def _(t):
    p = fold_predictions(t, training(t), SIGNALS, {"level": [1], "all": [1, 2, 3]}, [10])
    both = p.groupBy("actor_id", "season").agg(F.round(F.max(F.when(C("model") == "level", C("p"))), 6).alias("a"), F.round(F.max(F.when(C("model") == "all", C("p"))), 6).alias("b"))
    ranked = order.average_ranks(both, ["season"], ["a", "b"])
    return ranked.groupBy("season").agg(N().alias("n"), F.round(stats.pearson("a_rank", "b_rank"), 5).alias("spearman"), F.round(F.avg((F.signum("a") == F.signum("b")).cast("int")), 6).alias("sign_agreement"))


SCHEME = {"level": [1], "level_share": [1, 2], "level_offence": [1, 3], "share_offence": [2, 3], "all": [1, 2, 3]}
OUTCOMES = {"y": "y", "share": "x1"}
_OUT_SQL = ", ".join(fold_sql(SIGNALS, SCHEME, ALPHAS, y, f"_{o}") for o, y in OUTCOMES.items())
_FOLDS = " UNION ALL ".join(f"SELECT '{o}' AS outcome, * FROM fp_{o}" for o in OUTCOMES)


@query("K60_rolling_scheme_fit", f"""WITH {TRAIN}, {_OUT_SQL}, fa AS ({_FOLDS}), {_PER.format(keys='outcome, model, ', fp='fa')},
grid AS (SELECT outcome, model, season FROM (SELECT unnest(['y', 'share']) AS outcome) CROSS JOIN (SELECT unnest([{', '.join(f"'{m}'" for m in SCHEME)}]) AS model) CROSS JOIN seasons)
SELECT outcome, model, season, actor_id, alpha, train_n, round(y, 6) AS y, round(p, 3) AS p, 'fitted' AS status FROM fa JOIN best USING (outcome, model, season, alpha)
UNION ALL SELECT outcome, model, season, NULL, NULL, NULL, NULL, NULL, CASE WHEN (outcome, model, season) IN (SELECT (outcome, model, season) FROM fa) THEN 'no_inner_fold' ELSE 'no_training_rows' END FROM grid WHERE (outcome, model, season) NOT IN (SELECT (outcome, model, season) FROM best)""")
def _(t):
    rows = cut(training(t), "training")
    p = cut(union([fold_predictions(t, rows, SIGNALS, SCHEME, ALPHAS, y).select("actor_id", "season", "model", "alpha", "train_n", "y", "p", F.lit(o).alias("outcome")) for o, y in OUTCOMES.items()]), "predictions")
    best = cut(inner_alpha(p, ["outcome", "model"]), "best")
    done = p.join(F.broadcast(best.drop("mae")), ["outcome", "model", "season", "alpha"]).select("outcome", "model", "season", "actor_id", "alpha", "train_n", F.round("y", 6).alias("y"), R("p"), F.lit("fitted").alias("status"))
    # folds that cannot be fitted or tuned have a row that says so
    kinds = F.explode(F.array(*(F.struct(F.lit(o).alias("outcome"), F.lit(m).alias("model")) for o in OUTCOMES for m in SCHEME)))
    grid = t.seasons.withColumn("k", kinds).select("season", "k.*")
    some = p.select("outcome", "model", "season", F.lit(True).alias("some")).distinct()
    gone = grid.join(best, ["outcome", "model", "season"], "left_anti").join(some, ["outcome", "model", "season"], "left")
    return done.unionByName(gone.select("outcome", "model", "season", F.when(C("some"), "no_inner_fold").otherwise("no_training_rows").alias("status")), allowMissingColumns=True)


_OK = f"ok AS (SELECT *, outcome AS y, 1::DOUBLE AS w, prior_share * team_share AS crossed FROM ch WHERE prior_share IS NOT NULL AND team_share IS NOT NULL)"


@query("K48_scenario_adjustment", f"""WITH {COHORT}, {_OK}, g AS (SELECT {', '.join(f'{e} AS {n}' for n, e in closed.sum_expressions(['prior_share']).items())} FROM ok), f AS ({closed.fit_sql('g', '', 1, [1], '1')}), rr AS (SELECT actor_id, season, w, team_share, crossed, y - (b0 + b1 * prior_share) AS y FROM ok CROSS JOIN f),
h AS (SELECT {', '.join(f'{e} AS {n}' for n, e in closed.sum_expressions(['team_share', 'crossed']).items())} FROM rr), k AS ({closed.fit_sql('h', '', 2, [1, 2], '10')})
SELECT actor_id, season, round(y, 3) AS residual, round({closed.predicted(['team_share', 'crossed'])}, 3) AS adjustment FROM rr CROSS JOIN k""")
def _(t):
    rows = cohort(t).where("prior_share IS NOT NULL AND team_share IS NOT NULL").select("*", C("outcome").alias("y"), F.lit(1.0).alias("w"), (C("prior_share") * C("team_share")).alias("crossed"))
    base = closed.fit(closed.sums(rows, ["prior_share"], []), [], 1, [1], "1").drop("n")
    rest = cut(rows.crossJoin(F.broadcast(base)).select("actor_id", "season", "w", "team_share", "crossed", (C("y") - F.expr(closed.predicted(["prior_share"]))).alias("y")), "residuals")
    adjust = closed.fit(closed.sums(rest, ["team_share", "crossed"], []), [], 2, [1, 2], "10").drop("n")
    return rest.crossJoin(F.broadcast(adjust)).select("actor_id", "season", F.round("y", 3).alias("residual"), F.round(F.expr(closed.predicted(["team_share", "crossed"])), 3).alias("adjustment"))


#: Three components: the own residual, the partner's residual and what both share, all fitted on earlier seasons.
COMPONENTS = ["own_part", "other_part", "shared_part"]
_LINES = f"""ln AS (SELECT s.season, regr_slope(prior_y, prior_x1) AS ba, regr_intercept(prior_y, prior_x1) AS aa, regr_slope(prior_x1, prior_y) AS bb, regr_intercept(prior_x1, prior_y) AS ab, avg(prior_y) AS ma, stddev_pop(prior_y) AS sa, avg(prior_x1) AS mb, stddev_pop(prior_x1) AS sb FROM seasons s JOIN tr0 r ON r.season < s.season GROUP BY 1),
tr AS (SELECT tr0.*, prior_y - aa - ba * prior_x1 AS own_part, prior_x1 - ab - bb * prior_y AS other_part, ((prior_y - ma) / sa + (prior_x1 - mb) / sb) / 2 AS shared_part FROM tr0 JOIN ln USING (season) WHERE sa > 0 AND sb > 0)"""


@query("K28_residual_components_fold", f"WITH {TRAIN.replace(', tr AS', ', tr0 AS')}, {_LINES}, {fold_sql(COMPONENTS, THREE, [10])} SELECT actor_id, season, round(own_part, 3) AS own_part, round(other_part, 5) AS other_part, round(shared_part, 4) AS shared_part, train_n, round(p, 3) AS prediction FROM fp")
def _(t):
    rows = training(t)
    per = closed.sums(rows.withColumn("one", F.lit(1.0)), ["prior_x1"], ["season"], "prior_y", "one")
    past = closed.chain(closed.earlier(per, "season", t.seasons, 1), closed.moment_stages(1))
    sd = lambda c: F.sqrt(C(c))
    line = past.where("c11 > 0 AND cyy > 0").select("season", (C("c1y") / C("c11")).alias("ba"), (C("my") - C("c1y") / C("c11") * C("m1")).alias("aa"), (C("c1y") / C("cyy")).alias("bb"), (C("m1") - C("c1y") / C("cyy") * C("my")).alias("ab"), "m1", "my", sd("c11").alias("s1"), sd("cyy").alias("sy"))
    a, b = C("prior_y"), C("prior_x1")
    parts = rows.join(F.broadcast(line), "season").select("actor_id", "season", "y", "w", (a - C("aa") - C("ba") * b).alias("own_part"), (b - C("ab") - C("bb") * a).alias("other_part"), (((a - C("my")) / C("sy") + (b - C("m1")) / C("s1")) / 2).alias("shared_part"))
    out = fold_predictions(t, cut(parts, "parts"), COMPONENTS, THREE, [10])
    return out.select("actor_id", "season", R("own_part"), R("other_part", 5), R("shared_part", 4), "train_n", F.round("p", 3).alias("prediction"))
