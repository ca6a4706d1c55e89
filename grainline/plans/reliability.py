"""Reliability, shrinkage, resampling and placebo queries (family K). Everything is rebuilt from grouped sums; draws are rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import closed, stats
from ..operators.joins import lag_join
from ..sources.shared import cut
from .aggs import era
from .aggs import ERA
from .models import TRAIN, training
from .projection import PROJ, projections
from .registry import query
from .stats import COH, CORR, PAIRS, PRED, WINDOWS, coh, pairs, preds, windowed

C = F.col
N = lambda: F.count(F.lit(1))
R = lambda c, n=6: F.round(C(c), n).alias(c)
_bits = lambda seed, key: f"('0x' || substr(md5('{seed}|' || draw || '|' || {key}), 1, 8))::BIGINT"
_draws = lambda n: f"(SELECT unnest(range({n})) AS draw)"

#: Effective degrees of freedom of a ridge on two features.
DF2 = [{"k": "1 + 1e1 / w"}, {"df": "3 - 1e1 / w * 2 * k / (k * k - r12 * r12)"}]
_G2 = ", ".join(f"{e} AS {n}" for n, e in closed.sum_expressions(["prior_y", "prior_x1"]).items())


@query("K08_eb_role_pooling", f"""WITH {TRAIN}, g2 AS (SELECT {_G2} FROM tr), f AS ({closed.fit_sql('g2', '', 2, [1, 2], '1e1')}), d AS (SELECT df, n AS rows_n FROM ({closed.chain_sql('g2', [*closed.moment_stages(2), *DF2])})),
src AS (SELECT CAST(actor_id % 4 AS INT) AS role, team_id AS g, y - ({closed.predicted(['prior_y', 'prior_x1'])}) AS y, df / rows_n AS spent FROM tr CROSS JOIN f CROSS JOIN d),
o AS (SELECT role, g, count(y) AS n, avg(y) AS mean, count(y) * var_pop(y) AS ss, any_value(spent) AS spent FROM src GROUP BY ALL), t AS (SELECT *, count(*) OVER w AS gg, sum(n) OVER w AS tt, sum(n * mean) OVER w / sum(n) OVER w AS grand, sum(ss) OVER w AS wi, sum(n * n) OVER w AS nn FROM o WINDOW w AS (PARTITION BY role)),
u AS (SELECT *, sum(n * (mean - grand) * (mean - grand)) OVER (PARTITION BY role) AS be, wi / (tt - gg - spent * tt) AS sigma2 FROM t), v AS (SELECT *, greatest(0, (be - (gg - 1) * sigma2) / (tt - nn::DOUBLE / tt)) AS tau2 FROM u), z AS (SELECT *, CASE WHEN tau2 > 0 THEN tau2 / (tau2 + sigma2 / n) ELSE 0 END AS shrinkage FROM v)
SELECT role, g, n, round(mean, 3) AS mean, round(sigma2, 1) AS sigma2, round(tau2, 1) AS tau2, round(shrinkage, 4) AS shrinkage, round(grand + shrinkage * (mean - grand), 3) AS posterior, round(sqrt(shrinkage * sigma2 / n), 3) AS se FROM z""")
def _(t):
    rows = cut(training(t), "training")
    moments = cut(closed.sums(rows, ["prior_y", "prior_x1"], []), "moments")
    fit = closed.fit(moments, [], 2, [1, 2], "1e1").drop("n")
    spent = closed.chain(moments, [*closed.moment_stages(2), *DF2]).select((C("df") / C("n")).alias("spent"))
    own = rows.crossJoin(F.broadcast(fit)).select((C("actor_id") % 4).cast("int").alias("role"), C("team_id").alias("g"), (C("y") - F.expr(closed.predicted(["prior_y", "prior_x1"]))).alias("y"))
    share = float(spent.first()[0] or 0.0)
    return stats.eb_pooling(own, ["role"], "g", "y", F.lit(share)).select("role", "g", "n", R("mean", 3), R("sigma2", 1), R("tau2", 1), R("shrinkage", 4), R("posterior", 3), R("se", 3))


@query("K10_normal_shrink_record", """
WITH s AS (SELECT actor_id, season, count(*) AS n, CAST(sum(value) AS BIGINT) AS v, CAST(sum(value * value) AS BIGINT) AS vv FROM plays GROUP BY 1, 2), e AS (SELECT *, v::DOUBLE / n AS m, CASE WHEN n > 1 THEN (vv - v::DOUBLE * v / n) / (n - 1) / n END AS sv FROM s),
p AS (SELECT season, avg(m) AS pm, var_pop(m) AS tau2 FROM e GROUP BY 1), z AS (SELECT actor_id, season, n, m, sv, tau2, pm, tau2 / (tau2 + sv) AS k FROM e JOIN p USING (season))
SELECT actor_id, season, n, round(m, 4) AS raw, round(k, 5) AS weight, round(pm + k * (m - pm), 3) AS posterior, round(sqrt(k * sv), 3) AS se, round(pm + k * (m - pm) - 1.96 * sqrt(k * sv), 2) AS low, round(pm + k * (m - pm) + 1.96 * sqrt(k * sv), 2) AS high FROM z""")
def _(t):
    s = t.plays.groupBy("actor_id", "season").agg(N().alias("n"), F.sum("value").alias("v"), F.sum(C("value") * C("value")).alias("vv"))
    # the sampling variance from the sum of squares
    s = s.withColumn("m", C("v") / C("n")).withColumn("sv", F.when(C("n") > 1, (C("vv") - C("v").cast("double") * C("v") / C("n")) / (C("n") - 1) / C("n")))
    p = s.groupBy("season").agg(F.avg("m").alias("pm"), F.var_pop("m").alias("tau2"))
    k = C("tau2") / (C("tau2") + C("sv"))
    z = s.join(F.broadcast(p), "season").withColumn("k", k).withColumn("post", C("pm") + C("k") * (C("m") - C("pm"))).withColumn("se", F.sqrt(C("k") * C("sv")))
    return z.select("actor_id", "season", "n", F.round("m", 4).alias("raw"), F.round("k", 5).alias("weight"), F.round("post", 3).alias("posterior"), R("se", 3), F.round(C("post") - 1.96 * C("se"), 2).alias("low"), F.round(C("post") + 1.96 * C("se"), 2).alias("high"))


def _boot_sql(clusters: str, key: str, draws: int, seed: str) -> str:
    return f"c AS ({clusters}), d AS (SELECT draw, a, b, {closed.poisson_weight(_bits(seed, key))} AS k FROM c CROSS JOIN {_draws(draws)}), r AS (SELECT draw, CASE WHEN sum(b * k) > 0 THEN sum(a * k)::DOUBLE / sum(b * k)::DOUBLE END AS r FROM d GROUP BY 1)"


@query("K12_cluster_bootstrap", f"""WITH {_boot_sql('SELECT actor_id, CAST(sum(value) AS BIGINT) AS a, CAST(sum(volume) AS BIGINT) AS b FROM plays GROUP BY 1', 'actor_id', 50, 'boot')}
SELECT round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high, count(r) AS draws, (SELECT round(sum(a)::DOUBLE / sum(b)::DOUBLE, 6) FROM c) AS estimate FROM r""")
def _(t):
    c = t.plays.groupBy("actor_id").agg(F.sum("value").alias("a"), F.sum("volume").alias("b"))
    return stats.cluster_bootstrap(c, "actor_id", "a", "b", 50, "boot").select(R("low"), R("high"), "draws", R("estimate"))


_DELTA = "SELECT b.actor_id, sum(abs(b.y - b.p) - abs(o.y - o.p)) AS a, count(*) AS b FROM preds b JOIN preds o USING (actor_id, season) WHERE b.model = 'zero' AND o.model = 'half' GROUP BY 1"


@query("K70_model_delta_bootstrap", f"WITH {PRED}, {_boot_sql(_DELTA, 'actor_id', 40, 'delta')} SELECT round(quantile_cont(r, 0.025), 4) AS low, round(quantile_cont(r, 0.975), 4) AS high, count(r) AS draws, (SELECT round(sum(a) / sum(b), 4) FROM c) AS estimate FROM r")
def _(t):
    p = preds(t).withColumn("e", F.abs(C("y") - C("p")))
    base = p.where("model = 'zero'").select("actor_id", "season", C("e").alias("z"))
    c = p.where("model = 'half'").join(base, ["actor_id", "season"]).groupBy("actor_id").agg(F.sum(C("z") - C("e")).alias("a"), N().alias("b"))
    return stats.cluster_bootstrap(c, "actor_id", "a", "b", 40, "delta").select(R("low", 4), R("high", 4), "draws", R("estimate", 4))


def _placebo_sql(rows: str, x: str, y: str, seed: str, draws: int) -> str:
    """b: rows in blocks; s: permuted within season and block; n: the null's correlations. Blocks are as in the operator."""
    return f"""b0 AS (SELECT season, actor_id, {y} AS y, {x} AS x, ('0x' || substr(md5('{seed}|block|' || actor_id), 1, 8))::BIGINT % CAST(ceil(count(*) OVER (PARTITION BY season) / 4096) AS BIGINT) AS blk FROM {rows}),
b AS (SELECT *, row_number() OVER (PARTITION BY season, blk ORDER BY actor_id) AS i FROM b0), s AS (SELECT draw, season, blk, y, row_number() OVER (PARTITION BY draw, season, blk ORDER BY ('0x' || substr(md5('{seed}|' || draw || '|' || season || '|' || actor_id), 1, 8))::BIGINT, actor_id) AS i FROM b CROSS JOIN {_draws(draws)}),
n AS (SELECT draw, abs(corr(b.x, s.y)) AS c FROM s JOIN b ON s.season = b.season AND s.blk = b.blk AND s.i = b.i GROUP BY 1), a AS (SELECT abs(corr(x, y)) AS actual FROM b)"""


def _placebo_out(draws: int, places: int = 5) -> str:
    return f"round(actual, {places}) AS actual, count(*) FILTER (WHERE c >= actual) AS reached, (1 + count(*) FILTER (WHERE c >= actual))::DOUBLE / {draws + 1} AS p, round(quantile_cont(c, 0.05), {places}) AS null_low, round(quantile_cont(c, 0.95), {places}) AS null_high FROM n CROSS JOIN a GROUP BY actual"


_PLACEBO = ["actual", "reached", "p", "null_low", "null_high"]
placebo = lambda df, x, y, draws, seed: stats.permutation_placebo(df, "season", "actor_id", x, y, draws, seed).select(R("actual", 5), "reached", "p", R("null_low", 5), R("null_high", 5))


@query("K13_permutation_placebo", f"WITH {PAIRS}, {_placebo_sql('pairs', 'prior_y', 'y', 'perm', 30)} SELECT {_placebo_out(30)}")
def _(t):
    return placebo(cut(pairs(t), "pairs"), "prior_y", "y", 30, "perm")


_RANKED = "rk AS (SELECT season, actor_id, rank() OVER (ORDER BY round(prior_x1, 9)) + (count(*) OVER (PARTITION BY round(prior_x1, 9)) - 1) / 2 AS rx, rank() OVER (ORDER BY round(y, 6)) + (count(*) OVER (PARTITION BY round(y, 6)) - 1) / 2 AS ry FROM pairs)"


@query("K62_interaction_placebo", f"WITH {PAIRS}, {_RANKED}, {_placebo_sql('rk', 'rx', 'ry', 'inter', 20)} SELECT {_placebo_out(20)}")
def _(t):
    # Spearman is Pearson on ranks over all rows, and a permutation leaves ranks as they are: they are taken once
    rows = pairs(t).select("season", "actor_id", F.round("prior_x1", 9).alias("x"), F.round("y", 6).alias("z"))
    return placebo(cut(stats.global_ranks(cut(rows, "pairs"), ["x", "z"]), "ranks"), "x_rank", "z_rank", 20, "inter")


SUBSETS = {"all": "true", "late": "season >= 1999", "heavy": "w >= 1700"}


@query("K68_placebo_pairs", f"WITH {PAIRS} " + " UNION ALL ".join(f"SELECT * FROM (WITH {_placebo_sql(f'(SELECT * FROM pairs WHERE {c})', 'prior_y', 'y', n, 20)} SELECT '{n}' AS subset, {_placebo_out(20)})" for n, c in SUBSETS.items()))
def _(t):
    p, out = cut(pairs(t), "pairs"), None
    for name, condition in SUBSETS.items():
        one = placebo(p.where(condition), "prior_y", "y", 20, name).select(F.lit(name).alias("subset"), *_PLACEBO)
        out = one if out is None else out.unionByName(one)
    return out


@query("K15_weighted_trend", f"""WITH {COH}, l AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY season DESC) AS k FROM coh), s AS (SELECT actor_id, count(*) AS n, sum(w) AS sw, sum(w * season)::DOUBLE / sum(w)::DOUBLE AS mx, sum(w * y) / sum(w) AS my FROM l WHERE k <= 3 GROUP BY 1),
q AS (SELECT actor_id, any_value(n) AS n, any_value(sw) AS sw, sum(w * (season - mx) * (season - mx)) AS sxx, sum(w * (season - mx) * (y - my)) AS sxy, sum(w * (y - my) * (y - my)) AS syy FROM l JOIN s USING (actor_id) WHERE k <= 3 GROUP BY 1)
SELECT actor_id, n, round(sxy / sxx, 3) AS slope, round(CASE WHEN n > 2 THEN sqrt(greatest(0, syy - sxy / sxx * sxy) / (n - 2) / sxx) END, 2) AS slope_se, round(sqrt(greatest(0, syy - sxy / sxx * sxy) / sw), 2) AS residual_rms FROM q WHERE n >= 2""")
def _(t):
    rows = coh(t).withColumn("season", C("season") - 1998)  # slopes do not change, rounding does
    return stats.weighted_trend(rows, "actor_id", "season", "y", "w").select("actor_id", "n", R("slope", 3), R("slope_se", 2), R("residual_rms", 2))


_ICC = """own AS (SELECT {k}g, count(*) AS n, avg(y) AS m, count(*) * var_pop(y) AS ss FROM src GROUP BY ALL), gm AS (SELECT {k}sum(n * m) / sum(n) AS gm FROM own {g}), tt AS (SELECT {k}count(*) AS groups, sum(n)::BIGINT AS n, sum(n * (m - gm) * (m - gm)) / (count(*) - 1) AS msb, sum(ss) / (sum(n) - count(*)) AS msw, (sum(n) - sum(n * n)::DOUBLE / sum(n)) / (count(*) - 1) AS n0 FROM own {j} {g}), ic AS (SELECT *, (msb - msw) / (msb + (n0 - 1) * msw) AS icc FROM tt)"""


@query("K21_icc_reliability", f"WITH {COH}, src AS (SELECT actor_id AS g, y FROM coh), {_ICC.format(k='', g='', j='CROSS JOIN gm')} SELECT groups, n, round(n0, 6) AS n0, round(icc, 5) AS icc, round(2 * icc / (1 + icc), 5) AS reliability_2, round(n0 * icc / (1 + (n0 - 1) * icc), 5) AS reliability_k, round(n / (1 + (n0 - 1) * greatest(icc, 0)), 3) AS effective_n FROM ic")
def _(t):
    return stats.icc(coh(t), [], "actor_id", "y").select("groups", "n", R("n0"), R("icc", 5), R("reliability_2", 5), R("reliability_k", 5), R("effective_n", 3))


def _corr_boot_sql(rows: str, key: str, x: str, y: str, draws: int, seed: str, by: str = "") -> str:
    s = ", ".join(f"{e} AS {n}" for n, e in stats.PAIR_SUMS.items())
    k = ", ".join(f"sum({n} * k)::DOUBLE AS {n}" for n in stats.PAIR_SUMS)
    return f"cs AS (SELECT {by}{key} AS key, {s} FROM (SELECT {by}{key}, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM {rows}) GROUP BY ALL), cd AS (SELECT *, {closed.poisson_weight(_bits(seed, 'key'))} AS k FROM cs CROSS JOIN {_draws(draws)}), ck AS (SELECT {by}draw, {k} FROM cd GROUP BY ALL), cb AS (SELECT {by}quantile_cont({stats.PAIR_R}, 0.025) AS low, quantile_cont({stats.PAIR_R}, 0.975) AS high FROM ck {'GROUP BY ALL' if by else ''})"


@query("K22_repeatability_row", f"""WITH {PAIRS}, src AS (SELECT actor_id AS g, y FROM coh), {_ICC.format(k='', g='', j='CROSS JOIN gm')}, {_corr_boot_sql('pairs', 'actor_id', 'prior_y', 'y', 40, 'repeat')}, r AS (SELECT *, rank() OVER (ORDER BY round(y, 6)) AS a, rank() OVER (ORDER BY round(prior_y, 6)) AS b FROM pairs)
SELECT count(*) AS pairs, round(corr(y, prior_y), 5) AS pearson, round(corr(a, b), 5) AS spearman, round(avg((sign(y) = sign(prior_y))::INT), 6) AS same_direction, (SELECT round(msw, 2) FROM ic) AS sigma2, (SELECT round(greatest(0, (msb - msw) / n0), 2) FROM ic) AS tau2, (SELECT round(icc, 5) FROM ic) AS icc, (SELECT round(low, 5) FROM cb) AS low, (SELECT round(high, 5) FROM cb) AS high FROM r""")
def _(t):
    p = cut(pairs(t), "pairs")
    rows = p.select(F.round("y", 6).alias("y"), F.round("prior_y", 6).alias("prior_y"))
    ranked = stats.global_ranks(rows, ["y", "prior_y"]).agg(F.round(stats.pearson("y_rank", "prior_y_rank"), 5).alias("spearman"))
    first = p.agg(N().alias("pairs"), F.round(stats.pearson("y", "prior_y"), 5).alias("pearson"), F.round(F.avg((F.signum("y") == F.signum("prior_y")).cast("int")), 6).alias("same_direction"))
    icc = stats.icc(coh(t), [], "actor_id", "y", parts=True).select(F.round("msw", 2).alias("sigma2"), F.round(F.greatest(F.lit(0.0), (C("msb") - C("msw")) / C("n0")), 2).alias("tau2"), R("icc", 5))
    bounds = stats.correlation_bootstrap(p, "actor_id", "prior_y", "y", 40, "repeat").select(R("low", 5), R("high", 5))
    return first.crossJoin(ranked).crossJoin(icc).crossJoin(bounds)


_OWN = "own AS (SELECT actor_id, count(*) AS n, avg(y) AS m, count(*) * var_pop(y) AS ss FROM coh GROUP BY 1), tt AS (SELECT sum(ss) / (sum(n) - count(*)) AS sigma2, sum(n) AS t, count(*) AS g, sum(n * m) / sum(n) AS gm, sum(n * n)::DOUBLE AS nn FROM own)"
#: ANOVA between-group variance from sums over groups of k-fold counted clusters.
_ANOVA = "greatest(CAST(0 AS DOUBLE), ((b - s * s / t) / (g - 1) - (q - b) / (t - g)) / ((t - nn / t) / (g - 1)))"
_SIGMA = "(q - b) / (t - g)"
_GRID = 200


@query("K25_variance_components", f"""WITH {COH}, {_OWN}, dv AS (SELECT own.*, tt.*, (m - gm) * (m - gm) AS dev FROM own CROSS JOIN tt), mo AS (SELECT any_value(sigma2) AS sigma2, greatest(0, (sum(n * dev) - (any_value(g) - 1) * any_value(sigma2)) / (any_value(t) - any_value(nn) / any_value(t))) AS tau2, (sum(n * dev) / (any_value(g) - 1) - any_value(sigma2)) / ((any_value(t) - any_value(nn) / any_value(t)) / (any_value(g) - 1)) AS anova, sum(n * dev) / any_value(t) AS top FROM dv),
gr AS (SELECT k, mo.top * k / {_GRID // 2}.0::DOUBLE AS tau2 FROM mo CROSS JOIN (SELECT unnest(range({_GRID})) AS k)), li AS (SELECT k, any_value(gr.tau2) AS tau2, round(sum(0.5 * ln(gr.tau2 + sigma2 / n) + 0.5 * dev / (gr.tau2 + sigma2 / n)) + 0.5 * ln(sum(1 / (gr.tau2 + sigma2 / n))), 6) AS nll FROM dv CROSS JOIN gr GROUP BY k),
cl AS (SELECT actor_id, n, n * m AS s, ss + n * m * m AS q, n * m * m AS b FROM own), cd AS (SELECT *, {closed.poisson_weight(_bits('variance', 'actor_id'))} AS k FROM cl CROSS JOIN {_draws(40)}), ck AS (SELECT draw, sum(k)::DOUBLE AS g, sum(k * n)::DOUBLE AS t, sum(k * s) AS s, sum(k * q) AS q, sum(k * b) AS b, sum(k * n * n)::DOUBLE AS nn FROM cd GROUP BY 1)
SELECT round(sigma2, 2) AS sigma2, round(tau2, 1) AS tau2_moments, round(greatest(0, anova), 1) AS tau2_anova, (SELECT round(tau2, 2) FROM li ORDER BY nll, k LIMIT 1) AS tau2_reml, (SELECT round(quantile_cont({_ANOVA}, 0.025), 1) FROM ck) AS tau2_low, (SELECT round(quantile_cont({_ANOVA}, 0.975), 1) FROM ck) AS tau2_high, (SELECT round(quantile_cont({_SIGMA}, 0.025), 1) FROM ck) AS sigma2_low, (SELECT round(quantile_cont({_SIGMA}, 0.975), 1) FROM ck) AS sigma2_high FROM mo""")
def _(t):
    own = cut(coh(t).groupBy("actor_id").agg(N().alias("n"), F.avg("y").alias("m"), (N() * F.var_pop("y")).alias("ss")), "own")
    tt = own.agg((F.sum("ss") / (F.sum("n") - N())).alias("sigma2"), F.sum("n").alias("t"), N().alias("g"), (F.sum(C("n") * C("m")) / F.sum("n")).alias("gm"), F.sum(C("n") * C("n")).alias("nn"))
    dv = own.crossJoin(F.broadcast(tt)).withColumn("dev", (C("m") - C("gm")) * (C("m") - C("gm")))
    first = lambda c: F.first(c)
    n0 = (first("t") - first("nn") / first("t")) / (first("g") - 1)
    nd = F.sum(C("n") * C("dev"))
    mo = cut(dv.agg(first("sigma2").alias("sigma2"), F.greatest(F.lit(0.0), (nd - (first("g") - 1) * first("sigma2")) / (first("t") - first("nn") / first("t"))).alias("tau2"), ((nd / (first("g") - 1) - first("sigma2")) / n0).alias("anova"), (nd / first("t")).alias("top")), "moments")
    # restricted likelihood on a grid that spans twice the variance of the means
    grid = mo.select("top", F.explode(F.sequence(F.lit(0), F.lit(_GRID - 1))).alias("k")).select("k", (C("top") * C("k") / float(_GRID // 2)).alias("x"))
    v = C("x") + C("sigma2") / C("n")
    nll = dv.crossJoin(F.broadcast(grid)).groupBy("k", "x").agg(F.round(F.sum(0.5 * F.log(v) + 0.5 * C("dev") / v) + 0.5 * F.log(F.sum(1 / v)), 6).alias("nll"))
    best = nll.agg(F.min(F.struct("nll", "k", "x"))["x"].alias("reml"))
    cl = own.select("actor_id", F.lit(1).alias("g"), C("n").alias("t"), (C("n") * C("m")).alias("s"), (C("ss") + C("n") * C("m") * C("m")).alias("q"), (C("n") * C("m") * C("m")).alias("b"), (C("n") * C("n")).alias("nn"))
    ck = stats.bootstrap_sums(cl, "actor_id", ["g", "t", "s", "q", "b", "nn"], 40, "variance")
    ends = ck.agg(*(F.round(F.percentile(F.expr(e), q), 1).alias(n) for n, e, q in (("tau2_low", _ANOVA, 0.025), ("tau2_high", _ANOVA, 0.975), ("sigma2_low", _SIGMA, 0.025), ("sigma2_high", _SIGMA, 0.975))))
    return mo.select(R("sigma2", 2), F.round("tau2", 1).alias("tau2_moments"), F.round(F.greatest(F.lit(0.0), C("anova")), 1).alias("tau2_anova")).crossJoin(best.select(F.round("reml", 2).alias("tau2_reml"))).crossJoin(ends)


_FOLD_OWN = "fo AS (SELECT s.season, actor_id, count(*) AS n, avg(y) AS m, count(*) * var_pop(y) AS ss FROM seasons s JOIN coh c ON c.season < s.season GROUP BY ALL)"


@query("K26_shrinkage_oos", f"""WITH {COH}, {_FOLD_OWN}, ft AS (SELECT season, CASE WHEN sum(n) > count(*) THEN sum(ss) / (sum(n) - count(*)) END AS sigma2, sum(n) AS t, count(*) AS g, sum(n * m) / sum(n) AS gm, sum(n * n)::DOUBLE AS nn FROM fo GROUP BY 1), dv AS (SELECT fo.season, actor_id, n, m, sigma2, t, g, gm, nn, (m - gm) * (m - gm) AS dev FROM fo JOIN ft USING (season) WHERE sigma2 IS NOT NULL),
mo AS (SELECT season, greatest(0, (sum(n * dev) - (any_value(g) - 1) * any_value(sigma2)) / (any_value(t) - any_value(nn) / any_value(t))) AS moment, sum(n * dev) / any_value(t) AS top FROM dv GROUP BY 1),
gr AS (SELECT season, k, top * k / 50.0::DOUBLE AS x FROM mo CROSS JOIN (SELECT unnest(range(100)) AS k)), li AS (SELECT season, k, any_value(x) AS x, round(sum(0.5 * ln(x + sigma2 / n) + 0.5 * dev / (x + sigma2 / n)) + 0.5 * ln(sum(1 / (x + sigma2 / n))), 5) AS nll FROM dv JOIN gr USING (season) GROUP BY season, k), re AS (SELECT season, arg_min(x, (nll, k)) AS reml FROM li GROUP BY 1),
h AS (SELECT c.season, c.y, m AS raw, gm + CASE WHEN moment > 0 THEN moment / (moment + sigma2 / n) ELSE 0 END * (m - gm) AS moment_p, gm + CASE WHEN reml > 0 THEN reml / (reml + sigma2 / n) ELSE 0 END * (m - gm) AS reml_p FROM coh c JOIN dv USING (season, actor_id) JOIN mo USING (season) JOIN re USING (season))
SELECT season, count(*) AS n_rows, round(avg(abs(y - raw)), 4) AS raw_mae, round(avg(abs(y - moment_p)), 3) AS moment_mae, round(avg(abs(y - reml_p)), 3) AS reml_mae FROM h GROUP BY 1""")
def _(t):
    c = cut(coh(t).select("actor_id", "season", "y"), "rows")
    fo = cut(stats.earlier_means(c, "actor_id", "season", "y", t.seasons).withColumnRenamed("season", "fold"), "folds")
    ft = fo.groupBy("fold").agg(F.when(F.sum("n") > N(), F.sum("ss") / F.when(F.sum("n") > N(), F.sum("n") - N())).alias("sigma2"), F.sum("n").alias("t"), N().alias("g"), (F.sum(C("n") * C("m")) / F.sum("n")).alias("gm"), F.sum(C("n") * C("n")).alias("nn"))
    dv = fo.join(F.broadcast(ft), "fold").where("sigma2 IS NOT NULL").withColumn("dev", (C("m") - C("gm")) * (C("m") - C("gm")))
    nd = F.sum(C("n") * C("dev"))
    mo = dv.groupBy("fold").agg(F.greatest(F.lit(0.0), (nd - (F.first("g") - 1) * F.first("sigma2")) / (F.first("t") - F.first("nn") / F.first("t"))).alias("moment"), (nd / F.first("t")).alias("top"))
    grid = mo.select("fold", "top", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k")).select("fold", "k", (C("top") * C("k") / 50.0).alias("x"))
    v = C("x") + C("sigma2") / C("n")
    nll = dv.join(F.broadcast(grid), "fold").groupBy("fold", "k", "x").agg(F.round(F.sum(0.5 * F.log(v) + 0.5 * C("dev") / v) + 0.5 * F.log(F.sum(1 / v)), 5).alias("nll"))
    reml = nll.groupBy("fold").agg(F.min(F.struct("nll", "k", "x"))["x"].alias("reml"))
    small = cut(mo.drop("top").join(reml, "fold"), "tau2")
    own = dv.drop("dev").join(F.broadcast(small), "fold").withColumnRenamed("fold", "season")
    shrunk = lambda tau: C("gm") + F.when(C(tau) > 0, C(tau) / (C(tau) + C("sigma2") / C("n"))).otherwise(0.0) * (C("m") - C("gm"))
    h = c.join(own, ["season", "actor_id"])
    err = lambda p: F.avg(F.abs(C("y") - p))
    return h.groupBy("season").agg(N().alias("n_rows"), F.round(err(C("m")), 4).alias("raw_mae"), F.round(err(shrunk("moment")), 3).alias("moment_mae"), F.round(err(shrunk("reml")), 3).alias("reml_mae"))


@query("K27_residualise_pair", f"""WITH {PAIRS}, r AS (SELECT regr_slope(y, prior_x1) AS b1, regr_intercept(y, prior_x1) AS a1, regr_slope(prior_x1, y) AS b2, regr_intercept(prior_x1, y) AS a2, avg(y) AS my, stddev_pop(y) AS sy, avg(prior_x1) AS mx, stddev_pop(prior_x1) AS sx, corr(y, prior_x1) AS rr FROM pairs)
SELECT actor_id, season, round(y - a1 - b1 * prior_x1, 3) AS residual_y, round(prior_x1 - a2 - b2 * y, 7) AS residual_x, round(((y - my) / sy + (prior_x1 - mx) / sx) / 2, 5) AS shared, round(rr * rr, 6) AS shared_variance FROM pairs CROSS JOIN r""")
def _(t):
    p = cut(pairs(t), "pairs")
    m = closed.chain(closed.sums(p.withColumn("one", F.lit(1.0)), ["prior_x1"], [], "y", "one"), closed.moment_stages(1))
    line = cut(m.select("m1", "my", F.sqrt("c11").alias("sx"), F.sqrt("cyy").alias("sy"), (C("c1y") / C("c11")).alias("b1"), (C("c1y") / C("cyy")).alias("b2"), (C("c1y") * C("c1y") / (C("c11") * C("cyy"))).alias("rr")), "line")
    y, x = C("y") - C("my"), C("prior_x1") - C("m1")
    return p.crossJoin(F.broadcast(line)).select("actor_id", "season", F.round(y - C("b1") * x, 3).alias("residual_y"), F.round(x - C("b2") * y, 7).alias("residual_x"), F.round((y / C("sy") + x / C("sx")) / 2, 5).alias("shared"), F.round("rr", 6).alias("shared_variance"))


_ERAS = ["early", "middle", "late"]


@query("K52_fold_quality", f"""WITH {PAIRS}, pe AS (SELECT *, {ERA} AS era FROM pairs), pl AS (SELECT season, sum(plays)::DOUBLE / count(*) AS play_rate FROM coh GROUP BY 1),
f AS (SELECT s.season, count(*) FILTER (WHERE p.season = s.season) AS target_rows, count(*) FILTER (WHERE p.season < s.season) AS train_rows, count(DISTINCT CASE WHEN p.season < s.season THEN p.season END) AS train_seasons, {', '.join(f"count(*) FILTER (WHERE p.season < s.season AND era = '{e}') AS train_{e}" for e in _ERAS)} FROM seasons s CROSS JOIN pe p GROUP BY 1),
g AS (SELECT f.*, round(play_rate, 6) AS play_rate, array_to_string(list_filter([CASE WHEN target_rows < 20 THEN 'few_targets' END, CASE WHEN train_rows < 120 THEN 'few_rows' END, CASE WHEN train_seasons < 3 THEN 'few_seasons' END, CASE WHEN coalesce(play_rate, 0) < 50 THEN 'few_plays' END], lambda x: x IS NOT NULL), '|') AS failures FROM f LEFT JOIN pl USING (season))
SELECT *, failures = '' AS credible FROM g""")
def _(t):
    p = pairs(t).withColumn("era", era())
    per = p.groupBy("season").agg(N().alias("n"), *(F.count_if(C("era") == e).alias(e) for e in _ERAS))
    rate = coh(t).groupBy("season").agg((F.sum("plays") / N()).alias("play_rate"))
    full = t.seasons.join(per, "season", "left").join(rate, "season", "left")
    w = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)  # a row a season
    zero = F.lit(0)
    f = full.select("season", F.coalesce("n", zero).alias("target_rows"), F.coalesce(F.sum("n").over(w), zero).alias("train_rows"), F.count("n").over(w).alias("train_seasons"), *(F.coalesce(F.sum(e).over(w), zero).alias(f"train_{e}") for e in _ERAS), "play_rate")
    why = F.array_compact(F.array(F.when(C("target_rows") < 20, "few_targets"), F.when(C("train_rows") < 120, "few_rows"), F.when(C("train_seasons") < 3, "few_seasons"), F.when(F.coalesce("play_rate", F.lit(0.0)) < 50, "few_plays")))
    return f.withColumn("play_rate", F.round("play_rate", 6)).withColumn("failures", F.array_join(why, "|")).withColumn("credible", C("failures") == "")


@query("K53_stability_report", f"""WITH {PAIRS}, al AS (SELECT c.actor_id, c.season, c.w, c.y, c.x1, p.prior_y, p.prior_x1 FROM coh c LEFT JOIN pairs p USING (actor_id, season)), l AS (SELECT 'y' AS feature, season, w, y AS a, prior_y AS b FROM al UNION ALL SELECT 'x1', season, w, x1, prior_x1 FROM al)
SELECT feature, count(b) AS pairs, round(count(b)::DOUBLE / count(*), 6) AS coverage, round(corr(a, b), 5) AS r, {', '.join(f'round(corr(a, b) FILTER (WHERE b IS NOT NULL AND {c}), 5) AS {n}' for n, c in (('early', 'season <= 1998'), ('late', 'season > 1998'), ('low_volume', 'w < 2000'), ('high_volume', 'w >= 2000')))},
  count(b) >= 100 AS enough, corr(a, b) >= 0.25 AS correlated, count(b) >= 100 AND corr(a, b) >= 0.25 AS passed FROM l GROUP BY 1""")
def _(t):
    rows = lag_join(coh(t).select("actor_id", "season", "y", "x1", "w"), ["actor_id"], "season", ["y", "x1"])
    rows = rows.select("season", "w", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), C(n).alias("a"), C(f"prior_{n}").alias("b")) for n in ("y", "x1")))).alias("f")).select("season", "w", "f.*")
    part = lambda ok: F.round(stats.pearson(F.when(ok, C("a")), F.when(ok, C("b"))), 5)
    n, r = F.count("b"), stats.pearson("a", "b")
    return rows.groupBy("feature").agg(n.alias("pairs"), F.round(n / N(), 6).alias("coverage"), F.round(r, 5).alias("r"), part(C("season") <= 1998).alias("early"), part(C("season") > 1998).alias("late"), part(C("w") < 2000).alias("low_volume"), part(C("w") >= 2000).alias("high_volume"), (n >= 100).alias("enough"), (r >= 0.25).alias("correlated"), ((n >= 100) & (r >= 0.25)).alias("passed"))


_MAIN = "st AS (SELECT actor_id, season, opponent_id, CAST(sum(volume) AS BIGINT) AS v FROM plays GROUP BY 1, 2, 3), mn AS (SELECT actor_id, season, arg_max(opponent_id, (v, opponent_id)) AS main FROM st GROUP BY 1, 2), ch AS (SELECT p.*, a.main <> b.main AS changer FROM pairs p JOIN mn a USING (actor_id, season) JOIN mn b ON b.actor_id = p.actor_id AND b.season = p.season - 1)"


def changers(t):
    """Pairs with whether the actor's main opponent changed."""
    stints = t.plays.groupBy("actor_id", "season", "opponent_id").agg(F.sum("volume").alias("v"))
    main = stints.groupBy("actor_id", "season").agg(F.max(F.struct("v", "opponent_id"))["opponent_id"].alias("main"))
    return pairs(t).join(lag_join(main, ["actor_id"], "season", ["main"], how="inner"), ["actor_id", "season"]).withColumn("changer", C("main") != C("prior_main"))


@query("K54_portability_report", f"WITH {PAIRS}, {_MAIN}, {_corr_boot_sql('ch', 'actor_id', 'prior_y', 'y', 40, 'port', 'changer, ')}, g AS (SELECT changer, count(*) AS n, {CORR.format(x='y', y='prior_y')} AS r FROM ch GROUP BY 1) SELECT changer, n, round(r, 5) AS r, round(low, 5) AS low, n >= 50 AND r >= 0.2 AND low > 0 AS passed FROM g JOIN cb USING (changer)")
def _(t):
    p = cut(changers(t).select("actor_id", "changer", "y", "prior_y"), "pairs")
    g = p.groupBy("changer").agg(N().alias("n"), stats.pearson("y", "prior_y").alias("r"))
    b = stats.correlation_bootstrap(p, "actor_id", "prior_y", "y", 40, "port", ["changer"])
    return g.join(b, "changer").select("changer", "n", R("r", 5), R("low", 5), ((C("n") >= 50) & (C("r") >= 0.2) & (C("low") > 0)).alias("passed"))


#: spec -> (rows, weight): filters, weights and blocks.
SPECS = {"all": ("true", "w"), "unweighted": ("true", "1"), "root_weight": ("true", "sqrt(w)"), "heavy": ("w >= 2000", "w"), "light": ("w < 2000", "w"), "late": ("season >= 1999", "w"), "early": ("season < 1999", "w"), "capped": ("abs(y - prior_y) < 400", "w")}


def _spec_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS spec, CAST(actor_id % 4 AS INT) AS role, y, prior_y, CAST({w} AS DOUBLE) AS sw FROM pairs WHERE {c}" for n, (c, w) in SPECS.items())


_SPEC_G = ", ".join(f"{e} AS {n}" for n, e in closed.sum_expressions(["prior_y"], w="sw").items())


@query("K57_sensitivity_grid", f"WITH {PAIRS}, sp AS ({_spec_sql()}), g AS (SELECT spec, role, {_SPEC_G} FROM sp GROUP BY 1, 2), f AS ({closed.fit_sql('g', 'spec, role, ', 1, [1], '0')}) SELECT spec, role, f.n, round(b1, 4) AS slope, round(b0, 2) AS intercept, round((g.sy - g.s1) / g.w, 3) AS shift FROM f JOIN g USING (spec, role)")
def _(t):
    own = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(n).alias("spec"), F.expr(f"CAST({w} AS DOUBLE)").alias("sw"))) for n, (c, w) in SPECS.items())))
    rows = pairs(t).withColumn("s", F.explode(own)).select((C("actor_id") % 4).cast("int").alias("role"), "y", "prior_y", "s.*")
    g = cut(closed.sums(rows, ["prior_y"], ["spec", "role"], w="sw"), "moments")
    return closed.chain(g, [*closed.moment_stages(1), *closed.solve_stages([1], "0", 1)]).select("spec", "role", "n", F.round("b1", 4).alias("slope"), F.round("b0", 2).alias("intercept"), F.round(C("my") - C("m1"), 3).alias("shift"))


@query("K61_call_repeatability", f"WITH {PAIRS}, s AS (SELECT season, count(*) AS n, {CORR.format(x='x1', y='prior_x1')} AS r, avg(x1) AS m FROM pairs GROUP BY 1) SELECT actor_id, season, n, round(r, 5) AS r, round(2 * r / (1 + r), 5) AS reliability, round(m + greatest(0, r) * (x1 - m), 6) AS shrunk FROM pairs JOIN s USING (season)")
def _(t):
    p = pairs(t).select("actor_id", "season", "x1", "prior_x1")
    s = p.groupBy("season").agg(N().alias("n"), stats.pearson("x1", "prior_x1").alias("r"), F.avg("x1").alias("m"))
    return p.join(F.broadcast(s), "season").select("actor_id", "season", "n", R("r", 5), F.round(2 * C("r") / (1 + C("r")), 5).alias("reliability"), F.round(C("m") + F.greatest(F.lit(0.0), C("r")) * (C("x1") - C("m")), 6).alias("shrunk"))


@query("K63_aggregation_sensitivity", f"""WITH hv AS (SELECT actor_id, season, (week - 1) // 6 AS half, sum(value)::DOUBLE AS v, sum(volume)::DOUBLE AS w, count(*) AS n, sum(value::DOUBLE / volume) AS u FROM plays GROUP BY ALL),
cell AS (SELECT actor_id, season, half, v, w, n, u FROM hv UNION ALL SELECT actor_id, season, -1, sum(v), sum(w), sum(n), sum(u) FROM hv GROUP BY actor_id, season), lg AS (SELECT season, half, sum(v) / sum(w) AS league FROM cell GROUP BY 1, 2),
l AS (SELECT actor_id, season, half, unnest(['weighted', 'shrunk', 'delta', 'unweighted']) AS method, unnest([v / w, v / (w + 400), v / w - league, u / n]) AS x FROM cell JOIN lg USING (season, half)),
yy AS (SELECT a.method, count(*) AS pairs, corr(a.x, b.x) AS r FROM l a JOIN l b ON a.actor_id = b.actor_id AND a.method = b.method AND a.season = b.season + 1 WHERE a.half = -1 AND b.half = -1 GROUP BY 1), hh AS (SELECT a.method, corr(a.x, b.x) AS r FROM l a JOIN l b ON a.actor_id = b.actor_id AND a.method = b.method AND a.season = b.season WHERE a.half = 0 AND b.half = 1 GROUP BY 1)
SELECT method, pairs, round(yy.r, 5) AS r, round(hh.r, 5) AS context_r FROM yy JOIN hh USING (method)""")
def _(t):
    half = F.expr("(week - 1) DIV 6")
    hv = t.plays.groupBy("actor_id", "season", half.alias("half")).agg(F.sum("value").alias("v"), F.sum("volume").alias("w"), N().alias("n"), F.sum(C("value") / C("volume")).alias("u"))
    cell = hv.withColumn("half", F.explode(F.array("half", F.lit(-1).cast("long")))).groupBy("actor_id", "season", "half").agg(*(F.sum(c).alias(c) for c in "vwnu"))
    cell = cut(cell, "cells")
    league = cell.groupBy("season", "half").agg((F.sum("v") / F.sum("w")).alias("league"))
    values = {"weighted": C("v") / C("w"), "shrunk": C("v") / (C("w") + 400), "delta": C("v") / C("w") - C("league"), "unweighted": C("u") / C("n")}
    l = cell.join(F.broadcast(league), ["season", "half"]).select("actor_id", "season", "half", F.explode(F.array(*(F.struct(F.lit(n).alias("method"), e.alias("x")) for n, e in values.items()))).alias("m")).select("actor_id", "season", "half", "m.*")
    years = lag_join(l.where("half = -1"), ["actor_id", "method"], "season", ["x"], how="inner").groupBy("method").agg(N().alias("pairs"), F.round(stats.pearson("x", "prior_x"), 5).alias("r"))
    halves = l.where("half >= 0").groupBy("actor_id", "season", "method").agg(F.max(F.when(C("half") == 0, C("x"))).alias("a"), F.max(F.when(C("half") == 1, C("x"))).alias("b"))
    return years.join(halves.groupBy("method").agg(F.round(stats.pearson("a", "b"), 5).alias("context_r")), "method")


_GRAINS = {"actor_season": ["actor_id", "team_id", "season"], "actor": ["actor_id"], "team_season": ["team_id", "season"], "team": ["team_id"]}
_SPANS = {"all": "true", "from_1998": "season >= 1998"}


@query("K64_grain_overlap", f"WITH {COH} " + " UNION ALL ".join(f"SELECT '{g}' AS grain, '{s}' AS span, count(*) AS n, round(corr(y, x1), 5) AS r FROM (SELECT {', '.join(k)}, sum(y * w) / sum(w) AS y, sum(x1 * w) / sum(w) AS x1 FROM coh WHERE {c} GROUP BY ALL)" for g, k in _GRAINS.items() for s, c in _SPANS.items()))
def _(t):
    base = cut(coh(t).select("actor_id", "team_id", "season", "y", "x1", "w"), "rows")
    rows = base.withColumn("span", F.explode(F.array_compact(F.array(*(F.when(F.expr(c), n) for n, c in _SPANS.items())))))
    out = None
    for name, keys in _GRAINS.items():
        g = rows.groupBy("span", *keys).agg((F.sum(C("y") * C("w")) / F.sum("w")).alias("y"), (F.sum(C("x1") * C("w")) / F.sum("w")).alias("x1"))
        one = g.groupBy("span").agg(N().alias("n"), F.round(stats.pearson("y", "x1"), 5).alias("r")).select(F.lit(name).alias("grain"), "span", "n", "r")
        out = one if out is None else out.unionByName(one)
    return out


@query("K66_qp_overlap", f"""WITH {COH}, sp AS (SELECT span, round(x1, 9) AS a, round(x2, 9) AS b FROM ({WINDOWS})), r AS (SELECT *, rank() OVER (PARTITION BY span ORDER BY a) + (count(*) OVER (PARTITION BY span, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY span ORDER BY b) + (count(*) OVER (PARTITION BY span, b) - 1) / 2 AS rb FROM sp)
SELECT span, count(*) AS n, round(corr(a, b), 5) AS r, round(corr(ra, rb), 5) AS spearman, round(corr(a, b) * corr(a, b), 5) AS shared_variance, round(avg(((a > 0.3) = (b > 0.5))::INT), 6) AS agreement FROM r GROUP BY 1""")
def _(t):
    rows = windowed(coh(t)).select("span", F.round("x1", 9).alias("a"), F.round("x2", 9).alias("b"))
    rows = cut(rows, "spans")
    out = None
    for span in ("all", "from_1997", "without_1998"):
        ranked = stats.global_ranks(rows.where(C("span") == span), ["a", "b"])
        r = stats.pearson("a", "b")
        one = ranked.agg(N().alias("n"), F.round(r, 5).alias("r"), F.round(stats.pearson("a_rank", "b_rank"), 5).alias("spearman"), F.round(r * r, 5).alias("shared_variance"), F.round(F.avg(((C("a") > 0.3) == (C("b") > 0.5)).cast("int")), 6).alias("agreement")).select(F.lit(span).alias("span"), "*")
        out = one if out is None else out.unionByName(one)
    return out
