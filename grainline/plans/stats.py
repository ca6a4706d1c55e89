"""Queries of family K (statistics in closed form)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import order, stats
from ..operators.joins import lag_join
from .registry import query

C = F.col
R = lambda c, n=6: F.round(C(c), n).alias(c)

COH = "coh AS (SELECT actor_id, team_id, season, value::DOUBLE / volume AS y, attempts::DOUBLE / plays AS x1, successes::DOUBLE / plays AS x2, volume AS w, plays, attempts, successes FROM actor_seasons)"


def coh(t):
    return t.actor_seasons.select("actor_id", "team_id", "season", (C("value") / C("volume")).alias("y"), (C("attempts") / C("plays")).alias("x1"), (C("successes") / C("plays")).alias("x2"), C("volume").alias("w"), "plays", "attempts", "successes")


PAIRS = f"{COH}, pairs AS (SELECT a.actor_id, a.season, a.y, b.y AS prior_y, a.x1, b.x1 AS prior_x1, a.w FROM coh a JOIN coh b ON a.actor_id = b.actor_id AND a.season = b.season + 1)"


def pairs(t):
    return lag_join(coh(t).select("actor_id", "season", "y", "x1", "w"), ["actor_id"], "season", ["y", "x1"], how="inner")


CORR = "CASE WHEN count(*) >= 2 AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN corr({x}, {y}) END"


@query("K06_baselines_shrunk", f"""WITH {COH}, lg AS (SELECT a.season, sum(b.y * b.w) / sum(b.w) AS league FROM (SELECT DISTINCT season FROM coh) a LEFT JOIN coh b ON b.season < a.season GROUP BY 1),
h AS (SELECT a.actor_id, a.season, coalesce(sum(b.w), 0) AS hw, sum(b.y * b.w) / sum(b.w) AS history FROM coh a LEFT JOIN coh b ON a.actor_id = b.actor_id AND b.season < a.season GROUP BY 1, 2)
SELECT actor_id, season, round(league, 6) AS league, round(history, 6) AS history, round(coalesce(hw / (hw + 2000.0::DOUBLE) * history, 0) + (1 - hw / (hw + 2000.0::DOUBLE)) * league, 6) AS blend FROM h JOIN lg USING (season)""")
def _(t):
    return stats.league_shrunk(coh(t), "actor_id", "season", "y", "w", 2000.0).select("actor_id", "season", R("league"), R("history"), R("blend"))


EB = """o AS (SELECT {k}g, count(y) AS n, avg(y) AS mean, count(y) * var_pop(y) AS ss FROM src GROUP BY ALL), t AS (SELECT *, count(*) OVER w AS gg, sum(n) OVER w AS tt, sum(n * mean) OVER w / sum(n) OVER w AS grand, sum(ss) OVER w AS wi, sum(n * n) OVER w AS nn FROM o WINDOW w AS ({p})),
u AS (SELECT *, sum(n * (mean - grand) * (mean - grand)) OVER ({p}) AS be, wi / (tt - gg) AS sigma2 FROM t), v AS (SELECT *, greatest(0, (be - (gg - 1) * sigma2) / (tt - nn::DOUBLE / tt)) AS tau2 FROM u),
z AS (SELECT *, CASE WHEN tau2 > 0 THEN tau2 / (tau2 + sigma2 / n) ELSE 0 END AS shrinkage FROM v)
SELECT {k}g, n, round(mean, 5) AS mean, round(tau2, 3) AS tau2, round(shrinkage, 5) AS shrinkage, round(grand + shrinkage * (mean - grand), 4) AS posterior FROM z"""


@query("K07_eb_normal_pooling", f"WITH {COH}, src AS (SELECT actor_id AS g, y FROM coh), {EB.format(k='', p='')}")
def _(t):
    return stats.eb_pooling(coh(t).withColumnRenamed("actor_id", "g"), [], "g", "y").select("g", "n", R("mean", 5), R("tau2", 3), R("shrinkage", 5), R("posterior", 4))


@query("K09_beta_binomial_shrink", f"""WITH {COH}, pr AS (SELECT s.season, avg(c.x1) AS m, avg(c.x1 * c.x1) - avg(c.x1) * avg(c.x1) AS v FROM (SELECT DISTINCT season FROM coh) s LEFT JOIN coh c ON c.season < s.season AND c.season >= s.season - 5 GROUP BY 1),
x AS (SELECT *, CASE WHEN v > 0 AND m > 0 AND m < 1 THEN greatest(1, m * (1 - m) / v - 1) END AS k FROM coh JOIN pr USING (season)), y AS (SELECT *, (attempts + k * m) / (plays + k) AS p FROM x)
SELECT actor_id, season, round(m, 6) AS prior_mean, round(p, 6) AS posterior, round(greatest(0, p - 1.96 * sqrt(p * (1 - p) / (plays + k + 1))), 6) AS low FROM y""")
def _(t):
    out = stats.beta_binomial(coh(t), "season", "attempts", "plays").select("actor_id", "season", R("prior_mean"), R("posterior"), F.round(F.when(C("posterior").isNotNull(), C("low")).otherwise(F.lit(0.0)), 6).alias("low"))
    return out


@query("K11_k_shrinkage_grid", "SELECT actor_id, season, k, plays::DOUBLE / (plays + k) AS weight FROM actor_seasons CROSS JOIN (SELECT unnest([50, 100, 400]) AS k)")
def _(t):
    return t.actor_seasons.select("actor_id", "season", "plays", F.explode(F.array(F.lit(50), F.lit(100), F.lit(400))).alias("k")).select("actor_id", "season", "k", (C("plays") / (C("plays") + C("k"))).alias("weight"))


@query("K14_sign_flip_placebo", """
WITH s AS (SELECT actor_id, CAST(sum(value) AS BIGINT) AS s, count(*) AS n FROM plays GROUP BY 1), n AS (SELECT draw, sum(s * CASE WHEN ('0x' || substr(md5('flip|' || draw || '|' || actor_id), 1, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE / sum(n)::DOUBLE AS m FROM s CROSS JOIN (SELECT unnest(range(40)) AS draw) GROUP BY 1)
SELECT round((SELECT sum(s)::DOUBLE / sum(n)::DOUBLE FROM s), 6) AS actual, count(*) FILTER (WHERE m >= (SELECT sum(s)::DOUBLE / sum(n)::DOUBLE FROM s)) AS reached, (1 + count(*) FILTER (WHERE m >= (SELECT sum(s)::DOUBLE / sum(n)::DOUBLE FROM s)))::DOUBLE / 41 AS p FROM n""")
def _(t):
    return stats.sign_flip(t.plays, "actor_id", "value", 40, "flip").select(R("actual"), "reached", "p")


@query("K16_pearson_guarded", f"WITH {PAIRS} SELECT season, round({CORR.format(x='y', y='prior_y')}, 6) AS r FROM (SELECT season, y, CASE WHEN season = 1997 THEN 1.0 ELSE prior_y END AS prior_y FROM pairs) GROUP BY 1")
def _(t):
    rows = pairs(t).withColumn("prior_y", F.when(C("season") == 1997, 1.0).otherwise(C("prior_y")))
    return rows.groupBy("season").agg(F.round(stats.pearson("y", "prior_y"), 6).alias("r"))


RANKS = "SELECT *, rank() OVER (PARTITION BY season ORDER BY a) + (count(*) OVER (PARTITION BY season, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY season ORDER BY b) + (count(*) OVER (PARTITION BY season, b) - 1) / 2 AS rb FROM"


@query("K17_spearman_avg_rank", f"SELECT season, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM ({RANKS} (SELECT season, plays // 5 AS a, attempts // 5 AS b FROM team_seasons)) GROUP BY 1")
def _(t):
    rows = t.team_seasons.select("season", F.expr("plays div 5").alias("a"), F.expr("attempts div 5").alias("b"))
    return stats.spearman(rows, ["season"], "a", "b").select("season", "n", R("spearman"))


@query("K18_weighted_correlation", f"""WITH {PAIRS}, m AS (SELECT *, sum(w) OVER (PARTITION BY season ORDER BY y) - sum(w) OVER (PARTITION BY season, y) / 2 AS ra, sum(w) OVER (PARTITION BY season ORDER BY prior_y) - sum(w) OVER (PARTITION BY season, prior_y) / 2 AS rb FROM pairs),
c AS (SELECT *, y - sum(w * y) OVER s / sum(w) OVER s AS a, prior_y - sum(w * prior_y) OVER s / sum(w) OVER s AS b, ra - sum(w * ra) OVER s / sum(w) OVER s AS u, rb - sum(w * rb) OVER s / sum(w) OVER s AS v FROM m WINDOW s AS (PARTITION BY season))
SELECT season, count(*) AS n, round(sum(w * a * b) / sqrt(sum(w * a * a) * sum(w * b * b)), 5) AS r, round(sum(w * u * v) / sqrt(sum(w * u * u) * sum(w * v * v)), 5) AS rho, round(avg((sign(y) = sign(prior_y))::INT), 6) AS sign_agreement FROM c GROUP BY 1""")
def _(t):
    return stats.weighted_association(pairs(t), ["season"], "y", "prior_y", "w").select("season", "n", R("r", 5), R("rho", 5), R("sign_agreement"))


@query("K20_vector_distances", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, a.e AS x, b.e AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 5) AS euclidean, round(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))), 5) AS manhattan, round(1 - list_cosine_similarity(x, y), 5) AS cosine FROM p""")
def _(t):
    e = t.raw("embeddings").select("vec_id", C("embedding").alias("x"))
    nxt = t.raw("embeddings").select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("y"))
    d = stats.distances(C("x"), C("y"))
    return e.join(nxt, "vec_id").select("vec_id", *(F.round(d[k], 5).alias(k) for k in ("euclidean", "manhattan", "cosine")))


ICC = """own AS (SELECT {k}g, count(*) AS n, avg(y) AS m, count(*) * var_pop(y) AS ss FROM src GROUP BY ALL), gm AS (SELECT {k}sum(n * m) / sum(n) AS gm FROM own {g}), tt AS (SELECT {k}count(*) AS groups, sum(n)::BIGINT AS n, sum(n * (m - gm) * (m - gm)) / (count(*) - 1) AS msb, sum(ss) / (sum(n) - count(*)) AS msw, (sum(n) - sum(n * n)::DOUBLE / sum(n)) / (count(*) - 1) AS n0 FROM own {j} {g})
SELECT {k}groups, n, round((msb - msw) / (msb + (n0 - 1) * msw), 5) AS icc, round(2 * ((msb - msw) / (msb + (n0 - 1) * msw)) / (1 + (msb - msw) / (msb + (n0 - 1) * msw)), 5) AS reliability_2 FROM tt"""


WINDOWS = "SELECT 'all' AS span, * FROM coh UNION ALL SELECT 'from_1997', * FROM coh WHERE season >= 1997 UNION ALL SELECT 'without_1998', * FROM coh WHERE season <> 1998"


def windowed(df):
    tags = {"all": F.lit(True), "from_1997": C("season") >= 1997, "without_1998": C("season") != 1998}
    own = F.filter(F.array(*(F.when(c, n) for n, c in tags.items())), lambda x: x.isNotNull())
    return df.withColumn("span", F.explode(own))


@query("K69_reliability_windows", f"WITH {COH}, src AS (SELECT span, actor_id AS g, y FROM ({WINDOWS})), {ICC.format(k='span, ', g='GROUP BY span', j='JOIN gm USING (span)')}")
def _(t):
    return stats.icc(windowed(coh(t)), ["span"], "actor_id", "y").select("span", "groups", "n", R("icc", 5), R("reliability_2", 5))


@query("K23_leave_group_out", f"""WITH {COH}, p AS (SELECT team_id, season, sum(y * w) AS v, sum(w) AS w FROM coh GROUP BY 1, 2), t AS (SELECT team_id, sum(v) AS tv, sum(w) AS tw FROM p GROUP BY 1)
SELECT team_id, season, round(v / w, 5) AS actual, round(CASE WHEN tw > w THEN (tv - v) / (tw - w) END, 5) AS predicted FROM p JOIN t USING (team_id)""")
def _(t):
    return stats.leave_group_out(coh(t), "team_id", "season", "y", "w").select("team_id", "season", R("actual", 5), R("predicted", 5))


@query("K24_future_portability", f"""WITH {COH}, o AS (SELECT CAST(actor_id % 10 AS INT) AS owner, team_id, season, sum(y * w) AS v, sum(w) AS w FROM coh GROUP BY 1, 2, 3)
SELECT a.owner, a.team_id, a.season, round(a.v / a.w, 5) AS actual, round(sum(b.v) / sum(b.w), 5) AS history FROM o a LEFT JOIN o b ON a.owner = b.owner AND b.season < a.season AND b.team_id <> a.team_id GROUP BY 1, 2, 3, a.v, a.w""")
def _(t):
    # history in other groups = the owner's earlier totals less the group's own earlier ones: two windows, no theta join
    o = coh(t).groupBy((C("actor_id") % 10).cast("int").alias("owner"), "team_id", "season").agg(F.sum(C("y") * C("w")).alias("v"), F.sum("w").alias("w"))
    before = lambda *k: Window.partitionBy(*k).orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    other = lambda c: F.coalesce(F.sum(c).over(before("owner")), F.lit(0)) - F.coalesce(F.sum(c).over(before("owner", "team_id")), F.lit(0))
    out = o.select("owner", "team_id", "season", F.round(C("v") / C("w"), 5).alias("actual"), other("v").alias("hv"), other("w").alias("hw"))
    return out.select("owner", "team_id", "season", "actual", F.round(F.when(C("hw") > 0, C("hv") / C("hw")), 5).alias("history"))


@query("K33_classifier_metrics", """
WITH p AS (SELECT season, attempt::INT AS y, 0.2 + 0.1 * discount / 2 AS q FROM plays)
SELECT season, count(*) AS n, round(avg(((q >= 0.5) = (y = 1))::INT), 6) AS accuracy, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS log_loss, round(avg((q - y) * (q - y)), 6) AS brier, round(avg(y), 6) AS base_rate FROM p GROUP BY 1""")
def _(t):
    p = t.plays.select("season", C("attempt").cast("int").alias("y"), (0.2 + 0.1 * C("discount") / 2).alias("q"))
    y, q = C("y"), C("q")
    return p.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((q >= 0.5) == (y == 1)).cast("int")), 6).alias("accuracy"), F.round(-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q)), 6).alias("log_loss"), F.round(F.avg((q - y) * (q - y)), 6).alias("brier"), F.round(F.avg("y"), 6).alias("base_rate"))


@query("K34_threshold_validation", "SELECT threshold, round(avg(CASE WHEN discount >= threshold THEN value END), 6) AS followed, round(avg(CASE WHEN discount < threshold THEN value END), 6) AS ignored, count(*) FILTER (WHERE discount >= threshold) AS n_followed FROM plays CROSS JOIN (SELECT unnest([2, 5, 8]) AS threshold) GROUP BY 1")
def _(t):
    rows = t.plays.select("discount", "value", F.explode(F.array(F.lit(2), F.lit(5), F.lit(8))).alias("threshold"))
    hit = C("discount") >= C("threshold")
    return rows.groupBy("threshold").agg(F.round(F.avg(F.when(hit, C("value"))), 6).alias("followed"), F.round(F.avg(F.when(~hit, C("value"))), 6).alias("ignored"), F.count_if(hit).alias("n_followed"))


@query("K36_standardised_difference", "SELECT season, round((avg(value) FILTER (WHERE attempt) - avg(value) FILTER (WHERE NOT attempt)) / sqrt((var_pop(value) FILTER (WHERE attempt) + var_pop(value) FILTER (WHERE NOT attempt)) / 2), 6) AS d FROM plays GROUP BY 1")
def _(t):
    a, b = F.when(C("attempt"), C("value")), F.when(~C("attempt"), C("value"))
    return t.plays.groupBy("season").agg(F.round((F.avg(a) - F.avg(b)) / F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2), 6).alias("d"))


@query("K37_missing_data_stress", f"WITH {PAIRS} SELECT season, count(*) AS n, round(corr(y, prior_y), 6) AS r, CAST(ceil(round(count(*) * abs(corr(y, prior_y)), 6)) AS BIGINT) AS rows_to_null FROM pairs GROUP BY 1")
def _(t):
    r = stats.pearson("y", "prior_y")
    n = F.count(F.lit(1))
    return pairs(t).groupBy("season").agg(n.alias("n"), F.round(r, 6).alias("r"), F.ceil(F.round(n * F.abs(r), 6)).cast("long").alias("rows_to_null"))


PRED = f"{PAIRS}, preds AS (SELECT actor_id, season, 'prior' AS model, y, prior_y AS p FROM pairs UNION ALL SELECT actor_id, season, 'half', y, prior_y / 2 FROM pairs UNION ALL SELECT actor_id, season, 'zero', y, 0.0 FROM pairs)"


def preds(t):
    models = F.array(*(F.struct(F.lit(n).alias("model"), p.alias("p")) for n, p in (("prior", C("prior_y")), ("half", C("prior_y") / 2), ("zero", C("prior_y") * 0.0))))
    return pairs(t).select("actor_id", "season", "y", F.explode(models).alias("m")).select("actor_id", "season", "m.model", "y", "m.p")


@query("K39_conformal_radius", f"""WITH {PRED}, j AS (SELECT s.season AS target, abs(y - p) AS r FROM seasons s JOIN preds q ON q.season < s.season AND q.season >= s.season - 5 AND model = 'prior'), k AS (SELECT target, r, row_number() OVER (PARTITION BY target ORDER BY r) AS k, count(*) OVER (PARTITION BY target) AS n FROM j)
SELECT target, any_value(n) AS n, round(max(CASE WHEN k = CAST(ceil((n + 1) * 0.8::DOUBLE) AS BIGINT) THEN r END), 5) AS radius FROM k GROUP BY 1""")
def _(t):
    rows = preds(t).where("model = 'prior'").withColumn("e", C("y") - C("p"))
    got = order.conformal_radii(rows, [], "season", t.seasons, "e", {"radius": 0.8})
    return got.select(C("season").alias("target"), C("residuals").alias("n"), R("radius", 5))


GAIN = "g AS (SELECT season, o.model, avg(abs(b.y - b.p)) - avg(abs(o.y - o.p)) AS gain, count(*) AS n FROM preds b JOIN preds o USING (actor_id, season) WHERE b.model = 'zero' AND o.model <> 'zero' GROUP BY 1, 2)"


def gains(t):
    # paired rows come from one pass: the base model's error joins the others within (actor, season)
    p = preds(t).withColumn("e", F.abs(C("y") - C("p")))
    base = p.where("model = 'zero'").select("actor_id", "season", C("e").alias("b"))
    return p.where("model <> 'zero'").join(base, ["actor_id", "season"]).groupBy("season", "model").agg((F.avg("b") - F.avg("e")).alias("gain"), F.count(F.lit(1)).alias("n"))


@query("K43_paired_comparison", f"WITH {PRED}, {GAIN} SELECT season, model, n, round(gain, 5) AS gain FROM g")
def _(t):
    return gains(t).select("season", "model", "n", R("gain", 5))


@query("K50_decision_gates", f"""WITH {PAIRS}, a AS (SELECT count(*) >= 100 AS enough, corr(y, prior_y) > 0.9 AS strong, count(DISTINCT season) >= 5 AS seasons_ok FROM pairs)
SELECT '{{"enough":' || enough || ',"strong":' || strong || ',"seasons_ok":' || seasons_ok || '}}' AS gates, array_to_string(list_filter([CASE WHEN NOT enough THEN 'enough' END, CASE WHEN NOT strong THEN 'strong' END, CASE WHEN NOT seasons_ok THEN 'seasons_ok' END], lambda x: x IS NOT NULL), '|') AS failed FROM a""")
def _(t):
    a = pairs(t).agg((F.count(F.lit(1)) >= 100).alias("enough"), (stats.pearson("y", "prior_y") > 0.9).alias("strong"), (F.count_distinct("season") >= 5).alias("seasons_ok"))
    failed = F.filter(F.array(*(F.when(~C(c), c) for c in a.columns)), lambda x: x.isNotNull())
    return a.select(F.to_json(F.struct(*a.columns)).alias("gates"), F.array_join(failed, "|").alias("failed"))


@query("K58_evidence_grades", """
SELECT actor_id, count(*) AS seasons_n, CAST(sum(volume) AS BIGINT) AS volume, CASE WHEN count(*) >= 6 AND sum(volume) >= 12000 THEN 'high' WHEN count(*) >= 3 AND sum(volume) >= 6000 THEN 'medium' WHEN count(*) >= 2 THEN 'low' ELSE 'suppressed' END AS grade FROM actor_seasons GROUP BY 1""")
def _(t):
    s = t.actor_seasons.groupBy("actor_id").agg(F.count(F.lit(1)).alias("seasons_n"), F.sum("volume").alias("volume"))
    n, v = C("seasons_n"), C("volume")
    return s.withColumn("grade", F.when((n >= 6) & (v >= 12000), "high").when((n >= 3) & (v >= 6000), "medium").when(n >= 2, "low").otherwise("suppressed"))


@query("K59_temporal_windows", f"WITH {PAIRS} SELECT span, count(*) AS pairs, round(corr(y, prior_y), 5) AS r FROM (SELECT 'all' AS span, * FROM pairs UNION ALL SELECT 'from_1997', * FROM pairs WHERE season >= 1997 UNION ALL SELECT 'without_1998', * FROM pairs WHERE season <> 1998) GROUP BY 1")
def _(t):
    return windowed(pairs(t)).groupBy("span").agg(F.count(F.lit(1)).alias("pairs"), F.round(stats.pearson("y", "prior_y"), 5).alias("r"))


