"""Choices: a logistic model of the call, the value of each choice, propensity weights and the support guard (family K)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import closed, models, neighbours, order, stats
from ..sources.shared import cut
from .registry import query

C = F.col
N = lambda: F.count(F.lit(1))
R = lambda c, n=6: F.round(C(c), n).alias(c)
STEPS = 8


def logistic_sql(cells: str, tag: str = "") -> str:
    """Newton steps lg0 .. lg8 of a logistic regression of h among n on d and x, each a solve of three equations in closed form."""
    out = [f"lg{tag}0 AS (SELECT 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2)"]
    for i in range(STEPS):
        sums = f"SELECT b0, b1, b2, sum(h - n * q) AS g0, sum((h - n * q) * d) AS g1, sum((h - n * q) * x) AS g2, sum(n * q * (1 - q)) AS a, sum(n * q * (1 - q) * d) AS b, sum(n * q * (1 - q) * x) AS c, sum(n * q * (1 - q) * d * d) AS e, sum(n * q * (1 - q) * d * x) AS f, sum(n * q * (1 - q) * x * x) AS i FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * d + b2 * x))) AS q FROM {cells} CROSS JOIN lg{tag}{i}) GROUP BY b0, b1, b2"
        det = "(a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c))"
        out.append(f"""lg{tag}{i + 1} AS (SELECT b0 + (g0 * (e * i - f * f) + g1 * (c * f - b * i) + g2 * (b * f - c * e)) / {det} AS b0, b1 + (g0 * (f * c - b * i) + g1 * (a * i - c * c) + g2 * (c * b - a * f)) / {det} AS b1, b2 + (g0 * (b * f - e * c) + g1 * (b * c - a * f) + g2 * (a * e - b * b)) / {det} AS b2 FROM ({sums}))""")
    return ", ".join(out)


def cells_of(t, *keys):
    """Counts of plays and attempts per code of the two covariates: what a logistic regression on them needs."""
    return t.plays.groupBy(*keys, C("discount").alias("d"), C("tax").alias("x")).agg(N().alias("n"), F.count_if("attempt").alias("h"))


_CELLS = "ce AS (SELECT discount AS d, tax AS x, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE attempt))::DOUBLE AS h FROM plays GROUP BY 1, 2)"
_VALUE = ["d", "x"]
_VS = ", ".join(f"{e} AS {n}" for n, e in closed.sum_expressions(_VALUE, "value", "1").items())


def _value_sql(name: str, where: str) -> str:
    return f"{name} AS ({closed.fit_sql(f'SELECT {_VS} FROM (SELECT discount AS d, tax AS x, value FROM plays WHERE {where})', '', 2, [1, 2], '1e1')})"


@query("K32_logistic_call_model", f"""WITH {_CELLS}, {logistic_sql('ce')}, {_value_sql('va', 'attempt')}, {_value_sql('vr', 'NOT attempt')},
s AS (SELECT season, team_id, attempt, value, 1 / (1 + exp(-(lg.b0 + lg.b1 * discount + lg.b2 * tax))) AS p, va.b0 + va.b1 * discount + va.b2 * tax AS ea, vr.b0 + vr.b1 * discount + vr.b2 * tax AS er FROM plays CROSS JOIN lg{STEPS} lg CROSS JOIN va CROSS JOIN vr),
a AS (SELECT *, CASE WHEN attempt THEN ea - er ELSE er - ea END AS advantage, attempt = (ea >= er) AS followed FROM s)
SELECT season, team_id, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(((p >= 0.5) = attempt)::INT), 6) AS accuracy, round(-avg(ln(CASE WHEN attempt THEN p ELSE 1 - p END)), 6) AS log_loss, round(avg(CASE WHEN attempt THEN ea ELSE er END), 3) AS expected_value, round(avg(advantage), 3) AS advantage, round(avg(followed::INT), 6) AS followed, round(avg(value) FILTER (WHERE followed), 4) AS followed_value, round(avg(value) FILTER (WHERE NOT followed), 4) AS ignored_value FROM a GROUP BY 1, 2""")
def _(t):
    p = t.plays.select("season", "team_id", "attempt", "value", C("discount").alias("d"), C("tax").alias("x"))
    b = models.logistic(cut(cells_of(t), "cells"), _VALUE, "h", "n", STEPS)
    # what each choice is worth: two ridges on the covariates, from one grouped pass
    fit = closed.fit(closed.sums(p.withColumn("one", F.lit(1.0)), _VALUE, ["attempt"], "value", "one"), ["attempt"], 2, [1, 2], "1e1")
    pick = lambda ok, c, n: F.max(F.when(ok, C(c))).alias(n)
    both = fit.groupBy().agg(*(pick(C("attempt") == ok, f"b{i}", f"{n}{i}") for n, ok in (("a", True), ("r", False)) for i in range(3)))
    s = p.crossJoin(F.broadcast(both)).select("season", "team_id", "attempt", "value", (1 / (1 + F.exp(-(float(b[0]) + float(b[1]) * C("d") + float(b[2]) * C("x"))))).alias("p"), *((C(f"{n}0") + C(f"{n}1") * C("d") + C(f"{n}2") * C("x")).alias(f"e{n}") for n in "ar"))
    a = C("attempt")
    s = s.withColumn("advantage", F.when(a, C("ea") - C("er")).otherwise(C("er") - C("ea"))).withColumn("followed", a == (C("ea") >= C("er")))
    return s.groupBy("season", "team_id").agg(
        N().alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(((C("p") >= 0.5) == a).cast("int")), 6).alias("accuracy"), F.round(-F.avg(F.log(F.when(a, C("p")).otherwise(1 - C("p")))), 6).alias("log_loss"), F.round(F.avg(F.when(a, C("ea")).otherwise(C("er"))), 3).alias("expected_value"),
        F.round(F.avg("advantage"), 3).alias("advantage"), F.round(F.avg(C("followed").cast("int")), 6).alias("followed"), F.round(F.avg(F.when(C("followed"), C("value"))), 4).alias("followed_value"), F.round(F.avg(F.when(~C("followed"), C("value"))), 4).alias("ignored_value"))


@query("K35_propensity_ipw", f"""WITH {_CELLS}, {logistic_sql('ce')}, e AS (SELECT ce.*, 1 / (1 + exp(-(b0 + b1 * d + b2 * x))) AS q FROM ce CROSS JOIN lg{STEPS}), bs AS (SELECT sum(h) / sum(n) AS base FROM ce),
r AS (SELECT round(q, 12) AS q, sum(h) AS h, sum(n - h) AS m FROM e GROUP BY 1), au AS (SELECT sum(h * (below + m / 2)) / (sum(h) * sum(m)) AS auc FROM (SELECT *, coalesce(sum(m) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r)),
w AS (SELECT p.*, least(greatest(CASE WHEN attempt THEN base / q ELSE (1 - base) / (1 - q) END, 0.1), 10) AS w FROM plays p JOIN e ON d = discount AND x = tax CROSS JOIN bs)
SELECT attempt, count(*) AS n, round(sum(w) * sum(w) / sum(w * w), 2) AS effective_n, round(avg(value), 5) AS raw_mean, round(sum(w * value) / sum(w), 4) AS weighted_mean, round(corr(value, volume), 5) AS raw_r,
  round((sum(w * value * volume) / sum(w) - sum(w * value) / sum(w) * sum(w * volume) / sum(w)) / sqrt((sum(w * value * value) / sum(w) - (sum(w * value) / sum(w)) ** 2) * (sum(w * volume * volume) / sum(w) - (sum(w * volume) / sum(w)) ** 2)), 5) AS weighted_r, (SELECT round(auc, 6) FROM au) AS auc FROM w GROUP BY 1""")
def _(t):

    cells = cut(cells_of(t), "cells")
    b = models.logistic(cells, _VALUE, "h", "n", STEPS)
    e = cells.withColumn("q", 1 / (1 + F.exp(-(float(b[0]) + float(b[1]) * C("d") + float(b[2]) * C("x")))))
    base = e.agg((F.sum("h") / F.sum("n")).alias("base"))
    # area under the curve from the counts of each score: a row a code pair
    r = e.groupBy(F.round("q", 12).alias("q")).agg(F.sum("h").alias("h"), F.sum(C("n") - C("h")).alias("m"))
    below = F.coalesce(F.sum("m").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = r.withColumn("below", below).agg((F.sum(C("h") * (C("below") + C("m") / 2)) / (F.sum("h") * F.sum("m"))).alias("auc"))
    fit = e.select(C("d").alias("discount"), C("x").alias("tax"), "q").crossJoin(base).crossJoin(auc)
    raw = F.when(C("attempt"), C("base") / C("q")).otherwise((1 - C("base")) / (1 - C("q")))
    p = t.plays.join(F.broadcast(fit), ["discount", "tax"]).withColumn("w", F.least(F.greatest(raw, F.lit(0.1)), F.lit(10.0)))
    return p.groupBy("attempt").agg(
        N().alias("n"), F.round(F.sum("w") * F.sum("w") / F.sum(C("w") * C("w")), 2).alias("effective_n"), F.round(F.avg("value"), 5).alias("raw_mean"), F.round(F.sum(C("w") * C("value")) / F.sum("w"), 4).alias("weighted_mean"),
        F.round(stats.pearson("value", "volume"), 5).alias("raw_r"), F.round(stats.weighted_correlation("value", "volume", "w"), 5).alias("weighted_r"), F.round(F.first("auc"), 6).alias("auc"))


SUPPORT = {"a": "attempts", "s": "successes", "v": "value", "x": "tax", "d": "discount"}
_V = f"v AS (SELECT team_id, season, {', '.join(f'{c}::DOUBLE / plays' + (' / 10000' if n == 'v' else '') + f' AS {n}' for n, c in SUPPORT.items())} FROM team_seasons), la AS (SELECT max(season) AS last FROM v)"
_SQUARES = " + ".join(f"(x.{n} - y.{n}) ** 2" for n in SUPPORT)


@query("K49_support_guard", f"""WITH {_V}, q AS (SELECT v.* FROM v JOIN la ON season = last), r AS (SELECT v.* FROM v JOIN la ON season < last), g AS (SELECT {', '.join(f'min({n}) AS l_{n}, max({n}) AS h_{n}' for n in SUPPORT)} FROM r),
d AS (SELECT x.team_id, min(({_SQUARES}) / {len(SUPPORT)}) AS nearest FROM q x CROSS JOIN r y GROUP BY 1),
n AS (SELECT x.team_id, x.season, min(({_SQUARES}) / {len(SUPPORT)}) AS dd FROM r x JOIN r y ON (x.team_id, x.season) <> (y.team_id, y.season) GROUP BY 1, 2), c AS (SELECT quantile_cont(dd, 0.95) AS cutoff FROM n),
j AS (SELECT q.team_id, nearest, cutoff, {' AND '.join(f'{n} BETWEEN l_{n} AND h_{n}' for n in SUPPORT)} AS in_range FROM q JOIN d USING (team_id) CROSS JOIN g CROSS JOIN c)
SELECT team_id, round(nearest, 9) AS nearest, round(cutoff, 9) AS cutoff, in_range, nearest <= cutoff AS near, in_range AND nearest <= cutoff AS supported FROM j""")
def _(t):
    scale = lambda n: 10000 if n == "v" else 1
    v = cut(t.team_seasons.select("team_id", "season", *((C(c) / C("plays") / scale(n)).alias(n) for n, c in SUPPORT.items())), "vectors")
    last = v.agg(F.max("season")).first()[0]
    last = -1 if last is None else last
    train, asked, names = v.where(C("season") < last), v.where(C("season") == last), list(SUPPORT)
    near = neighbours.nearest(asked, train, ["team_id"], names)
    own = neighbours.nearest(train, train, ["team_id", "season"], names, itself=True)
    ranges = train.agg(*(f(n).alias(f"{k}_{n}") for n in names for k, f in (("l", F.min), ("h", F.max))))
    bounds = order.quantiles(own, [], "nearest", {"cutoff": 0.95}).select("cutoff").crossJoin(ranges)
    inside = reduce(lambda a, b: a & b, (C(n).between(C(f"l_{n}"), C(f"h_{n}")) for n in names))
    close = C("nearest") <= C("cutoff")
    return asked.join(near, "team_id").crossJoin(F.broadcast(bounds)).select("team_id", R("nearest", 9), R("cutoff", 9), inside.alias("in_range"), close.alias("near"), (inside & close).alias("supported"))
