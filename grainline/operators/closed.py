"""Ridge regressions of up to three features in closed form, as SQL expressions over sums (family K).

A fit needs the weighted sums of its features, outcome and their products only. Sums are grouped, cumulated, subtracted or
resampled as rows, and solved by expressions on the executors: no row of a group reaches the driver, however many groups are fitted.
The outcome and the weight are columns y and w; the alpha is on standardised features, the intercept is free. A fit whose features are
constant or collinear at alpha 0 has no coefficients (NULL).

Sums and products are of differences from a centre, the mean of each column over all rows, so that an offset in the data costs no digits. The
centre times the weights is a sum like the others (z), hence all of them stay linear: they can be added, subtracted and weighted, and
mean = (z + s) / w. A feature counts as constant in a fit if its deviation is below what doubles tell apart: 1e-7 of the distance of
the fit's mean from the centre, or 1e-15 of the mean itself.
"""

from __future__ import annotations

from itertools import combinations
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(features: list[str], y: str = "y") -> list[tuple[str, str]]:
    """The columns with their names in sums: features are numbered from 1."""
    return [*((str(i + 1), f) for i, f in enumerate(features)), ("y", y)]


def sum_expressions(features: list[str], y: str = "y", w: str = "w", centre: str = "CAST(0 AS DOUBLE)") -> dict[str, str]:
    """n, w, sums s1 .., sy of differences from the centre, the centre's own z1 .., zy, and products q11, q12, .., q1y, .., qyy as SQL
    aggregates. centre: an SQL number with a place for the name of the column."""
    names, weight = named(features, y), f"CAST({w} AS DOUBLE)"
    at = {k: centre.format(k) for k, _ in names}
    out = {"n": "count(*)", "w": f"sum({weight})"}
    out |= {f"z{k}": f"sum({weight} * {at[k]})" for k, _ in names}
    out |= {f"s{k}": f"sum({weight} * ({c} - {at[k]}))" for k, c in names}
    out |= {f"q{a}{b}": f"sum({weight} * ({x} - {at[a]}) * ({z} - {at[b]}))" for i, (a, x) in enumerate(names) for b, z in names[i:]}
    return out


def sums(df: DataFrame, features: list[str], by: list[str | Column], y: str = "y", w: str = "w") -> DataFrame:
    """Two passes: the centre (a row) and the sums around it. Rows of one call can be added up; those of two calls have two centres."""
    centre = df.agg(*(F.expr(f"coalesce(avg(CAST({c} AS DOUBLE)), 0D)").alias(f"_centre_{k}") for k, c in named(features, y)))
    return df.crossJoin(F.broadcast(centre)).groupBy(*by).agg(*(F.expr(e).alias(n) for n, e in sum_expressions(features, y, w, "_centre_{}").items()))


def sum_names(p: int) -> list[str]:
    return list(sum_expressions([f"f{i}" for i in range(p)]))


def earlier(per: DataFrame, season: str, seasons: DataFrame, p: int, keys: list[str] | None = None, window: int | None = None) -> DataFrame:
    """Per season (of all seasons) the sums of the seasons before it, of the last `window` of them if named. per: a row a season (and key)."""
    keys = keys or []
    grid = seasons.select(season) if not keys else seasons.select(season).crossJoin(F.broadcast(per.select(*keys).distinct()))
    w = Window.partitionBy(*keys).orderBy(season).rangeBetween(Window.unboundedPreceding if window is None else -window, -1)
    return grid.join(per, [season, *keys], "left").select(season, *keys, *(F.sum(c).over(w).alias(c) for c in sum_names(p)))


def earlier_sql(rows: str, features: list[str], keys: str = "", window: int | None = None, y: str = "y", w: str = "w") -> str:
    """The same by a join of seasons with the rows before them."""
    back = f" AND r.season >= s.season - {window}" if window else ""
    return f"SELECT s.season, {keys}{', '.join(f'{e} AS {n}' for n, e in sum_expressions(features, y, w).items())} FROM seasons s JOIN {rows} r ON r.season < s.season{back} GROUP BY ALL"


def moment_stages(p: int) -> list[dict[str, str]]:
    """Means, covariances, deviations and correlations from the sums."""
    idx = [str(i + 1) for i in range(p)]
    first = {f"m{k}": f"(z{k} + s{k}) / w" for k in [*idx, "y"]} | {f"t{k}": f"s{k} / w" for k in [*idx, "y"]}
    second = {f"c{a}{b}": f"q{a}{b} / w - t{a} * t{b}" for a, b in [*((k, k) for k in idx), *combinations(idx, 2), *((k, "y") for k in idx), ("y", "y")]}
    third = {f"d{k}": f"CASE WHEN c{k}{k} > 1e-14 * t{k} * t{k} + 1e-30 * m{k} * m{k} THEN sqrt(c{k}{k}) END" for k in idx}
    fourth = {f"r{a}{b}": f"c{a}{b} / (d{a} * d{b})" for a, b in combinations(idx, 2)} | {f"g{k}": f"c{k}y / d{k}" for k in idx}
    return [first, second, third, fourth]


def solve_stages(which: list[int], alpha: str, p: int) -> list[dict[str, str]]:
    """b0 and b1 .. bp (0 for features not in `which`) of the ridge on the features numbered in `which`. alpha: an SQL number or column."""
    on, out = [str(k) for k in which], []
    stage = {"k": f"1 + ({alpha}) / w"}
    r = lambda a, b: f"r{min(a, b)}{max(a, b)}"
    if not on:
        slope = {}
    elif len(on) == 1:
        slope = {on[0]: f"g{on[0]} / k"}
    elif len(on) == 2:
        a, b = on
        out = [{"raw_det": f"k * k - {r(a, b)} * {r(a, b)}"}]
        slope = {a: f"(k * g{a} - {r(a, b)} * g{b}) / det", b: f"(k * g{b} - {r(a, b)} * g{a}) / det"}
    else:
        a, b, c = on
        ab, ac, bc = r(a, b), r(a, c), r(b, c)
        out = [{"raw_det": f"k * k * k + 2 * {ab} * {ac} * {bc} - k * ({ab} * {ab} + {ac} * {ac} + {bc} * {bc})"}]
        slope = {
            a: f"(g{a} * (k * k - {bc} * {bc}) + g{b} * ({ac} * {bc} - k * {ab}) + g{c} * ({ab} * {bc} - k * {ac})) / det",
            b: f"(g{a} * ({ac} * {bc} - k * {ab}) + g{b} * (k * k - {ac} * {ac}) + g{c} * ({ab} * {ac} - k * {bc})) / det",
            c: f"(g{a} * ({ab} * {bc} - k * {ac}) + g{b} * ({ab} * {ac} - k * {bc}) + g{c} * (k * k - {ab} * {ab})) / det",
        }
    if out:
        out.append({"det": "CASE WHEN raw_det > 1e-13 THEN raw_det END"})
    every = [str(i + 1) for i in range(p)]
    coefs = {f"b{k}": f"({slope[k]}) / d{k}" if k in slope else "CAST(0 AS DOUBLE)" for k in every}
    zero = {"b0": "my" + "".join(f" - b{k} * m{k}" for k in on)}
    return [stage, *out, coefs, zero]


def chain(df: DataFrame, stages: list[dict[str, str]]) -> DataFrame:
    for stage in stages:
        df = df.select("*", *(F.expr(e).alias(n) for n, e in stage.items()))
    return df


def chain_sql(source: str, stages: list[dict[str, str]]) -> str:
    """The stages as nested selects over a table or a query."""
    out = source if source.lstrip().upper().startswith("SELECT") else f"SELECT * FROM {source}"
    for stage in stages:
        out = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM ({out})"
    return out


def predicted(features: list[str]) -> str:
    """The prediction from b0 .. bp and the features."""
    return "b0" + "".join(f" + b{i + 1} * {f}" for i, f in enumerate(features))


def fit(sums_: DataFrame, keep: list[str], p: int, which: list[int], alpha: str) -> DataFrame:
    """keep, n, b0 .. bp of every row of sums."""
    return chain(sums_, [*moment_stages(p), *solve_stages(which, alpha, p)]).select(*keep, "n", *(f"b{i}" for i in range(p + 1)))


def fit_sql(source: str, keep: str, p: int, which: list[int], alpha: str) -> str:
    """keep: column names, each followed by a comma."""
    return f"SELECT {keep}n, {', '.join(f'b{i}' for i in range(p + 1))} FROM ({chain_sql(source, [*moment_stages(p), *solve_stages(which, alpha, p)])})"


#: Upper ends of a Poisson(1) variable's values 0, 1, .. on 32 bits.
POISSON = tuple(round(2**32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(7))


def poisson_weight(bits: str) -> str:
    """A Poisson(1) weight of a number of 32 random bits, as SQL: a cluster's weight in a bootstrap draw."""
    return "CASE " + " ".join(f"WHEN {bits} < {top} THEN {k}" for k, top in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"
