"""Statistics as grouped sufficient statistics (family K, closed forms). Only sums cross the network; resampling draws
are rows, seeded by md5 so that they depend neither on order nor on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order
from .closed import poisson_weight


def pearson(x: str | Column, y: str | Column) -> Column:
    """NULL for n < 2 or no variance. In closed form, since corr divides by zero there under ANSI."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    va, vb = F.var_pop(a), F.var_pop(b)
    return F.when((F.count(a) >= 2) & varies(a) & varies(b) & (va > 0) & (vb > 0), F.covar_pop(a, b) / F.sqrt(va * vb))


def varies(x: Column) -> Column:
    """Whether a group has two values. The variance of one value is not always 0: means of partial sums differ from it in the last digit."""
    return F.min(x) < F.max(x)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return order.average_ranks(df, keys, [x, y]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(f"{x}_rank", f"{y}_rank").alias("spearman"))


def centred(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns less their overall mean (a second pass): for sums of products of what no offset changes."""
    means = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"_mean_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(means))
    return out.select(*((F.col(c) - F.col(f"_mean_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))


def weighted_correlation(x: str, y: str, w: str) -> Column:
    """Weighted Pearson in closed form, of columns that are centred."""
    a, b, c = F.col(x), F.col(y), F.col(w)
    n, sx, sy = F.sum(c), F.sum(c * a), F.sum(c * b)
    vx, vy = F.sum(c * a * a) / n - (sx / n) * (sx / n), F.sum(c * b * b) / n - (sy / n) * (sy / n)
    tiny = lambda v, s: v > 1e-14 * (s / n) * (s / n)
    return F.when(tiny(vx, sx) & tiny(vy, sy), (F.sum(c * a * b) / n - sx / n * sy / n) / F.sqrt(vx * vy))


def weighted_association(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """keys, n, weighted Pearson r, weighted Spearman rho (Pearson of weighted mid-ranks) and the share of rows with one sign."""
    rows = order.weighted_ranks(df.select(*keys, x, y, F.col(w).cast("double").alias(w)), keys, [x, y], w)
    signs = rows.groupBy(*keys).agg(F.avg((F.signum(x) == F.signum(y)).cast("int")).alias("sign_agreement"))
    near = centred(rows, [x, y, f"{x}_rank", f"{y}_rank"])
    out = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), weighted_correlation(x, y, w).alias("r"), weighted_correlation(f"{x}_rank", f"{y}_rank", w).alias("rho"))
    return out.join(signs, keys)


def earlier_means(df: DataFrame, entity: str, season: str, value: str, seasons: DataFrame) -> DataFrame:
    """season, entity, n, m, ss: count, mean and squared deviations of the entity's values in all seasons before, for each season (of all seasons)
    that follows one with a value. Sums a season (around the overall mean) are added up in order: no row is copied once a season."""
    mean = df.agg(F.coalesce(F.avg(value).cast("double"), F.lit(0.0)).alias("_mean"))
    v = F.col(value) - F.col("_mean")
    per = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(mean)).groupBy(entity, season).agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    whole = seasons.agg(F.array_sort(F.collect_set(season)).alias("_all"))  # one row: an array of seasons
    asked = per.groupBy(entity).agg(F.min(season).alias("_first")).crossJoin(F.broadcast(whole)).select(entity, F.explode(F.filter("_all", lambda x: x > F.col("_first"))).alias(season), F.lit(True).alias("_asked"))
    line = Window.partitionBy(entity).orderBy(season).rangeBetween(Window.unboundedPreceding, -1)
    both = asked.unionByName(per, allowMissingColumns=True).select(season, entity, "_asked", *(F.sum(c).over(line).alias(c) for c in ("_n", "_s", "_q"))).where("_asked")
    near = F.col("_s") / F.col("_n")
    return both.crossJoin(F.broadcast(mean)).select(season, entity, F.col("_n").alias("n"), (F.col("_mean") + near).alias("m"), F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * near).alias("ss"))


def league_shrunk(df: DataFrame, entity: str, season: str, value: str, weight: str, k: float) -> DataFrame:
    """df plus league (the mean of all earlier seasons), history (the entity's own) and blend = history shrunk to
    the league by weight / (weight + k)."""
    seasons = df.groupBy(season).agg(F.sum(F.col(value) * F.col(weight)).alias("_v"), F.sum(weight).alias("_w"))
    before = Window.orderBy(season).rangeBetween(Window.unboundedPreceding, -1)  # a row a season
    league = seasons.select(season, (F.sum("_v").over(before) / F.sum("_w").over(before)).alias("league"))
    own = Window.partitionBy(entity).orderBy(season).rangeBetween(Window.unboundedPreceding, -1)
    total = F.sum(weight).over(own)
    out = df.withColumn("history_weight", F.coalesce(total, F.lit(0))).withColumn("history", F.sum(F.col(value) * F.col(weight)).over(own) / total)
    share = F.col("history_weight") / (F.col("history_weight") + k)
    return out.join(F.broadcast(league), season).withColumn("blend", F.coalesce(share * F.col("history"), F.lit(0.0)) + (1 - share) * F.col("league"))


def eb_pooling(df: DataFrame, keys: list[str], owner: str, value: str, spent: Column | None = None) -> DataFrame:
    """Empirical-Bayes normal pooling of owners within keys: sigma2 from the residual sum, tau2 by moments (0 at the
    boundary), posterior, shrinkage, se and a 95% interval. spent: degrees of freedom that a model before the pooling used per row."""
    x = F.col(value)
    own = df.groupBy(*keys, owner).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.count(x) * F.var_pop(x)).alias("_ss")).where("n > 0")
    # a row a key: small aggregates that are joined back, instead of windows that gather all owners of a key
    totals = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g"), F.sum("n").alias("_t"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum("_ss").alias("_within"), F.sum(F.col("n") * F.col("n")).alias("_nn"))
    back = lambda df, small: df.join(small, keys) if keys else df.crossJoin(F.broadcast(small))
    out = back(own, totals)
    between = out.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("_between"))
    out = back(out, between)
    free = F.col("_t") - F.col("_g") - (F.lit(0.0) if spent is None else spent * F.col("_t"))
    out = out.withColumn("sigma2", F.when(free > 0, F.col("_within") / free))
    c = F.col("_t") - F.col("_nn") / F.col("_t")
    out = out.withColumn("tau2", F.greatest(F.lit(0.0), F.when(c > 0, (F.col("_between") - (F.col("_g") - 1) * F.col("sigma2")) / c)))
    out = out.withColumn("shrinkage", F.when(F.col("tau2") > 0, F.col("tau2") / (F.col("tau2") + F.col("sigma2") / F.col("n"))).otherwise(F.lit(0.0)))
    out = out.withColumn("posterior", F.col("grand") + F.col("shrinkage") * (F.col("mean") - F.col("grand"))).withColumn("se", F.sqrt(F.col("shrinkage") * F.col("sigma2") / F.col("n")))
    return out.select(*keys, owner, "n", "mean", "sigma2", "tau2", "shrinkage", "posterior", "se", (F.col("posterior") - 1.96 * F.col("se")).alias("low"), (F.col("posterior") + 1.96 * F.col("se")).alias("high"))


def beta_binomial(df: DataFrame, season: str, hits: str, n: str, window: int = 5) -> DataFrame:
    """df plus the prior (moments of the rates over the trailing seasons before the row's) and the shrunk rate."""
    rate = F.col(hits) / F.col(n)
    per = df.groupBy(season).agg(F.count(F.lit(1)).alias("_k"), F.sum(rate).alias("_s"), F.sum(rate * rate).alias("_q"))
    w = Window.orderBy(season).rangeBetween(-window, -1)  # a row a season
    k, s, q = F.sum("_k").over(w), F.sum("_s").over(w), F.sum("_q").over(w)
    prior = per.select(season, (s / k).alias("prior_mean"), (q / k - (s / k) * (s / k)).alias("prior_var"))
    m, v = F.col("prior_mean"), F.col("prior_var")
    out = df.join(F.broadcast(prior), season).withColumn("strength", F.when((v > 0) & (m > 0) & (m < 1), F.greatest(F.lit(1.0), m * (1 - m) / v - 1)))
    post = (F.col(hits) + F.col("strength") * m) / (F.col(n) + F.col("strength"))
    out = out.withColumn("posterior", post)
    sd = F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col(n) + F.col("strength") + 1))
    return out.withColumn("low", F.greatest(F.lit(0.0), F.col("posterior") - 1.96 * sd)).withColumn("high", F.least(F.lit(1.0), F.col("posterior") + 1.96 * sd))


def weighted_trend(df: DataFrame, entity: str, season: str, value: str, weight: str, last: int = 3) -> DataFrame:
    """Slope over the last seasons of each entity by weighted least squares, its se and the residual rms."""
    w = Window.partitionBy(entity).orderBy(F.desc(season))
    rows = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    x, y, c = F.col(season), F.col(value), F.col(weight)
    s = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("w"), (F.sum(c * x) / F.sum(c)).alias("mx"), (F.sum(c * y) / F.sum(c)).alias("my"), F.sum(c * x * x).alias("xx"), F.sum(c * x * y).alias("xy"), F.sum(c * y * y).alias("yy"))
    sxx, sxy, syy = F.col("xx") - F.col("w") * F.col("mx") * F.col("mx"), F.col("xy") - F.col("w") * F.col("mx") * F.col("my"), F.col("yy") - F.col("w") * F.col("my") * F.col("my")
    out = s.select(entity, "n", "w", sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy")).where("n >= 2")
    slope = F.col("sxy") / F.col("sxx")
    rss = F.greatest(F.lit(0.0), F.col("syy") - slope * F.col("sxy"))
    se = F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.sqrt(rss / (F.col("n") - 2) / F.col("sxx")))
    return out.select(entity, "n", slope.alias("slope"), se.alias("slope_se"), F.sqrt(rss / F.col("w")).alias("residual_rms"))


def regression_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """n, mae, rmse, r2, correlation, calibration slope and intercept, share of right directions, and coverage: the share of actual
    values within low .. high (where both are named and present)."""
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    sst = F.when(varies(y), F.count(y) * F.var_pop(y))
    slope = F.when(varies(p) & (F.var_pop(p) > 0), F.covar_pop(p, y) / F.var_pop(p))
    return df.where(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"),
        pearson(actual, predicted).alias("correlation"), slope.alias("slope"), (F.avg(y) - slope * F.avg(p)).alias("intercept"), F.avg((F.signum(y) == F.signum(p)).cast("int")).alias("direction"),
        *([F.avg(y.between(F.col(low), F.col(high)).cast("int")).alias("coverage")] if low and high else []))


def icc(df: DataFrame, keys: list[str], group: str, value: str, parts: bool = False) -> DataFrame:
    """One-way ANOVA intraclass correlation, the reliability of two and of n0 (the mean number of) measures, and the effective sample
    size."""
    x = F.col(value)
    own = centred(df.where(x.isNotNull()).select(*keys, group, value), [value]).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    t = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    g, n = F.col("groups"), F.col("n")
    msb, msw = (F.col("b") - F.col("s") * F.col("s") / n) / (g - 1), (F.col("q") - F.col("b")) / (n - g)
    n0 = (n - F.col("nn") / n) / (g - 1)
    out = t.where((g > 1) & (n > g)).select(*keys, "groups", "n", msb.alias("msb"), msw.alias("msw"), n0.alias("n0"))
    value_ = F.when(F.col("msb") + (F.col("n0") - 1) * F.col("msw") > 0, (F.col("msb") - F.col("msw")) / (F.col("msb") + (F.col("n0") - 1) * F.col("msw")))
    out = out.select(*keys, "groups", "n", "n0", *(["msb", "msw"] if parts else []), value_.alias("icc")).withColumn("reliability_2", 2 * F.col("icc") / (1 + F.col("icc")))
    k = F.col("n0")
    return out.withColumn("reliability_k", k * F.col("icc") / (1 + (k - 1) * F.col("icc"))).withColumn("effective_n", F.col("n") / (1 + (k - 1) * F.greatest(F.col("icc"), F.lit(0.0))))


def leave_group_out(df: DataFrame, owner: str, group: str, value: str, weight: str) -> DataFrame:
    """Per (owner, group): the group's own mean and the owner's mean without it."""
    part = df.groupBy(owner, group).agg(F.sum(F.col(value) * F.col(weight)).alias("v"), F.sum(weight).alias("w"))
    total = part.groupBy(owner).agg(F.sum("v").alias("tv"), F.sum("w").alias("tw"))
    rest = F.col("tw") - F.col("w")
    return part.join(total, owner).select(owner, group, (F.col("v") / F.col("w")).alias("actual"), F.when(rest > 0, (F.col("tv") - F.col("v")) / rest).alias("predicted"))


def draw(seed: str, *parts: Column) -> Column:
    """A long of 32 random bits from md5 of the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def bootstrap_sums(clusters: DataFrame, cluster: str, columns: list[str], draws: int, seed: str, keys: list[str] | None = None) -> DataFrame:
    """draw and the columns' sums in each bootstrap draw. clusters: a row a cluster (and key) with its sums. A cluster counts as often
    as a Poisson(1) number of its own md5 says, so that draws need no index of clusters and no join; sums leave the tasks a row a draw."""
    keys = keys or []
    each = clusters.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_bits", draw(seed, F.col("draw"), F.col(cluster)))
    return each.withColumn("_k", F.expr(poisson_weight("_bits"))).groupBy(*keys, "draw").agg(*(F.sum(F.col(c) * F.col("_k")).alias(c) for c in columns))


def cluster_bootstrap(clusters: DataFrame, cluster: str, numerator: str, denominator: str, draws: int, seed: str) -> DataFrame:
    """One row: the ratio, its 2.5% and 97.5% bootstrap quantiles, and draws with a value. clusters: a row a cluster with its sums."""
    per = bootstrap_sums(clusters, cluster, [numerator, denominator], draws, seed).withColumn("r", F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator)))
    whole = clusters.agg((F.sum(numerator) / F.sum(denominator)).alias("estimate"))
    return per.agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"), F.count("r").alias("draws")).crossJoin(whole)


#: Columns of sums that a Pearson correlation is rebuilt from.
PAIR_SUMS = {"n": "count(*)", "x": "sum(x)", "y": "sum(y)", "xx": "sum(x * x)", "yy": "sum(y * y)", "xy": "sum(x * y)"}
PAIR_R = "CASE WHEN n >= 2 AND n * xx - x * x > 1e-9 AND n * yy - y * y > 1e-9 THEN (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) END"


def correlation_bootstrap(df: DataFrame, cluster: str, x: str, y: str, draws: int, seed: str, keys: list[str] | None = None) -> DataFrame:
    """low and high (2.5% and 97.5%) of the correlation over draws of whole clusters, per key."""
    keys = keys or []
    rows = centred(df.select(*keys, F.col(cluster).alias("_cluster"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL"), ["x", "y"]).withColumnRenamed("_cluster", cluster)
    own = rows.groupBy(*keys, cluster).agg(*(F.expr(e).alias(n) for n, e in PAIR_SUMS.items()))
    per = bootstrap_sums(own, cluster, list(PAIR_SUMS), draws, seed, keys).withColumn("r", F.expr(PAIR_R))
    return per.groupBy(*keys).agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))


def global_ranks(df: DataFrame, columns: list[str], buckets: int = 64) -> DataFrame:
    """df plus <column>_rank: ranks over all rows with ties averaged. The column's range is cut at approximate quantiles (a bounded
    list); rows are ranked within a cut, and the rows of the cuts before are added, so that no task ranks the whole table.
    A cut holds one value where it is very frequent. Rows with a NULL in one of the columns are left out."""
    out = df
    for c in columns:
        out = out.where(F.col(c).isNotNull())
    shares = [(i + 1) / buckets for i in range(buckets - 1)]
    bounds = out.agg(*(F.percentile_approx(c, shares, 50 * buckets).alias(c) for c in columns)).first()
    for c in columns:
        cuts = sorted(set(bounds[c] or []))
        below = [F.when(F.col(c) > b, 1).otherwise(0) for b in cuts]
        out = out.withColumn("_cut", sum(below, F.lit(0)))
        counts = out.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n"))
        w = Window.orderBy("_cut")  # a row a cut
        counts = counts.select("_cut", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
        own, ties = Window.partitionBy("_cut").orderBy(c), Window.partitionBy("_cut", c)
        out = out.withColumn("_r", F.rank().over(own) + (F.count(F.lit(1)).over(ties) - 1) / 2)
        out = out.join(F.broadcast(counts), "_cut").withColumn(f"{c}_rank", F.col("_before") + F.col("_r")).drop("_cut", "_before", "_r")
    return out


def permutation_blocks(df: DataFrame, season: str, key: str, x: str, y: str, seed: str, block_rows: int = 4096) -> DataFrame:
    """season, _block, _rows: rows of x and y in order of the key. A season of more than block_rows rows is cut into blocks by a hash of the key,
    so that no task holds a whole season; y is permuted within the blocks."""
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(season, key, x, y)
    blocks = base.groupBy(season).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_m"))  # a row a season
    base = base.join(F.broadcast(blocks), season).withColumn("_block", draw(seed, F.lit("block"), F.col(key)) % F.col("_m"))
    return base.groupBy(season, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")))).alias("_rows"))


def permuted(season: str, seed: str, number: Column) -> Column:
    """The rows of a block in the order of a draw."""
    return F.array_sort(F.transform("_rows", lambda r: F.struct(draw(seed, number, F.col(season), r["k"]).alias("at"), r["k"].alias("k"), r["y"].alias("y"))))


def permutation_draws(df: DataFrame, season: str, key: str, x: str, y: str, draws: int, seed: str, block_rows: int = 4096) -> DataFrame:
    """draw, x, y: y permuted within the seasons' blocks, once a draw."""
    blocks = permutation_blocks(df, season, key, x, y, seed, block_rows).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return blocks.select("draw", F.inline(F.zip_with("_rows", permuted(season, seed, F.col("draw")), lambda a, b: F.struct(a["x"].alias("x"), b["y"].alias("y")))))


def permutation_placebo(df: DataFrame, season: str, key: str, x: str, y: str, draws: int, seed: str, block_rows: int = 4096) -> DataFrame:
    """One row: |corr(x, y)|, how many permutations of y within seasons reach it, p = (1 + reached) / (draws + 1), and the 5% and 95%
    quantiles of the null. A permutation changes only the sum of products: each block gives a number a draw, and rows are shuffled once, not
    once a draw. Draw -1 is the rows as they are."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(season, key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = centred(rows, ["x", "y"])
    product = lambda order: F.aggregate(F.zip_with("_rows", order, lambda a, b: a["x"] * b["y"]), F.lit(0.0), lambda acc, v: acc + v)
    each = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: F.struct(d.alias("draw"), product(permuted(season, seed, d)).alias("xy")))
    as_is = F.array(F.struct(F.lit(-1).alias("draw"), product(F.col("_rows")).alias("xy")))
    products = permutation_blocks(rows, season, key, "x", "y", seed, block_rows).select(F.inline(F.concat(as_is, each))).groupBy("draw").agg(F.sum("xy").alias("xy"))
    vx, vy = (F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / F.count(c) for c in "xy")
    whole = rows.agg((F.sum("x") * F.sum("y") / F.count("x")).alias("mean"), F.when(varies(F.col("x")) & varies(F.col("y")) & (vx > 0) & (vy > 0), F.sqrt(vx * vy)).alias("scale"))
    c = products.crossJoin(F.broadcast(whole)).select("draw", F.abs((F.col("xy") - F.col("mean")) / F.col("scale")).alias("c"))
    null = F.when(F.col("draw") >= 0, F.col("c"))
    c = c.groupBy().agg(F.max(F.when(F.col("draw") < 0, F.col("c"))).alias("actual"), F.collect_list(null).alias("_null"), F.percentile(null, 0.05).alias("null_low"), F.percentile(null, 0.95).alias("null_high"))  # a number a draw
    reached = F.size(F.filter("_null", lambda v: v >= F.col("actual"))).cast("long")
    return c.select("actual", reached.alias("reached"), "null_low", "null_high", ((1 + reached) / (draws + 1)).alias("p"))


def sign_flip(df: DataFrame, cluster: str, gain: str, draws: int, seed: str) -> DataFrame:
    """One row: the mean gain, how many random sign flips by cluster reach it, p."""
    sums = df.groupBy(cluster).agg(F.sum(gain).alias("s"), F.count(gain).alias("n"))
    sign = F.when(draw(seed, F.col("draw"), F.col(cluster)) % 2 == 0, 1).otherwise(-1)
    null = sums.crossJoin(df.sparkSession.range(draws).withColumnRenamed("id", "draw")).groupBy("draw").agg((F.sum(F.col("s") * sign) / F.sum("n")).alias("m"))
    actual = sums.agg((F.sum("s") / F.sum("n")).alias("actual"))
    return null.crossJoin(actual).groupBy("actual").agg(F.count_if(F.col("m") >= F.col("actual")).alias("reached")).withColumn("p", (1 + F.col("reached")) / (draws + 1))


def distances(a: Column, b: Column) -> dict[str, Column]:
    """Euclidean, Manhattan, cosine and correlation distance of two array<double> columns over places where both are
    present; NULL with fewer than three."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda acc, p: acc + f(p))
    n = F.size(both)
    sx, sy, xx, yy, xy = total(lambda p: p["x"]), total(lambda p: p["y"]), total(lambda p: p["x"] * p["x"]), total(lambda p: p["y"] * p["y"]), total(lambda p: p["x"] * p["y"])
    ok = n >= 3
    vx, vy = xx - sx * sx / n, yy - sy * sy / n
    return {
        "euclidean": F.when(ok, F.sqrt(total(lambda p: (p["x"] - p["y"]) * (p["x"] - p["y"])))),
        "manhattan": F.when(ok, total(lambda p: F.abs(p["x"] - p["y"]))),
        "cosine": F.when(ok & (xx > 0) & (yy > 0), 1 - xy / F.sqrt(xx * yy)),
        "correlation": F.when(ok & (vx > 0) & (vy > 0), 1 - (xy - sx * sy / n) / F.sqrt(vx * vy)),
    }
