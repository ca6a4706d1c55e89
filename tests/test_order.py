"""Order statistics by counts of values against NumPy, and a group that no buffer should hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.operators import order, stats

from .conftest import rows


def sample(n=400, seed=1):
    r = random.Random(seed)
    return [(r.choice("gh"), float(r.randint(-9, 9)) if r.random() < 0.7 else r.uniform(-9, 9), float(r.randint(1, 5)), None if r.random() < 0.05 else r.randint(0, 30)) for _ in range(n)] + [("one", 4.0, 1.0, 1)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(sample(), "g string, x double, w double, y int").repartition(5)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_quantiles_equal_numpy_and_percentile(df, share):
    got = {r["g"]: (r["n"], r["q"]) for r in order.quantiles(df, ["g"], "x", {"q": share}).collect()}
    for g in ("g", "h", "one"):
        own = [x for k, x, *_ in sample() if k == g]
        assert got[g] == (len(own), pytest.approx(np.quantile(own, share)))
    assert {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("y", share).alias("q")).collect()} == pytest.approx({r["g"]: r["q"] for r in order.quantiles(df, ["g"], "y", {"q": share}).collect()})
    assert order.quantiles(df, [], "x", {"q": share}).first()["q"] == pytest.approx(np.quantile([x for _, x, *_ in sample()], share))


def test_average_ranks_and_spearman(df):
    ranks = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    for g in ("g", "h"):
        own = [(x, y) for k, x, _, y in sample() if k == g and y is not None]
        a, b = ranks([x for x, _ in own]), ranks([y for _, y in own])
        got = stats.spearman(df, ["g"], "x", "y").where(F.col("g") == g).first()
        assert (got["n"], got["spearman"]) == (len(own), pytest.approx(np.corrcoef(a, b)[0, 1]))


def test_weighted_association_against_numpy(df):
    data = [r for r in sample() if r[0] == "g" and r[3] is not None]
    x, w, y = (np.array([r[i] for r in data], float) for i in (1, 2, 3))
    mid = lambda v: np.array([w[v < a].sum() + w[v == a].sum() / 2 for a in v])

    def corr(a, b):
        a, b = a - w @ a / w.sum(), b - w @ b / w.sum()
        return (w * a) @ b / np.sqrt((w * a) @ a * ((w * b) @ b))

    got = stats.weighted_association(df, ["g"], "x", "y", "w").where("g = 'g'").first()
    assert (got["n"], got["r"], got["rho"]) == (len(data), pytest.approx(corr(x, y)), pytest.approx(corr(mid(x), mid(y))))
    # equal weights give the plain coefficients
    plain = stats.weighted_association(df.withColumn("w", F.lit(2.0)), ["g"], "x", "y", "w").where("g = 'g'").first()["rho"]
    assert plain == pytest.approx(stats.spearman(df, ["g"], "x", "y").where("g = 'g'").first()["spearman"])


def test_conformal_radii_take_the_rank_of_the_seasons_before(spark):
    r = random.Random(3)
    data = [(s, r.choice("ab"), round(r.uniform(-5, 5), 1)) for s in range(2000, 2010) for _ in range(12)]
    df = spark.createDataFrame(data, "season int, k string, e double")
    targets = df.select("season").distinct()
    got = {(x["k"], x["season"]): (x["residuals"], x["r50"], x["r99"]) for x in order.conformal_radii(df, ["k"], "season", targets, "e", {"r50": 0.5, "r99": 0.99}, window=3).collect()}
    want = {}
    for k in "ab":
        for t in range(2001, 2010):
            own = sorted(abs(e) for s, g, e in data if g == k and t - 3 <= s < t)
            at = lambda level: own[int(np.ceil((len(own) + 1) * level)) - 1] if np.ceil((len(own) + 1) * level) <= len(own) else None
            want[k, t] = (len(own), at(0.5), at(0.99))
    assert got == want


def test_one_group_with_all_rows(spark):
    df = spark.range(300_000).select(F.lit("hot").alias("g"), ((F.col("id") * 7919) % 300_000).cast("double").alias("v"))
    assert rows(order.quantiles(df, ["g"], "v", {"q": 0.9, "m": 0.5})) == [("hot", 300_000, pytest.approx(0.9 * 299_999), pytest.approx(0.5 * 299_999))]


def test_quantiles_over_all_seasons_before(spark):
    r = random.Random(6)
    data = [(s, r.choice("ab"), r.choice([None, float(r.randint(0, 5)), r.gauss(s, 3)])) for s in range(1990, 2000) for _ in range(r.choice([0, 3, 40]))]
    df = spark.createDataFrame(data, "season int, k string, v double")
    targets = spark.range(1988, 2003).select(F.col("id").cast("int").alias("season"))
    for cells in (2, 64):
        got = {(x["k"], x["season"]): (x["n"], x["q"]) for x in order.cumulative_quantiles(df, ["k"], "season", "v", 0.5, targets, cells).collect()}
        want = {}
        for k in "ab":
            for t in range(1988, 2003):
                own = [v for s, g, v in data if g == k and s < t and v is not None]
                if own:
                    want[k, t] = (len(own), pytest.approx(np.median(own)))
        assert got == want


def test_folds_drop_fill_and_flag_by_what_is_before_them(spark):
    from grainline.plans.research import fold_features

    r = random.Random(9)
    rows_ = [(a, s, f, v) for s in range(2000, 2005) for a in range(30) for f, v in (("x", None if s == 2002 and a < 6 else r.gauss(1e6, 2)), ("rare", 1.0 * a if a < 3 else None), ("one", 7.25))]
    df = spark.createDataFrame(rows_, "actor_id int, season int, feature string, v double")
    seasons = df.select("season").distinct()
    got = {(x["actor_id"], x["season"], x["feature"]): x for x in fold_features(df, seasons, least_rows=40).collect()}
    assert {x["rule"] for x in got.values() if x["feature"] == "rare"} == {"few"} and {x["rule"] for x in got.values() if x["feature"] == "one" and x["season"] > 2001} == {"constant"}
    assert {s for _, s, _ in got} == {2001, 2002, 2003, 2004} and {x["rule"] for x in got.values() if x["season"] == 2001} == {"few"}
    past = [v for _, s, f, v in rows_ if f == "x" and s < 2004]
    med = np.median([v for v in past if v is not None])
    full = np.array([med if v is None else v for v in past])
    value = next(v for a, s, f, v in rows_ if (a, s, f) == (4, 2004, "x"))
    assert got[4, 2004, "x"]["z"] == pytest.approx((value - full.mean()) / full.std(), abs=1e-5) and got[4, 2004, "x"]["was_missing"] == 0
    assert got[4, 2002, "x"]["was_missing"] is None and got[4, 2002, "x"]["z"] == pytest.approx((np.median([v for _, s, f, v in rows_ if f == "x" and s < 2002]) - np.mean([v for _, s, f, v in rows_ if f == "x" and s < 2002])) / np.std([v for _, s, f, v in rows_ if f == "x" and s < 2002]), abs=1e-5)
    # what comes later changes nothing
    changed = fold_features(df.withColumn("v", F.when(F.col("season") >= 2003, F.col("v") * 3).otherwise(F.col("v"))), seasons, least_rows=40).where("season <= 2003")
    assert {(x["actor_id"], x["season"], x["feature"]): x["rule"] for x in changed.collect()} == {k: x["rule"] for k, x in got.items() if k[1] <= 2003}
