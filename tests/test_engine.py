"""Operators on literal rows: NULL, tie, boundary and cardinality rules, leakage and partition invariance."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.functions import rates
from grainline.operators import aggs, closed, joins, keys, models, quality, reshape, stats, windows
from grainline.sources import tables as src

from .conftest import SF_SMALL, rows


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_rates_and_text_rules(spark):
    df = frame(spark, [(1, 2, " x "), (1, 0, " "), (None, 3, None)], "n int, d int, s string")
    got = df.select(rates.safe_rate(F.col("n"), F.col("d")).alias("r"), rates.blank_to_null(F.col("s")).alias("s"), rates.slug(F.lit("--Ab  c!")).alias("g")).collect()
    assert [tuple(r) for r in got] == [(0.5, "x", "ab-c"), (None, None, "ab-c"), (None, None, "ab-c")]
    day = frame(spark, [(2000, datetime.date(1990, 9, 1))], "s int, b date").select(rates.age_at(F.col("s"), F.col("b"))).first()[0]
    assert day == pytest.approx(3653 / 365.2425)


def test_finite_excludes_nan_and_infinity(spark):
    df = frame(spark, [(float("nan"),), (float("inf"),), (1.0,), (None,)], "v double")
    assert df.where(rates.finite(F.col("v"))).count() == 1


def test_resolution_order(spark):
    df = frame(spark, [("00-1", "00-2", 1.0), (None, None, float("nan")), (None, " ", 1.0), ("zz", None, 1.0), ("00-3", "", 1.0)], "a string, b string, v double")
    got = keys.resolve_actor(df, "a", "b", "v", "^00-\\d$").select("actor", "resolution_status").collect()
    assert [tuple(r) for r in got] == [("00-2", "conflicting_ids"), (None, "invalid_value"), (None, "missing_id"), ("zz", "invalid_id"), ("00-3", "resolved")]


def test_key_audit_counts_nulls_and_excess(spark):
    df = frame(spark, [(1, 1), (1, 1), (1, 1), (2, None), (3, 1)], "a int, b int")
    r = keys.key_audit(df, ["a", "b"]).first()
    assert (r["null_keys"], r["duplicate_keys"], r["excess_rows"]) == (1, 1, 2)


def test_checked_join_raises(spark):
    left, right = frame(spark, [(1,), (1,)], "k int"), frame(spark, [(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(left, right, ["k"], cardinality="m:1")
    assert joins.checked_join(left, right, ["k"], cardinality="m:m").count() == 4
    assert joins.checked_join(left, right, ["k"], cardinality="m:1", check=False).count() == 4


def test_interval_bounds_are_inclusive_and_shared_rows_split(spark):
    facts = frame(spark, [(1, w) for w in range(1, 6)], "team int, week int")
    iv = frame(spark, [(1, 2, 4, "a"), (1, 4, 9, "b")], "team int, s int, e int, id string")
    got = joins.interval_join(facts, iv, ["team"], "week", "s", "e")
    assert rows(got.select("week", "id")) == [(2, "a"), (3, "a"), (4, "a"), (4, "b"), (5, "b")]
    split = windows.fractional_split(got.withColumn("m", F.lit(1.0)), ["team", "week"], "m")
    assert split.agg(F.sum("weighted_m")).first()[0] == pytest.approx(4)


def test_lag_join_leaves_gaps_null_and_history_ignores_the_future(spark):
    df = frame(spark, [(1, 2000, 5), (1, 2001, 6), (1, 2003, 9)], "a int, season int, v int")
    got = joins.lag_join(df, ["a"], "season", ["v"])
    assert rows(got.select("season", "prior_v")) == [(2000, None), (2001, 5), (2003, None)]
    before = rows(joins.as_of_totals(df, ["a"], "season", ["v"]).where("season < 2004"))
    more = df.unionByName(frame(spark, [(1, 2004, 1000)], "a int, season int, v int"))
    assert rows(joins.as_of_totals(more, ["a"], "season", ["v"]).where("season < 2004")) == before


def test_as_of_evidence_prefers_stage_then_date_and_reports_conflict(spark):
    t = frame(spark, [(1, "d5"), (2, "d5"), (3, "d1")], "e int, cut string")
    ev = frame(spark, [(1, "d4", "x", 1), (1, "d2", "y", 2), (1, "d9", "z", 2), (2, "d3", "x", 1), (2, "d3", "y", 1), (3, "d2", "x", 1)], "e int, d string, v string, st int")
    got = joins.as_of_evidence(t, ev, "e", "cut", "d", "v", "st")
    assert rows(got.select("e", "v", "status")) == [(1, "y", "resolved"), (2, None, "ambiguous"), (3, None, "none")]


def test_ranks_keep_null_unranked_and_share_ties(spark):
    df = frame(spark, [(1, 5), (1, 5), (1, 3), (1, None)], "s int, v int")
    assert rows(windows.competition_rank(df, ["s"], "v", "k").select("v", "k")) == [(None, None), (3, 3), (5, 1), (5, 1)]
    e = windows.dense_rank_eligible(df, ["s"], "v", F.col("v") < 5)
    assert rows(e.select("v", "rank")) == [(None, None), (3, 1), (5, None), (5, None)]


def test_zscores_of_a_constant_group(spark):
    df = frame(spark, [(1, 2.0), (1, 2.0)], "g int, v double")
    assert [r["z"] for r in windows.zscore(df, ["g"], "v").collect()] == [0.0, 0.0]
    assert [r["z"] for r in windows.zscore(df, ["g"], "v", population=True).collect()] == [None, None]


def test_pivot_keeps_absent_features_and_quantile_is_exact(spark):
    df = frame(spark, [(1, "a", 1.0), (1, "b", None)], "k int, f string, v double")
    assert tuple(reshape.pivot_wide(df, ["k"], "f", {"v": "v"}, ["a", "b", "c"]).first()) == (1, 1.0, None, None)
    q = aggs.profile_long(frame(spark, [(1, 1), (1, 2), (1, 4)], "k int, v int"), ["k"], {}, {}, {"p90": (F.col("v"), 0.9)})
    assert q.first()["value"] == pytest.approx(3.6)


def test_quality_report_stops_on_errors_only(spark):
    df = frame(spark, [(1,), (-1,)], "v int")
    warn = quality.quality_report([("neg", df, F.col("v") < 0, "warning"), ("null", df, F.col("v").isNull(), "error")])
    assert rows(quality.stop_on_error(warn).select("name", "status")) == [("neg", "warning"), ("null", "pass")]
    with pytest.raises(quality.QualityError):
        quality.stop_on_error(quality.quality_report([("neg", df, F.col("v") < 0, "error")]))


def test_pearson_guards(spark):
    df = frame(spark, [(1, 1.0, 2.0), (2, 1.0, 1.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (3, 2.0, 4.0)], "g int, x double, y double")
    got = dict(rows(df.groupBy("g").agg(stats.pearson("x", "y"))))
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(1)


def ridge_by_numpy(data, alpha):
    """Predictions of the ridge on x (standardised) and all levels of the blocks, the intercept free."""
    names = sorted({(i, v) for row in data for i, v in enumerate(row[3:]) if v is not None})
    x, y, w = (np.array([row[k] for row in data], float) for k in (0, 1, 2))
    mean = w @ x / w.sum()
    z = (x - mean) / np.sqrt(w @ (x - mean) ** 2 / w.sum())
    m = np.array([[1.0, a, *(float(row[3 + i] == v) for i, v in names)] for row, a in zip(data, z)])
    pen = alpha * np.eye(m.shape[1])
    pen[0, 0] = 0
    return m @ np.linalg.solve((m * w[:, None]).T @ m + pen, (m * w[:, None]).T @ y)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_fixed_effects_of_four_blocks_against_numpy(spark, offset):
    r = np.random.default_rng(7)
    data = [(float(r.normal()), float(r.normal()) + offset, float(r.uniform(0.5, 2)), int(r.integers(0, 5)), int(r.integers(0, 9)), [None, "p", "q", "r"][int(r.integers(0, 4))], int(r.integers(0, 40))) for _ in range(300)]
    df = frame(spark, data, "x double, y double, w double, season int, team int, owner string, actor int")
    m = models.ridge_effects(df, ["x"], {"season": F.col("season"), "team": F.col("team"), "owner": F.col("owner")}, F.col("actor"), "y", "w", 7.5)
    got = m.predict(df).select("x", "prediction").collect()
    assert [p for _, p in sorted(tuple(v) for v in got)] == pytest.approx([p for _, p in sorted(zip([d[0] for d in data], ridge_by_numpy(data, 7.5)))], abs=1e-6)
    # an unseen level, a NULL one and a NULL number are predicted too; a row without y is not fitted
    odd = m.predict(frame(spark, [(None, None, 1.0, 99, None, None, 99)], "x double, y double, w double, season int, team int, owner string, actor int")).first()["prediction"]
    assert odd == pytest.approx(m.coef["1"] + (0 - m.numeric["x"][1]) / m.numeric["x"][2] * m.coef["x:"], abs=1e-6)
    more = df.unionByName(frame(spark, [(1.0, None, 1.0, 1, 1, "p", 1)], "x double, y double, w double, season int, team int, owner string, actor int"))
    assert models.ridge_effects(more, ["x"], {"season": F.col("season")}, F.col("actor"), "y", "w", 7.5).coef == pytest.approx(models.ridge_effects(df, ["x"], {"season": F.col("season")}, F.col("actor"), "y", "w", 7.5).coef)


def test_fixed_effects_of_100_000_actors(spark):
    """y = season + actor's parity: two blocks on the driver, 100,000 effects in a table."""
    n = 100_000
    df = spark.range(3 * n).select((F.col("id") % n).alias("actor"), (F.col("id") % 300 % 7).alias("season"), (F.col("id") % 25).alias("team"), F.lit(1.0).alias("w")).withColumn("y", F.col("season") * 10.0 + F.col("actor") % 2)
    m = models.ridge_effects(df, [], {"season": F.col("season"), "team": F.col("team")}, F.col("actor"), "y", "w", 1e-3)
    assert m.table.count() == n and m.coef["season=6"] - m.coef["season=0"] == pytest.approx(60, abs=0.1)
    assert m.predict(df).agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 0.05


def test_too_many_columns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(models, "MOST_COLUMNS", 5)
    df = spark.range(20).select("id", F.lit(1.0).alias("w"), F.col("id").cast("double").alias("y"))
    with pytest.raises(ValueError, match="more than 5"):
        models.ridge_effects(df, [], {"k": F.col("id")}, F.col("id"), "y", "w", 1.0)


def test_key_audit_shows_long_keys_whole(spark):
    df = frame(spark, [(1234567890123456, "a"), (1234567890123456, "a"), (99, "b"), (99, "b")], "k long, x string")
    assert keys.key_audit(df, ["k", "x"]).first()["sample_keys"] == "99-b,1234567890123456-a"


@pytest.mark.parametrize("which", [[], [1], [2, 3], [1, 2, 3]])
def test_closed_ridge_against_numpy(spark, which):
    r = np.random.default_rng(4)
    x, w = r.normal(size=(200, 3)), r.uniform(0.5, 3, 200)
    y = 3 + x @ [1.0, -2.0, 0.5] + r.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), float(b), float(c)) for a, b, c in zip(x, y, w)], "a double, b double, c double, y double, w double")
    got = closed.fit(closed.sums(df, ["a", "b", "c"], []), [], 3, which, "5e0").first()
    z = x[:, [k - 1 for k in which]]
    mean, my = w @ z / w.sum(), w @ y / w.sum()
    sd = np.sqrt(w @ (z - mean) ** 2 / w.sum())
    s = (z - mean) / sd
    coef = np.linalg.solve((s * w[:, None]).T @ s + 5 * np.eye(len(which)), (s * w[:, None]).T @ (y - my)) / sd if which else np.zeros(0)
    want = {"b0": my - coef @ mean if which else my} | {f"b{k}": c for k, c in zip(which, coef)}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and got["n"] == 200


def test_effective_df_in_closed_form_equals_the_eigenvalues(spark):
    from grainline.plans.folds import DF3

    r = np.random.default_rng(5)
    x = r.normal(size=(100, 3))
    df = spark.createDataFrame([(*map(float, a), 0.0, 1.0) for a in x], "a double, b double, c double, y double, w double")
    g = closed.sums(df, ["a", "b", "c"], []).withColumn("alpha", F.lit(20.0))
    got = closed.chain(g, [*closed.moment_stages(3), *DF3]).first()["df"]
    e = np.linalg.eigvalsh(100 * np.corrcoef(x.T))
    assert got == pytest.approx(1 + (e / (e + 20.0)).sum(), abs=1e-9)


def test_logistic_against_gradient_zero(spark):
    r = np.random.default_rng(6)
    data = [(int(a), int(b), 50, int(r.binomial(50, 1 / (1 + np.exp(-(0.3 * a - 0.5 * b + 0.2)))))) for a in range(5) for b in range(4)]
    b = models.logistic(frame(spark, data, "d int, x int, n int, h int"), ["d", "x"], "h", "n")
    x = np.array([(1, d, v) for d, v, *_ in data], float)
    q = 1 / (1 + np.exp(-x @ b))
    assert np.abs(x.T @ (np.array([h for *_, h in data]) - 50 * q)).max() < 1e-6


def test_global_ranks_and_row_index_need_no_single_task(spark):
    r = np.random.default_rng(8)
    data = [(int(i), int(v), float(u)) for i, (v, u) in enumerate(zip(r.integers(0, 40, 500), r.normal(size=500).round(1)))]
    df = frame(spark, data, "i int, v int, u double").repartition(5)
    got = {x["i"]: (x["v_rank"], x["u_rank"]) for x in stats.global_ranks(df, ["v", "u"], buckets=7).collect()}
    want = [[(sum(b < a for b in c) + 1 + sum(b <= a for b in c)) / 2 for a in c] for c in ([v for _, v, _ in data], [u for *_, u in data])]
    assert all(got[i] == pytest.approx((want[0][i], want[1][i])) for i in range(500))
    k = {x["i"]: x["k"] for x in windows.row_index(df, "v", "u", ["i"], buckets=5).collect()}
    order = sorted(data, key=lambda x: (-x[1], x[2], x[0]))
    assert all(k[x[0]] == n for n, x in enumerate(order, 1))


def test_permutations_in_blocks_keep_seasons_and_values(spark):
    df = frame(spark, [(s, i, float(i), float(s * 1000 + i)) for s in (1, 2) for i in range(50)], "season int, id int, x double, y double")
    got = stats.permutation_draws(df, "season", "id", "x", "y", 3, "t", block_rows=10).collect()
    assert len(got) == 300 and all(sorted(r_["y"] for r_ in got if r_["draw"] == d) == sorted(float(s * 1000 + i) for s in (1, 2) for i in range(50)) for d in range(3))


def test_poisson_weights_have_their_distribution(spark):
    w = [r_[0] for r_ in spark.range(20_000).select(F.expr(closed.poisson_weight("(id * 214748) % 4294967296"))).collect()]
    assert abs(np.mean(w) - 1) < 0.03 and abs(np.var(w) - 1) < 0.06


def test_shared_folder_is_required_outside_local_mode(spark, monkeypatch):
    from types import SimpleNamespace

    from grainline.sources.shared import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda key, value: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://h:7077")))


def test_csv_contract_and_versioned_sink(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n1,true,x\nbad,TRUE,\n")
    df = src.scan_csv_typed(spark, str(tmp_path / "x.csv"), {"a": "int", "b": "boolean", "c": "string"})
    assert [tuple(r) for r in df.collect()] == [(1, True, "x"), (None, False, None)]
    root = f"file://{tmp_path}/out"
    assert (src.versioned_sink({"t": df}, root, "v1"), src.versioned_sink({"t": df}, root, "v1")) == ("published", "reused")
    assert src.read_published(spark, root, "t", "v1").count() == 2
    held = sorted((tmp_path / "out" / "data").iterdir())
    with pytest.raises(Exception):
        src.versioned_sink({"t": df.select(F.raise_error(F.lit("x")))}, root, "v2")
    assert sorted((tmp_path / "out" / "data").iterdir()) == held and [p.name for p in (tmp_path / "out" / "publications").glob("*.json")] == ["v1.json"]


def test_partitioned_scan_and_incremental_seasons(spark, tmp_path):
    a = frame(spark, [(1, "x")], "k int, v string")
    a.write.parquet(f"{tmp_path}/d/season=2000")
    frame(spark, [(2, "y", 5)], "k int, v string, more int").write.parquet(f"{tmp_path}/d/season=2001")
    got = src.scan_partitioned(spark, str(tmp_path), "d")
    assert rows(got.select("season", "k", "more")) == [(2000, 1, None), (2001, 2, 5)]
    assert src.scan_partitioned(spark, str(tmp_path), "d", [2001]).count() == 1
    df = got.select("k", "v", "season")
    done = df.where("season < 0")
    assert src.season_incremental(df, done, f"{tmp_path}/inc").count() == 2
    later = src.season_incremental(df.withColumn("v", F.lit("new")), df.where("season = 2000"), f"{tmp_path}/inc")
    assert rows(later.select("season", "v")) == [(2000, "x"), (2001, "new")]


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprint_ignores_order_and_partitions(spark, parts):
    df = frame(spark, [(i, str(i)) for i in range(20)], "a int, b string")
    one = src.frame_fingerprint(df).first()
    other = src.frame_fingerprint(df.orderBy(F.desc("a")).repartition(parts).select("b", "a")).first()
    assert one == other
    assert src.frame_fingerprint(df.where("a > 0")).first() != one


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    df = frame(spark, [(i, float(i % 5), 1.0) for i in range(30)], "c int, a double, b double")
    one = stats.cluster_bootstrap(df, "c", "a", "b", 20, "s").first()
    assert stats.cluster_bootstrap(df.repartition(7), "c", "a", "b", 20, "s").first() == one
    assert one["low"] <= one["estimate"] <= one["high"]


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["B07_key_audit", "C02_interval_join", "D18_scheme_profiles", "E10_percentile_score", "I09_child_parent_lineage", "K07_eb_normal_pooling"])
def test_queries_against_sql(spark, name):
    import duckdb

    from grainline.plans.catalog import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SF_SMALL)
    got = df.select(*sorted(df.columns)).collect()
    rel = con.sql(ORACLE[name])
    want = rel.project(", ".join(f'"{c}"' for c in sorted(rel.columns))).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_closed_fits_keep_their_digits_beside_an_offset(spark, offset):
    """The line y = 2 x + 1, also over folds, groups left out and cumulated seasons."""
    data = [(s, "ab"[i % 2], offset + i, 2 * (offset + i) + 1 + 3 * (i % 3 - 1) * (s == 9), 1.0) for s in (1, 2, 3, 9) for i in range(7)]
    df = frame(spark, data, "season int, grp string, x double, y double, w double")
    exact = df.where("season < 9")
    for rows_ in (exact.where("season = 1"), exact):
        b = closed.fit(closed.sums(rows_, ["x"], []), [], 1, [1], "0").first()
        assert b["b1"] == pytest.approx(2, abs=1e-9) and b["b0"] + b["b1"] * offset == pytest.approx(2 * offset + 1, rel=1e-12)
    own = closed.sums(exact, ["x"], ["grp"])
    total = own.agg(*(F.sum(c).alias(f"t_{c}") for c in closed.sum_names(1)))
    rest = own.crossJoin(total).select("grp", *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in closed.sum_names(1)))
    assert all(r["b1"] == pytest.approx(2, abs=1e-9) for r in closed.fit(rest, ["grp"], 1, [1], "0").collect())
    per = closed.sums(df, ["x"], ["season"])
    past = closed.earlier(per, "season", df.select("season").distinct(), 1).where("n > 0")
    assert [r["b1"] for r in closed.fit(past, ["season"], 1, [1], "0").collect()] == pytest.approx([2, 2, 2], abs=1e-9)
    x, y = np.array([r[2] for r in data]), np.array([r[3] for r in data])
    c = np.cov(x - offset, y - 2 * offset, bias=True)
    assert closed.fit(closed.sums(df, ["x"], []), [], 1, [1], "0").first()["b1"] == pytest.approx(c[0, 1] / c[0, 0], rel=1e-9)


def test_constant_features_have_no_slope_and_small_ones_do(spark):
    for value in (0.1, 2000.3, 1000000.1, 1e12 + 0.7):
        df = frame(spark, [(value, float(i), 1.0) for i in range(9)], "x double, y double, w double")
        assert closed.fit(closed.sums(df, ["x"], []), [], 1, [1], "0").first()["b1"] is None
        mixed = frame(spark, [(g, value if g == "k" else float(i), float(i), 1.0) for g in "kl" for i in range(9)], "g string, x double, y double, w double")
        got = {r["g"]: r["b1"] for r in closed.fit(closed.sums(mixed, ["x"], ["g"]), ["g"], 1, [1], "0").collect()}
        assert got["k"] is None and (got["l"] == pytest.approx(1, rel=1e-4) or value > 1e8)  # the centre is 10^5 deviations away
    tiny = frame(spark, [(i * 1e-10, 2.0 * i, 1.0) for i in range(9)], "x double, y double, w double")
    assert closed.fit(closed.sums(tiny, ["x"], []), [], 1, [1], "0").first()["b1"] == pytest.approx(2e10)
    twin = frame(spark, [(float(i), 3.0 * i + 1e7, float(i % 4), 1.0) for i in range(9)], "a double, b double, y double, w double")
    assert closed.fit(closed.sums(twin, ["a", "b"], []), [], 2, [1, 2], "0").first()["b1"] is None


def test_publications_are_verified_and_made_by_one_builder(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    one, two = frame(spark, [(1, "a"), (2, "b")], "k int, s string"), frame(spark, [(3, "c")], "k int, s string")
    assert src.versioned_sink({"t": one, "u": two}, root, "v1") == "published" and src.versioned_sink({"t": two}, root, "v2") == "published"
    assert rows(src.read_published(spark, root, "t", "v1")) == [(1, "a", "v1"), (2, "b", "v1")] and rows(src.read_published(spark, root, "t")) == [(3, "c", "v2")]
    assert rows(src.publications(spark, root).select("version", "sequence", "table", "row_count")) == [("v1", 1, "t", 2), ("v1", 1, "u", 1), ("v2", 2, "t", 1)]
    with pytest.raises(src.PublicationError, match="other content"):
        src.versioned_sink({"t": one, "u": one}, root, "v1")
    folders = lambda: {p.name for p in (tmp_path / "data").iterdir()}
    held = folders()
    # a builder that saw no pointer and comes second: its data goes, the first one's stays
    monkeypatch.setattr(src, "_fs", lambda *a, real=src._fs: _Blind(*real(*a)).pair())
    assert src.versioned_sink({"t": one, "u": two}, root, "v1") == "reused"
    with pytest.raises(src.PublicationError, match="other content"):
        src.versioned_sink({"t": two, "u": two}, root, "v1")
    monkeypatch.undo()
    assert folders() == held and rows(src.read_published(spark, root, "u", "v1")) == [(3, "c", "v1")]
    # damage is found before reuse
    data = next(p["data"] for p in src._pointers(spark, root) if p["version"] == "v1")
    two.write.mode("append").parquet(f"{data}/t")
    for call in (lambda: src.verify(spark, root, "v1"), lambda: src.versioned_sink({"t": one, "u": two}, root, "v1")):
        with pytest.raises(src.PublicationError, match="not what was published"):
            call()
    with pytest.raises(src.PublicationError, match="not published"):
        src.read_published(spark, root, "t", "v9")


class _Blind:
    """A file system that does not see pointers before it makes one."""

    def __init__(self, fs, path):
        self.fs, self.path = fs, path

    def exists(self, path):
        return self.fs.exists(path) and not path.toString().endswith(".json")

    def __getattr__(self, name):
        return getattr(self.fs, name)

    def pair(self):
        return self, self.path


def test_listing_checks_its_ordering_and_applies_the_filters_that_are_given(spark):
    from grainline.plans.serving import ORDERS, list_entities

    df = frame(spark, [(2000, 1, "Ann", "x", 3, 1, 10, 5, True), (2001, 1, "Ann", "x", 3, 0, 10, 9, False), (2000, 2, "Bob", "y", 4, 2, 0, 7, True)], "season int, actor_id long, actor_name string, team_name string, team_id int, attempts long, volume long, value long, qualifies boolean")
    ids = lambda **k: [(r["actor_id"], r["season"]) for r in list_entities(df, **k).collect()]
    assert ids() == [(1, 2001), (1, 2000), (2, 2000)] and ids(sort="rate") == [(1, 2001), (1, 2000), (2, 2000)] and ids(sort="attempts")[0] == (2, 2000)
    assert ids(search="bO") == [(2, 2000)] and ids(eligible=False) == [(1, 2001)] and ids(team_id=3, season=2000) == [(1, 2000)] and ids(limit=1, offset=1) == [(1, 2000)]
    assert len(ORDERS) == 9 and list_entities(df, eligible=True).first()["total"] == 2
    with pytest.raises(ValueError):
        list_entities(df, sort="nothing")


def test_feature_requests_are_checked(spark):
    from grainline.plans.domain import feature_store

    df = frame(spark, [(1, 2000, 1999, "attempt", 0.5), (1, 1999, 1998, "success", 0.1), (1, 2001, 2000, "attempt", 9.0)], "team_id int, target int, source int, feature string, z double")
    assert rows(feature_store(df, 2000, ["attempt"]).select("part", "target", "attempt")) == [("request", 2000, 0.5)]
    assert rows(feature_store(df, 2000, ["attempt", "success"]).select("part", "target", "attempt", "success")) == [("request", 2000, 0.5, None), ("train", 1999, None, 0.1)]
    for names in ([], ["attempt", "attempt"], ["other"]):
        with pytest.raises(ValueError, match="request"):
            feature_store(df, 2000, names)
    with pytest.raises(ValueError, match="not before"):
        feature_store(df.withColumn("source", F.col("target")), 2000, ["attempt"])


def test_terms_are_unescaped_once(spark):
    docs = frame(spark, [(1, "a&amp;b &lt;X&gt; it&#39;s &amp;lt; 007", "k")], "id int, t string, lang string")
    rules = frame(spark, [("k", "a&b|<x>|it's|&lt;| 7|zz")], "lang string, terms string")
    assert keys.required_terms(docs, "t", rules, "lang").first()["missing_terms"] == "zz"


def test_earlier_means_equal_those_of_the_rows_before(spark):
    r = random.Random(4)
    data = [(a, s, 1e8 + r.gauss(0, 3) if r.random() > 0.1 else None) for a in range(12) for s in r.sample(range(2000, 2010), 4) for _ in range(r.randint(1, 3))]
    df, seasons = spark.createDataFrame(data, "a int, s int, y double"), spark.createDataFrame([(s,) for s in range(2000, 2012)], "s int")
    want = {}
    for a in range(12):
        for s in range(2000, 2012):
            ys = [y for b, t, y in data if b == a and t < s and y is not None]
            if ys:
                want[s, a] = (len(ys), float(np.mean(ys)), float(np.var(ys) * len(ys)))
    got = {(x["s"], x["a"]): (x["n"], x["m"], x["ss"]) for x in stats.earlier_means(df, "a", "s", "y", seasons).collect()}
    assert got.keys() == want.keys()
    for k, (n, m, ss) in want.items():
        assert got[k][0] == n and abs(got[k][1] - m) < 1e-6 and abs(got[k][2] - ss) < 1e-5 * max(1, ss)
    assert stats.earlier_means(df.where("false"), "a", "s", "y", seasons).collect() == []
