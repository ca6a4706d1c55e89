"""Steps whose volume must grow no faster than their rows: the same results as by rows, without the shuffles that grow faster."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.operators import intervals, models, stats

from .conftest import SF_SMALL, rows


def test_held_plays_are_added_up_only_where_ids_repeat(spark):
    from grainline.plans.joins import held_plays

    r = random.Random(3)
    plays = [(g, r.randint(1, 2), 1995 + g % 2, r.randint(0, 1), r.randint(1, 4)) for g in range(12) for _ in range(4)]  # ids repeat, in several weeks and teams
    held = [(f"i{k % 5}", k % 3, 1995 + k % 2, k % 2, 1 + k % 3, 2 + k % 4) for k in range(10)]  # i0 .. i4 in several teams and seasons
    held.append(held[0])
    got = held_plays(spark.createDataFrame(plays, "game_id int, play_id int, season int, team_id int, week int"), spark.createDataFrame(held, "interval_id string, owner_id int, season int, team_id int, start_week int, end_week int"))
    want = {}
    for g, p, s, t, w in plays:
        for i, o, s2, t2, a, b in held:
            if (s, t) == (s2, t2) and a <= w <= b:
                want[g, p, i, o] = want.get((g, p, i, o), 0) + 1
    assert rows(got) == sorted((*k, n) for k, n in want.items())


def test_held_plays_are_dealt_once_where_no_id_repeats(spark):
    from grainline.plans.joins import held_plays

    plays = spark.createDataFrame([(g, 1, 1995, g % 2, 1 + g % 4) for g in range(12)], "game_id int, play_id int, season int, team_id int, week int")
    held = spark.createDataFrame([(f"i{k}", k, 1995, k % 2, 1, 2) for k in range(4)], "interval_id string, owner_id int, season int, team_id int, start_week int, end_week int")
    plan = lambda p, i: held_plays(p, i)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(plays, held).count("Join Inner") == 1 and "Aggregate" not in plan(plays, held)
    # a play without a number, in two weeks; an interval in two teams
    odd = plays.unionByName(spark.createDataFrame([(0, None, 1995, 0, w) for w in (1, 2, 2, 3)], plays.schema))
    assert rows(held_plays(odd, held).where("game_id = 0 AND play_id IS NULL")) == [(0, None, "i0", 0, 3), (0, None, "i2", 2, 3)]
    two = held.unionByName(spark.createDataFrame([("i0", 0, 1995, 1, 1, 1)], held.schema))
    assert rows(held_plays(plays, two).where("interval_id = 'i0'")) == [(g, 1, "i0", 0, 1) for g in (0, 4, 8)] == rows(held_plays(plays, held).where("interval_id = 'i0'"))
    lone = spark.createDataFrame([(20, 1, 1995, 1, 1)], plays.schema)
    assert rows(held_plays(plays.unionByName(lone), two).where("interval_id = 'i0' AND game_id = 20")) == [(20, 1, "i0", 0, 1)]


def test_plays_by_game_have_no_fewer_tasks_than_a_shuffle(spark, monkeypatch):
    from grainline.plans import bindings

    monkeypatch.setattr(bindings, "ROWS_A_TASK", 10**6)
    spark.conf.set("spark.sql.shuffle.partitions", "9")  # more than the tasks of these rows, and than the session's cores
    try:
        df = bindings.Tables(spark, SF_SMALL).plays_by_game
        assert re.findall(r"RepartitionByExpression \[(\w)_orderkey#\d+L?\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString()) == [("l", "9"), ("o", "9")]
        assert rows(df) == rows(bindings.Tables(spark, SF_SMALL).plays)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_actors_of_a_week_are_told_apart_where_they_meet_the_violations(spark):
    from grainline.plans.catalog import QUERIES

    plan = QUERIES["I04_exposure_validation"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.index("RepartitionByExpression [season")
    # the plays are dealt before they are added up, not after
    assert plan.index("Aggregate") < dealt < plan.index("l_orderkey")


def test_no_correlation_with_one_value_over_many_partitions(spark):
    df = spark.range(0, 99, 1, 3).withColumn("y", F.sin("id")).withColumn("x", F.lit(1.0)).repartition(7)
    for n in (49, 98, 99):
        r = df.where(F.col("id") < n).repartition(2).agg(stats.pearson("y", "x").alias("r")).first()["r"]
        assert r is None
    got = stats.regression_metrics(spark.range(0, 148, 1, 4).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), F.sin("id").alias("y"), F.lit(0.1).alias("p")), ["k"], "y", "p").collect()
    assert [(r["correlation"], r["slope"]) for r in got] == [(None, None)] * 2


def test_placebo_equals_correlations_of_the_permuted_rows(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(1995 + i % 3, i, 1e6 + r.random(), r.random()) for i in range(200)], "season int, id int, x double, y double")
    got = stats.permutation_placebo(df, "season", "id", "x", "y", 9, "t", 25)
    drawn = {}
    for d, x, y in stats.permutation_draws(df, "season", "id", "x", "y", 9, "t", 25).collect():
        drawn.setdefault(d, []).append((x, y))
    null = [abs(np.corrcoef(np.array(v).T)[0, 1]) for v in drawn.values()]
    actual = abs(np.corrcoef(np.array(df.select("x", "y").collect()).T)[0, 1])
    one = got.first()
    assert len(null) == 9 and all(len(v) == 200 for v in drawn.values())
    assert (one["actual"], one["null_low"], one["null_high"]) == pytest.approx((actual, np.quantile(null, 0.05), np.quantile(null, 0.95)), abs=1e-8)
    assert one["reached"] == sum(c >= actual for c in null) and one["p"] == (1 + one["reached"]) / 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # the rows of a draw are not laid out


def test_sweeps_of_effects_equal_sweeps_over_rows(spark):
    r = random.Random(6)
    data = [(i % 5, i % 3, i % 11, r.random(), 1 + r.random() * 9, r.random() * 40) for i in range(120)]
    df = spark.createDataFrame(data, "season int, team int, actor int, x double, w double, y double")
    got = models.ridge_effects(df, ["x"], {"season": F.col("season"), "team": F.col("team")}, F.col("actor"), "y", "w", 2.0, sweeps=3)
    s, t, a, x, w, y = (np.array(c, float) for c in zip(*data))
    m = (w * x).sum() / w.sum()
    z = (x - m) / np.sqrt((w * (x - m) ** 2).sum() / w.sum())
    left, slope, e = y.copy(), 0.0, [np.zeros(120) for _ in range(3)]
    for _ in range(3):
        left -= (w * left).sum() / w.sum()
        d = ((w * left * z).sum() - 2 * slope) / ((w * z * z).sum() + 2)
        slope, left = slope + d, left - d * z
        for k, level in enumerate((s, t, a)):
            for v in set(level):
                on = level == v
                d = ((w * left)[on].sum() - 2 * e[k][on][0]) / (w[on].sum() + 2)
                e[k][on] += d
                left[on] -= d
    assert got.coef["x:"] == pytest.approx(slope, abs=1e-9) and {k: v for k, v in got.coef.items() if k.startswith("season=")} == pytest.approx({f"season={v}": e[0][s == v][0] for v in range(5)}, abs=1e-9)
    assert {int(r["level"]): r["effect"] for r in got.table.collect()} == pytest.approx({v: e[2][a == v][0] for v in range(11)}, abs=1e-9)


def test_spans_that_intervals_share_are_summed_once(spark):
    cells = spark.createDataFrame([(1, a, p, float(p + a)) for a in range(3) for p in range(1, 7)], "t int, actor int, w int, v double")
    iv = spark.createDataFrame([(1, f"i{k}", 1 + k % 2, 3 + k % 2) for k in range(10)], "t int, id string, s int, e int")
    own = intervals.span_sums(intervals.lines(cells, ["t"], "actor", "w", ["v"]), iv, ["t"], "s", "e", ["v"])
    assert rows(own.select("actor", "s", "e", "points", "v")) == sorted((a, s, s + 2, 3, float(3 * (s + 1) + 3 * a)) for a in range(3) for s in (1, 2))
    got = intervals.of_spans(own, iv, ["t"], "s", "e")
    assert got.count() == 30 and got.groupBy("id").agg(F.sum("v").alias("v")).where("id = 'i1'").first()["v"] == 3 * 9 + 9


def test_a_join_of_few_keys_is_dealt_into_all_partitions(spark):
    left, right = spark.range(100).withColumn("k", F.col("id") % 4), spark.range(100, 200).withColumn("k", F.col("id") % 4).withColumnRenamed("id", "other")
    got = intervals.dealt_join(left, right, ["k"])
    assert got.count() == 4 * 25 * 25 and "RepartitionByExpression [k" in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_query_passes_over_the_plays_once(spark):
    from grainline.plans.bindings import Tables
    from grainline.plans.models import training

    t = Tables(spark, SF_SMALL)
    rows_ = training(t)
    assert not any("lineitem" in f for f in rows_.inputFiles())
    whole = Tables(spark, SF_SMALL).team_seasons
    assert any("lineitem" in f for f in whole.inputFiles()) and rows(t.team_seasons) == rows(whole)


def test_a_table_without_moves_keeps_its_placebo_row(spark, tmp_path):
    from grainline.plans.catalog import QUERIES

    for name in ("nation", "customer", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF_SMALL}/{name}.parquet")
    # owners 1 and 5 stay with their team in all seasons
    spark.read.parquet(f"{SF_SMALL}/supplier.parquet").where("s_suppkey IN (1, 2, 5)").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["J41_role_moves_expanding_z"](spark, str(tmp_path)).collect()
    assert [(r["part"], r["adoption_euclidean"], r["placebo_p"], r["n"]) for r in got] == [("trait", None, 1 / 41, 0)]
    got = QUERIES["J34_scheme_moves"](spark, str(tmp_path)).collect()
    assert [(r["part"], r["adoption"], r["placebo_p"], r["moves_n"]) for r in got] == [("placebo", None, 1 / 41, 0)]


def test_groups_within_a_game_are_built_where_its_plays_meet(spark, monkeypatch):
    from grainline.plans import bindings
    from grainline.plans.catalog import QUERIES

    monkeypatch.setattr(bindings, "ROWS_A_TASK", 100)
    t = bindings.Tables(spark, SF_SMALL)
    parts = t.plays_by_game.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("parts"), F.max("n").alias("most")).first()
    assert parts["parts"] > 40 and parts["most"] < 250  # of some 6,000 lines
    assert rows(t.plays_by_game) == rows(t.plays)
    for name in ("D01_entity_game_metrics", "A15_season_summary"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") <= 1 and "Expand" not in plan and "hashpartitioning(game_id" not in plan, name


def test_season_summary_with_repeated_keys(spark, tmp_path):
    from grainline.plans.catalog import QUERIES

    for name in ("nation", "customer"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF_SMALL}/{name}.parquet")
    at = lambda day: F.to_timestamp_ntz(F.lit(day))
    customer = spark.read.parquet(f"{SF_SMALL}/customer.parquet").agg(F.min("c_custkey")).first()[0]
    orders = spark.createDataFrame([(1, customer, "O", 10.0, "x"), (2, customer, "O", 20.0, "x")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    # order 1 stands in two seasons, order 2 in one; supplier 5 in two teams
    orders = orders.where("o_orderkey = 1").withColumn("o_orderdate", at("1995-01-05 00:00:00")).unionByName(orders.withColumn("o_orderdate", at("1996-03-05 00:00:00")))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(4, "a", 0, 1.0), (5, "b", 1, 1.0), (5, "c", 2, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(1, 1, 4, 0.0), (1, 2, 5, 0.0), (2, 1, 4, 0.0), (2, 1, 4, 0.01), (2, 2, 4, 0.01)]
    spark.createDataFrame([(o, 1, s, n, 1.0, 1.0, 0.0, tax, "R", "O") for o, n, s, tax in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["A15_season_summary"](spark, str(tmp_path)).select("season", "games", "plays", "actors", "actor_games", "resolved", "unresolved", "missing", "actor_seasons", "qualified", "gaps")
    # order 1's lines are met in both seasons, and its second line in two teams: no key of it is its own
    assert rows(got) == [(1995, 1, 3, 2, 2, 0, 3, 3, 3, 0, 25 * 12 - 3), (1996, 2, 6, 2, 3, 1, 5, 4, 3, 0, 25 * 12 - 3)]
