"""Interval sweeps against brute force over all pairs, and hot groups that no pairs could be made of."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from grainline.operators import intervals

from .conftest import rows


def sample(n=120, seed=4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        start = r.randint(-3, 30)
        out.append((r.choice("gh"), r.randint(0, 4), i, start, start + r.choice([0, 1, 3, 9]), r.random() < 0.4))
    return out


SCHEMA = "g string, owner int, id int, s int, e int, shared boolean"
lap = lambda a, b: a[3] <= b[4] and b[3] <= a[4]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(4)


def test_cover_counts_intervals_at_every_point(df):
    want = {}
    for g, _, _, s, e, _ in sample():
        for p in range(s, e + 1):
            want[g, p] = want.get((g, p), 0) + 1
    assert rows(intervals.cover_points(df, ["g"], "s", "e", "p")) == sorted((g, p, k) for (g, p), k in want.items())
    stretches = intervals.cover(df, ["g"], "s", "e").collect()
    assert all(r["low"] <= r["high"] and r["k"] > 0 for r in stretches)


def test_overlap_counts_equal_all_pairs(df):
    data = sample()
    got = intervals.overlap_counts(df, ["g"], "s", "e", {"n": F.lit(1), "shared": F.col("shared").cast("int")}).select("id", "over_n", "over_shared")
    assert rows(got) == sorted((a[2], sum(a[0] == b[0] and lap(a, b) for b in data), sum(a[0] == b[0] and lap(a, b) and b[5] for b in data)) for a in data)


def test_conflicts_and_their_pairs_equal_all_pairs(df):
    data = sample()
    both = [(a, b) for a, b in itertools.combinations(data, 2) if a[0] == b[0] and lap(a, b)]
    illegal = [(a, b) for a, b in both if not (a[5] and b[5])]
    got = intervals.conflicts(df, ["g"], "s", "e", F.col("shared")).select("id")
    assert rows(got) == sorted({(x[2],) for p in illegal for x in p})
    for shared, want in ((None, both), ("shared", illegal)):
        pairs = intervals.conflict_pairs(df, ["g"], "id", "s", "e", [], shared).select("g", "a_id", "b_id", "overlap_start", "overlap_end")
        assert rows(pairs) == sorted((a[0], a[2], b[2], max(a[3], b[3]), min(a[4], b[4])) for a, b in want)


def test_open_ends_and_dates(spark):
    d = lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(k)
    far = datetime.date(9999, 12, 31)
    df = spark.createDataFrame([("x", 1, d(0), far), ("x", 2, d(500), d(600)), ("x", 3, d(700), far), ("x", 4, d(601), d(699)), ("y", 5, d(0), d(1)), ("y", 6, d(2), d(3))], "k string, id int, s date, e date")
    assert rows(intervals.conflict_pairs(df, ["k"], "id", "s", "e", [], width=64).select("a_id", "b_id", "overlap_start")) == [(1, 2, d(500)), (1, 3, d(700)), (1, 4, d(601))]


def test_links_equal_all_pairs(df):
    data, want = sample(), {}
    for a, b in itertools.permutations(data, 2):
        if a[0] == b[0] and a[1] < b[1] and lap(a, b):
            old = want.get((a[0], a[1], b[1]), (0, 0))
            want[a[0], a[1], b[1]] = (old[0] + 1, old[1] + (a[5] and b[5]))
    got = intervals.overlap_links(df, ["g"], "owner", "s", "e", {"n": F.lit(True), "both": F.col("shared")}).select("g", "a", "b", "n", "both")
    assert rows(got) == sorted((*k, *v) for k, v in want.items())


def test_running_sums_split_a_key(spark):
    data = [("hot", i % 700, i % 13) for i in range(5000)] + [("cold", i, 1) for i in range(5)]
    df = spark.createDataFrame(data, "k string, p int, v int")
    want = {}
    for k, p, _ in data:
        want[k, p] = sum(v for q, o, v in data if q == k and o <= p) if (k, p) not in want else want[k, p]
    assert {(r["k"], r["p"], r["v_upto"]) for r in intervals.running(df, ["k"], "p", ["v"]).collect()} == {(*k, v) for k, v in want.items()}


def test_one_group_of_100_000_intervals(spark):
    """All pairs would be 5 * 10^9."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") % 3).cast("int").alias("owner"), F.col("id"), F.col("id").alias("s"), (F.col("id") + 4).alias("e"), F.lit(False).alias("shared"))
    got = rows(intervals.overlap_links(df, ["g"], "owner", "s", "e").select("a", "b", "n"))
    want = {}
    for i in range(n):
        for j in range(i + 1, min(i + 5, n)):
            k = tuple(sorted((i % 3, j % 3)))
            want[k] = want.get(k, 0) + 1
    assert got == sorted((*k, v) for k, v in want.items() if k[0] != k[1])
    apart = df.withColumn("s", F.col("id") * 2).withColumn("e", F.col("id") * 2 + 1)
    assert intervals.conflicts(apart, ["g"], "s", "e", F.col("shared")).count() == 0 and intervals.conflict_pairs(apart, ["g"], "id", "s", "e", [], "shared").count() == 0


def test_exposures_equal_sums_over_the_cells_within(spark):
    r = random.Random(2)
    cells = [(1, a, p, float(r.randint(-5, 9)), float(r.randint(0, 3))) for a in range(5) for p in r.sample(range(12), 6)]
    iv = [(1, f"i{k}", s, s + r.randint(0, 5)) for k, s in enumerate(range(0, 12, 2))]
    got = intervals.exposures(spark.createDataFrame(cells, "t int, actor int, w int, v double, n double"), spark.createDataFrame(iv, "t int, id string, s int, e int"), ["t"], "actor", "w", "s", "e", ["v", "n"], ["id"])
    want = []
    for _, i, s, e in iv:
        for a in range(5):
            own = [c for c in cells if c[1] == a and s <= c[2] <= e]
            if own:
                want.append((i, a, len(own), sum(c[3] for c in own), sum(c[4] for c in own)))
    assert rows(got) == sorted(want)


def test_uncovered_rows_stay_or_are_an_error(spark):
    facts = spark.createDataFrame([(1, 1), (1, 5)], "t int, w int")
    weeks = intervals.cover_points(spark.createDataFrame([(1, 0, 3)], "t int, s int, e int"), ["t"], "s", "e", "w")
    assert rows(intervals.covered(facts, weeks, ["t", "w"])) == [(1, 1, 1), (1, 5, None)]
    with pytest.raises(ValueError, match="1 rows"):
        intervals.covered(facts, weeks, ["t", "w"], strict=True)
    assert intervals.covered(facts.where("w = 1"), weeks, ["t", "w"], strict=True).count() == 1
