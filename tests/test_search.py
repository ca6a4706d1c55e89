"""Likeness by edit distance and nearest neighbours against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from grainline.operators import fuzzy, neighbours

from .conftest import rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("loss", [(1, 5), (1, 3), (1, 10)])
def test_all_texts_alike_are_found(spark, loss):
    r = random.Random(5)
    known = {"".join(r.choice("abc ") for _ in range(r.randint(1, 14))) for _ in range(150)} | {"éa", "日本語のテ", "", "abababababababab"}
    said = []
    for k in sorted(known):
        t = list(k)
        for _ in range(r.randint(0, 4)):
            at = r.randint(0, len(t))
            t[at:at + r.choice([0, 1])] = r.choice([[], ["x"], ["b"], ["a", "b"]])
        said.append("".join(t))
    a, b = loss
    want = sorted((i, j) for i, x in enumerate(said) for j, y in enumerate(sorted(known)) if x and y and b * distance(x, y) <= a * max(len(x), len(y)))
    left = spark.createDataFrame([*enumerate(said), (999, None)], "i int, said string")
    right = spark.createDataFrame([*enumerate(sorted(known)), (999, None)], "j int, known string")
    got = fuzzy.alike(left, right, "i", "j", "said", "known", loss)
    assert rows(got.select("i", "j")) == want and len(want) > 20
    assert got.where(F.col("score") < 1 - a / b - 1e-12).isEmpty()
    first = [(i, j) for i, j in want if said[i][0] != sorted(known)[j][0]]
    assert first  # also where the first letters differ


def test_candidates_are_few_where_texts_are_unlike(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    met = fuzzy.probes(df, "i", "t").join(fuzzy.pieces(df, "i", "t").withColumnRenamed("i", "j"), ["size", "part", "piece"]).select("i", "j").distinct().count()
    assert met < 2000 * 2000 / 10


def points(n, d, seed=1):
    r = random.Random(seed)
    return [(i, *(r.choice([0.0, 1.0, r.gauss(0, 1), r.gauss(5, 0.1)]) for _ in range(d))) for i in range(n)]


@pytest.mark.parametrize("d", [1, 2, 5])
def test_nearest_equals_all_pairs(spark, d):
    names = [f"f{i}" for i in range(d)]
    schema = "id int, " + ", ".join(f"{n} double" for n in names)
    train, ask = points(300, d), points(60, d, seed=2) + [(900, *([50.0] * d)), (901, *([-50.0] * d))]
    between = lambda x, y: sum((a - b) ** 2 for a, b in zip(x[1:], y[1:])) / d
    t, q = spark.createDataFrame(train, schema), spark.createDataFrame(ask + [(902, *([None] * d))], schema)
    got = neighbours.nearest(q, t, ["id"], names, leaf_rows=8)
    assert {r["id"]: r["nearest"] for r in got.collect()} == pytest.approx({x[0]: min(between(x, y) for y in train) for x in ask})
    own = neighbours.nearest(t, t, ["id"], names, itself=True, leaf_rows=8)
    assert {r["id"]: r["nearest"] for r in own.collect()} == pytest.approx({x[0]: min(between(x, y) for y in train if y is not x) for x in train})


def test_many_rows_at_one_point_and_no_points(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(5000)] + [(5000, 4.0, 6.0)], "id int, a double, b double")
    got = {r["id"]: r["nearest"] for r in neighbours.nearest(df, df, ["id"], ["a", "b"], itself=True, leaf_rows=2).collect()}
    assert len(got) == 5001 and got[0] == 0 and got[5000] == pytest.approx(12.5)
    assert neighbours.nearest(df, df.where("false"), ["id"], ["a", "b"]).collect() == []
    alone = df.where("id = 5000")
    assert neighbours.nearest(alone, alone, ["id"], ["a", "b"], itself=True).collect() == []
