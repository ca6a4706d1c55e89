"""Operator 8: what the schedule of low-discrepancy points decides."""

import pytest
from pyspark.sql import functions as F

from grainline.llm import mixing


def docs(spark):
    rows = [(i, " ".join(f"w{i}" for _ in range(20 + i % 90)), ["a", "a", "a", "b", "c", None][i % 6]) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_every_prefix_of_the_schedule_has_the_shares_of_the_targets(spark):
    third = mixing.PERIOD // 3
    shares = spark.createDataFrame([("a", 0, third), ("b", third, third + third // 50), ("c", third + third // 50, mixing.PERIOD)], "source string, low long, high long")
    n = 20_000
    line = [r["source"] for r in mixing.schedule(shares, n).orderBy("slot").collect()]
    assert len(line) == n
    for source, share in (("a", 1 / 3), ("b", 1 / 150), ("c", 2 / 3 - 1 / 150)):
        seen = worst = 0
        for i, s in enumerate(line):
            seen += s == source
            worst = max(worst, abs(seen - share * (i + 1)))
        assert worst < 4  # random points would miss by about 70


def test_points_decide_the_order_and_targets_stay_met(spark, monkeypatch):
    df = docs(spark)
    run = lambda: {r["doc_id"]: r for r in mixing.mix(df, block_tokens=16).collect()}
    golden = run()
    monkeypatch.setattr(mixing, "GOLDEN", 12345)
    other = run()
    assert {d: r["taken"] for d, r in golden.items()} == {d: r["taken"] for d, r in other.items()}
    assert sum(golden[d]["first_slot"] != other[d]["first_slot"] for d in golden if golden[d]["taken"]) > 100
    for source in ("a", "b", "c", None):
        own = [r for r in golden.values() if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 1
    assert all((r["first_slot"] is None) == (r["taken"] == 0) and list(r["slots"]) == sorted(r["slots"]) for r in golden.values())


def test_prefixes_of_the_ordered_mix_have_the_shares(spark):
    df = docs(spark).withColumn("slots", F.lit("x"))
    got = mixing.apply(df, ordered=True, block_tokens=16).select("doc_id", "source", "text", "slots")
    mixed = [(r["source"], len(r["text"].split())) for r in got.collect()]
    whole = {}
    for s, n in mixed:
        whole[s] = whole.get(s, 0) + n
    total, seen, read = sum(whole.values()), dict.fromkeys(whole, 0), 0
    for s, n in mixed:
        seen[s], read = seen[s] + n, read + n
        if read > total / 20:
            assert all(abs(seen[k] - whole[k] * read / total) < 1000 for k in whole)  # a few documents of 110 words a source
    plain = mixing.apply(df, block_tokens=16)
    assert sorted(r["doc_id"] for r in plain.collect()) == sorted(r["doc_id"] for r in got.collect())
    assert plain.columns == df.columns


@pytest.mark.parametrize("text", ["", None])
def test_documents_without_words_have_no_slot(spark, text):
    df = spark.createDataFrame([(1, text, "a"), (2, "x y", "a")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(df).collect()}
    assert got == {1: (0, None), 2: (2, 0)}
