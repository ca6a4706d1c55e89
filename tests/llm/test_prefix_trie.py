"""Operator 11 against a trie built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from grainline.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, mark string, depth int, part int, bucket string, node int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = own.get(base, [])[:h] + v[h:]
    members = {}
    for c, v in sorted(rebuilt.items()):
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(k[-1][1])) if k else 0
        below = [out[x] for x in kids.get(k, [])]
        ends = ",".join(str(c) for c in members[k] if len(rebuilt[c]) == len(k))
        out[k] = (members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(below), sum(b[5] for b in below) or 1,
                  (len(members[k]) - 1) * words + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def sample(seed=3):
    r = random.Random(seed)
    texts = ["", "a", "a b", " x\ty ", "é", None, "a" * 5]
    rows = []
    for c in [*range(0, 90), 205, 207, -3, -20, -21, 10**12, 10**12 + 7]:
        if c in (40, 60):
            continue  # absent bases
        for t in range(r.choice([0, 1, 1, 2, 3, 4, 6])):
            rows.append((c, None if r.random() < 0.1 else t, r.choice(["user", "assistant", None]), r.choice(texts)))
    rows += [(3, 1, "user", "same")] * 5 + [(None, 0, "user", "x"), (200, None, None, None)]
    long = [(500, t, "user", f"w{t % 3}") for t in range(70)]
    return rows + long + [(520 + i, t, "user", f"w{t % 3}" if t < 10 * i else "z") for i in range(7) for t in range(60)]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("limit", [12, 1 << 15])
def test_trie_equals_brute_force(spark, monkeypatch, limit):
    for name, value in (("DEPTHS", 4), ("SIBLINGS", 3), ("IDS", 5)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = sample()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "m", 9, 9, "b", 1) for r in rows], SCHEMA).repartition(6)
    got = [r for r in prefix_trie.trie(df, limit=limit).collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)
    # the tour: places are all different and without gaps, and a child's arcs lie within its parent's
    assert sorted([r["enter"] for r in got] + [r["exit"] for r in got]) == list(range(2 * len(got)))
    at = {(r["conv_id"], r["depth"]): r for r in got}
    for r in got:
        if r["depth"]:
            above = at[r["parent_conv_id"], r["depth"] - 1]
            assert above["enter"] < r["enter"] < r["exit"] < above["exit"]


def test_a_conversation_over_many_partitions(spark):
    rows = [(7, t, "user", f"t{t} {t % 5}") for t in range(3000)] + [(8, t, "user", f"t{t} {t % 5}") for t in range(2500)] + [(9, 0, "a", "b"), (0, 0, "user", "t0 0"), (0, 1, "user", "t1 1")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = prefix_trie.trie(df)
        numbered = prefix_trie.turns(df).withColumn("part", F.spark_partition_id())
        assert numbered.where("conv = 7").select("part").distinct().count() > 1
        assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_conversations_and_one_node(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(1, 60) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df, limit=20).collect()) == brute(rows)
    one = spark.createDataFrame([(5, None, None, None)], "conv_id long, turn int, role string, text string")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(one).collect()) == brute([(5, None, None, None)])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(df).select(COLUMNS).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn int, role string, text string")).collect() == []
