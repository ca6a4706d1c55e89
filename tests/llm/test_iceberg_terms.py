"""Operator 13 against counts of every term of every text."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.llm import iceberg_terms as it

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, docs int, n string, key long, part string"


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(rows, min_docs, top):
    held, n, groups = {}, {}, set()
    for i, (_, text, lang, source) in enumerate(rows):
        g = (lang or "", source or "")
        groups.add(g)
        for t in terms(text):
            held.setdefault((g[0], t), set()).add(i)
            n[g, t] = n.get((g, t), 0) + 1
    kept = {}
    for (lang, t), docs in held.items():
        if len(docs) >= min_docs:
            kept.setdefault(lang, []).append(t)
    out = []
    share = lambda c, total, v: 1 + 10**9 * (c + 1) // (total + v)
    p, q = {}, {}
    for g in groups:
        ts = kept.get(g[0], [])
        total = sum(n.get((g, t), 0) for t in ts)
        p[g] = {t: share(n.get((g, t), 0), total, len(ts)) for t in ts}
    for lang, ts in kept.items():
        own = [g for g in groups if g[0] == lang]
        count = {t: sum(n.get((g, t), 0) for g in own) for t in ts}
        q[lang] = {t: share(count[t], sum(count.values()), len(ts)) for t in ts}
    f = lambda a, b: (a - b) ** 2 // b
    for g in groups:
        pair = [(-sum(f(p[g][t], p[o][t]) for t in p[g]), o[1].encode()) for o in groups if o[0] == g[0] and o != g]
        out += [(*g, "pair", item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(pair))]
        term = [(-f(p[g][t], q[g[0]][t]), t.encode()) for t in p[g] if n.get((g, t)) and p[g][t] > q[g[0]][t]]
        out += [(*g, "term", item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(term)[:top])]
    return sorted(out)


def sample(seed=2):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abAB") for _ in range(r.randint(1, 5))) for _ in range(120)]
    vocab += [w + "longer" * k for k, w in enumerate(vocab[:12])] + ["é" * k for k in range(1, 9)] + ["漢字", "x" * 300, "x" * 300 + "y", "日" * 40]
    rows = []
    for i in range(150):
        text = "".join(r.choice(vocab[:r.choice([5, len(vocab)])]) + r.choice([" ", "1", "_", "\x00", "[", "\n"]) for _ in range(r.choice([0, 1, 5, 40])))
        rows.append((i, r.choice([text, text, text, None]) if i % 9 == 0 else text, r.choice(["en", "de", None]), r.choice(["s1", "s2", "", None, "é"])))
    rows += [rows[5]] * 4 + [(900, "only", "xx", "s1"), (901, "123", "xx", "s2"), (902, None, "one", "s1"), (903, " ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(30_000)), "en", "s1")]
    return rows


@pytest.mark.parametrize("min_docs, first, top", [(3, 4, 200), (2, 1, 3), (5, 2, 10)])
def test_audit_equals_brute_force(spark, min_docs, first, top):
    rows = sample()
    df = spark.createDataFrame([(*r, "t", 1, "n", 5, "p") for r in rows], SCHEMA).repartition(6)
    assert sorted(tuple(r) for r in it.audit(df, min_docs, top, first).collect()) == brute(rows, min_docs, top)


def test_prefixes_are_discarded_before_their_terms_are_counted(spark):
    rows = [("en", "s", f"common{chr(97 + i % 5)} rare{chr(97 + i // 26)}{chr(97 + i % 26)}tail{'z' * 30}") for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    bits, levels = it.refine(df, min_docs=4, first=4)
    left = {r["term"] for r in it.term_counts(df, bits, 4).collect()}
    assert left == {f"common{chr(97 + i)}" for i in range(5)}
    # "rare" stays at the first level, its extensions do not: no level looks at 16 bytes or more
    assert levels == 2 and it.prefix_counts(df, 2, bits, 4).count() == 0
    first = it.prefix_counts(df, 0, None, 4).groupBy("key").agg(F.sum("docs").alias("n")).collect()
    assert sorted(r["n"] for r in first) == [60, 60]


def test_a_full_map_changes_nothing(spark, monkeypatch):
    rows = sample(4)
    df = spark.createDataFrame([(*r, "t", 1, "n", 5, "p") for r in rows], SCHEMA)
    full = spark.sparkContext.broadcast(np.full((1 << it.BITS) // 8, 255, np.uint8))
    monkeypatch.setattr(it, "refine", lambda *_: (full, 1))
    assert sorted(tuple(r) for r in it.audit(df, 3, 50).collect()) == brute(rows, 3, 50)


def test_tasks_pass_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(it, "HELD", 20)
    monkeypatch.setattr(it, "BLOCK_TERMS", 7)
    rows = sample(6)
    df = spark.createDataFrame([(*r, "t", 1, "n", 5, "p") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in it.audit(df, 3, 50).collect()) == brute(rows, 3, 50)


def test_large_counts_are_exact(spark):
    n, total = np.array([[9_300_000_000, 5]]), np.array([[40_000_000_000, 10]])
    assert it._share(n, total).tolist() == [[1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(n[0], total[0])]]
    got = spark.createDataFrame([(9_300_000_000_000, 40_000_000_000_001)], "n long, t long").select(it.exact_share("n", "t").alias("p")).first()[0]
    assert got == 1 + 10**9 * 9_300_000_000_001 // 40_000_000_000_001


def test_empty_table(spark):
    assert it.audit(spark.createDataFrame([], SCHEMA)).collect() == []
