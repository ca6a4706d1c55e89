"""Operator 12 against measures and cutoffs worked out row by row."""

import hashlib
import math
import random
import re
from fractions import Fraction

import pyarrow as pa
import pytest

from grainline.llm import quality_rules as qr
from grainline.llm.tokens import chunks, text_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept int, rule string, quality int"


def counts(text):
    words = WORD.findall(text or "")
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


def texts(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß漢#") for _ in range(r.randint(1, 8)))
    out = [None, "", " \t\n\x0b\x0c\r ", "a", "a a", "a a a", "a a a a", "x y z x y z", "l\nl\nm\n \n \nl", "é" * 9, "line\x1cone \x85two three"]
    for _ in range(60):
        out.append("".join(word() + r.choice([" ", "\n", "\t", "  "]) for _ in range(r.randint(1, 90))))
    return [*out, "b c d " * 40, " ".join(word() for _ in range(40_000)), "same\n" * 70]


def test_measures_equal_brute_force():
    every = texts()
    got = [tuple(row) for c in chunks(text_array(pa.array(every))) for row in qr.measure(c).tolist()]
    assert got == [counts(t) for t in every]


@pytest.mark.parametrize("share", [0.0125, 0.05])
def test_binomial_tail_is_exact(share):
    for n in (1, 7, 100, 900, 3000):
        for k in {0, 1, 2, int(n * share) - 1, int(n * share * 0.6)}:
            if 0 <= k < n * share:
                a = Fraction(share)
                exact = sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
                assert qr.lower_tail(k, n, share) == pytest.approx(float(exact), rel=1e-9)
    assert qr.lower_tail(5, 10, share) == 1 and 0 <= qr.lower_tail(10**8 // 2, 10**10, 0.0125) < 1e-300


def labelled(n=4000, seed=8):
    """Three strata: enough labels, enough labels but symbols in good texts too, and few labels."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = "ok" if i % 2 else ("noisy" if i % 40 else "few")
        bad = r.random() < 0.2
        symbol = "#" if bad or (lang == "noisy" and r.random() < 0.5) else ""
        text = " ".join(f"w{r.randint(0, 10**6)}{symbol if r.random() < 0.3 else ''}" for _ in range(60))
        docs.append((i, text, lang))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def expected(docs, labels, risk, delta):
    quality = {}
    for d, q in labels:
        if d is not None and q is not None:
            quality[d] = max(q, quality.get(d, 0))
    of, seen = {}, {}
    for d, t, lang in docs:
        c = dict(zip(qr.COUNTS, counts(t)))
        base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        key = int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
        of.setdefault(d, []).append((lang or "", c, base))
        if not base and d in quality:
            old = seen.get((lang or "", key), (0,))[0]
            seen[lang or "", key] = (max(old, quality[d]), c)
    strata = {lang for (lang, key), (q, _) in seen.items() if q and key % qr.FOLDS}
    chosen = {}
    for lang in strata:
        rows = [(key % qr.FOLDS != 0, q, c) for (s, key), (q, c) in seen.items() if s == lang]
        for rule, (top, bottom, grid) in qr.RULES.items():
            best = (0, None)
            for x in reversed(grid):
                over = [(h, q) for h, q, c in rows if c[top] * 1000 > c[bottom] * x]
                n, k = sum(h and q for h, q, _ in rows), sum(h and q for h, q in over)
                a = Fraction(risk / len(qr.RULES))
                p = sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1)) if k < n * a else 1
                if p > delta / (len(strata) * len(qr.RULES)):
                    break
                gain = sum(not h and not q for h, q in over) - qr.GOOD_COST * sum(not h and q > 0 for h, q in over)
                if gain > best[0]:
                    best = (gain, x)
            if best[1] is not None:
                chosen[lang, rule] = best[1]
    return chosen, of


def test_cutoffs_and_verdicts_equal_brute_force(spark):
    docs, labels = labelled()
    docs += [(10_000, None, None), (10_001, "", "ok"), (10_002, "a b c " * 30, "ok"), (None, docs[0][1], "ok"), (7, docs[7][1], "ok"), (10_003, docs[9][1], "ok"), (10_004, docs[1][1], None)]
    labels += [(7, 0), (7, None), (None, 1), (10_003, 0), (10_000, 1), (99_999, 1), (10_004, 1)]
    df = spark.createDataFrame([(d, t, lang, "s", "x", 3, "y", 5) for d, t, lang in docs], SCHEMA).repartition(5)
    lab = spark.createDataFrame([(d, q, 0) for d, q in labels], "doc_id long, quality int, toxic int")
    chosen, of = expected(docs, labels, 0.05, 0.05)
    assert ("ok", "symbols") in chosen and ("noisy", "symbols") not in chosen and not any(s == "few" for s, _ in chosen)
    got = qr.judge(df, lab).collect()
    want = []
    for d, rows in of.items():
        for lang, c, base in rows:
            hit = any(c[top] * 1000 > c[bottom] * chosen[lang, r] for r, (top, bottom, _) in qr.RULES.items() if (lang, r) in chosen)
            want.append((d, *c.values(), base, not base and not hit))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:-1] for r in got), key=key) == sorted(want, key=key)
    assert all((r["reason"] is None) == r["kept"] for r in got)
    # the promise: of good texts outside the sample a share of at most the risk is rejected
    fresh, truth = labelled(3000, seed=99)
    good = {d for d, q in truth if q}
    more = spark.createDataFrame([(d, t, lang, "s", "x", 3, "y", 5) for d, t, lang in docs + [(d + 50_000, t, lang) for d, t, lang in fresh]], SCHEMA)
    lost = [r for r in qr.judge(more, lab).where("doc_id >= 50000 AND NOT base_failed AND NOT kept").select("doc_id").collect() if r[0] - 50_000 in good]
    assert len(lost) <= 0.05 * len(good)


def test_without_labels_and_empty_tables(spark):
    docs, labels = labelled(200)
    df = spark.createDataFrame([(str(d), t, lang) for d, t, lang in docs], "doc_id string, text string, lang string")
    none = spark.createDataFrame([], "doc_id string, quality int")
    assert qr.judge(df, none).where("NOT base_failed AND NOT kept").count() == 0
    assert qr.judge(df.limit(0), none).collect() == []
    assert qr.judge(df.limit(0), spark.createDataFrame([("1", 1)], "doc_id string, quality int")).collect() == []
