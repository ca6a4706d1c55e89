"""Operator 6 worked out term by term: terms, screens, one pass of training and scores."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from grainline.llm import toxicity
from grainline.llm.tokens import chunks, text_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, score string, toxic string, predicted int, slots int"
OPTIONS = dict(min_docs=2, min_z=1.5, pair_z=1.8, pair_terms=30, epochs=2, batch=16)


def slot(term):
    return int(next(chunks(text_array(pa.array([term])))).hashes()[0] >> np.uint64(64 - toxicity.SLOT_BITS))


def terms(text):
    out = set()
    for w in WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)})):
        out.add(w)
        out |= {w[:n] for n in (4, 5, 6, 7) if len(w) > n}
    return sorted({slot(t) for t in out})


def by_hand(docs, labels):
    toxic = {}
    for d, y in labels:
        if d is not None and y is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            toxic[d] = max(toxic.get(d, 0), y)
    rows = [(terms(t), int(toxic[d] > 0)) for d, t, _ in docs if d in toxic]
    p = min(max(sum(y for _, y in rows) / len(rows), 1e-3), 1 - 1e-3)
    n, hits = {}, {}
    for s, y in rows:
        for t in s:
            n[t], hits[t] = n.get(t, 0) + 1, hits.get(t, 0) + y
    kept = {t for t in n if n[t] >= OPTIONS["min_docs"] and abs(hits[t] - n[t] * p) / math.sqrt(n[t] * p * (1 - p)) >= OPTIONS["min_z"]}
    top = sorted(sorted(n, key=lambda t: (-n[t], t))[:OPTIONS["pair_terms"]])
    logit = lambda q: math.log(q / (1 - q))
    lift = {t: logit(min(max((hits[t] + 0.5) / (n[t] + 1), 1e-3), 1 - 1e-3)) - logit(p) for t in top}
    for a in top:
        for b in top:
            both = [y for s, y in rows if a in s and b in s]
            q = 1 / (1 + math.exp(-(lift[a] + lift[b] + logit(p))))
            if a != b and len(both) >= toxicity.PAIR_DOCS and abs(sum(both) - len(both) * q) / math.sqrt(max(len(both) * q * (1 - q), 1e-9)) >= OPTIONS["pair_z"]:
                kept |= {a, b}
    kept = sorted(kept)
    at = {t: i for i, t in enumerate(kept)}
    sets = sorted((np.array([t for t in s if t in at], np.int32).tobytes(), y) for s, y in rows)
    data = [([at[t] for t in np.frombuffer(s, np.int32).tolist()], y) for s, y in sets]

    g = np.random.Generator(np.random.PCG64(toxicity.SEED))
    k = toxicity.FACTORS
    w, v = [0.0] * len(kept), g.normal(0, 0.01, (len(kept), k)).tolist()
    bias, gb, gw, gv = logit(p), 1.0, [1e-2] * len(kept), [[1e-1] * k for _ in kept]

    def margin(ids):
        return bias + sum(w[i] for i in ids) + sum(sum(v[i][f] * v[j][f] for f in range(k)) for x, i in enumerate(ids) for j in ids[:x])

    for _ in range(OPTIONS["epochs"]):
        order = g.permutation(len(data)).tolist()
        for b in range(0, len(order), OPTIONS["batch"]):
            own = [data[i] for i in order[b:b + OPTIONS["batch"]]]
            err = [1 / (1 + math.exp(-margin(ids))) - y for ids, y in own]
            dw, dv = {}, {}
            for (ids, _), e in zip(own, err):
                for i in ids:
                    dw[i] = dw.get(i, 0.0) + e / len(own)
                    old = dv.get(i, [0.0] * k)
                    dv[i] = [old[f] + e * sum(v[j][f] for j in ids if j != i) / len(own) for f in range(k)]
            new_w, new_v = list(w), [list(x) for x in v]
            for i in dw:
                d = dw[i] + 2e-4 * w[i]
                gw[i] += d * d
                new_w[i] = w[i] - 0.1 * d / math.sqrt(gw[i])
                for f in range(k):
                    d = dv[i][f] + 2e-4 * v[i][f]
                    gv[i][f] += d * d
                    new_v[i][f] = v[i][f] - 0.05 * d / math.sqrt(gv[i][f])
            d = sum(err) / len(err)
            gb += d * d
            w, v, bias = new_w, new_v, bias - 0.1 * d / math.sqrt(gb)
    return [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2, 1 / (1 + math.exp(-margin([at[t] for t in terms(x) if t in at])))) for d, x, _ in docs], kept


def test_predictions_equal_those_worked_out_by_hand(spark):
    r = random.Random(12)
    vocab = [f"word{i}" for i in range(25)] + ["Insults", "GROUPED", "é", "ab", "abcd", "abcdefghij"]
    docs, labels = [], []
    for i in range(160):
        own = [r.choice(vocab) for _ in range(r.randint(1, 12))]
        bad = ("Insults" in own and "GROUPED" in own) or "word3" in own
        docs.append((i, r.choice([" ", "\n", "\t "]).join(own), "en"))
        labels.append((i, int(bad != (r.random() < 0.05))))
    docs += [(500, None, None), (501, "", "de"), (502, " \n", "de"), (503, "Insults GROUPED " * 20_000, "en"), docs[5], docs[5], (None, "word3 word3", "en"), (504, "never seen", "en")]
    labels += [(7, None), (None, 1), (8, 1), (8, 0), (501, 0)]
    df = spark.createDataFrame([(*d, "x", "y", 3, 4) for d in docs], SCHEMA).repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    want, kept = by_hand(docs, labels)
    assert len(kept) > 5
    got = toxicity.predict(df, lab, **OPTIONS).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[2])
    for a, b in zip(sorted((tuple(g) for g in got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9) and a[3] == int(b[2] >= 0.3)
    assert len({round(x[2], 12) for x in want if x[0] in (500, 501, 502, 504)}) == 1  # texts without a known term get the bias
