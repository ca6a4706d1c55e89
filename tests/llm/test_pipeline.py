"""Each stage of the pipeline against a brute-force version of its decisions."""

import collections
import math

import pytest

import corpus_pipeline
from grainline.llm import toxicity

from .test_operators import WORD, brute_join, brute_targets, corpus, lower

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    data = [(*row, len(row[1] or "")) for row in corpus(n=80)]
    toxic = [(1000 + i, f"some words vileness{i % 3} here {i} and more of it", "en", "s1", 0) for i in range(16)]
    data += [(None, "a document without an id that nobody else has", "en", "s1", 0)]
    spark.createDataFrame(data + toxic, SCHEMA).repartition(4).write.parquet(f"{root}/documents.parquet")
    labels = [(d, 1, 0) for d, *_ in data if d is not None] + [(d, 1, 1) for d, *_ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def read(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]


def test_toxicity_stage_drops_what_the_machine_rejects(spark, sf):
    docs = read(spark, sf)
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    scores = toxicity.predict(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = collections.Counter(r["doc_id"] for r in scores.where("predicted = 0").collect())
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == want
    assert not any(d is not None and d >= 1000 for d in want) and set(d for d, *_ in corpus(n=80)) <= set(want)


def test_exact_stage_keeps_the_largest_id_once(spark, sf):
    docs = read(spark, sf)
    best = {}
    for r in docs.collect():
        t = lower(r["text"])
        if t not in best or (r["doc_id"] is not None and (best[t] is None or r["doc_id"] > best[t])):
            best[t] = r["doc_id"]
    got = [(lower(r["text"]), r["doc_id"]) for r in corpus_pipeline.drop_copies(spark, docs, sf).collect()]
    assert sorted(got, key=str) == sorted(best.items(), key=str)


def test_near_stage_keeps_one_of_each_group(spark, sf):
    docs = read(spark, sf)
    data = [tuple(r) for r in docs.collect()]
    ranked = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0))
    found = brute_join([(k, data[i][1]) for k, i in enumerate(ranked)])  # numbers in the order of doc_id
    want = collections.Counter(data[ranked[k]][0] for k, c, *_ in found if k == c)
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect())
    assert got == want and len(found) > sum(want.values())


def test_stages_keep_extra_columns_and_take_empty_tables(spark, sf):
    extra = read(spark, sf).selectExpr("*", "1 AS _row", "2 AS _copy", "'x' AS kept", "'y' AS class_id", "3 AS _own", "4 AS _doc", "5 AS size", "6 AS first")
    none = extra.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, sf)
        assert got.columns == extra.columns and got.where("_row = 1 AND _copy = 2 AND kept = 'x' AND _own = 3 AND size = 5").count() == got.count() > 0, name
        assert stage(spark, none, sf).count() == 0
    assert corpus_pipeline.pack(spark, none, sf).count() == 0


def test_near_stage_tells_rows_without_an_id_apart(spark, sf):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    data = [(None, a), (None, a + " more"), (5, b), (5, "quite another text of its own words here"), (2, b + " more"), (None, None), (None, "")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(data, "doc_id long, text string"), sf).collect()
    assert len(got) == 5 and sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [2, 5]


def test_mixing_stage_repeats_documents_to_the_targets(spark, sf):
    docs = read(spark, sf)
    size = lambda t: len(WORD.findall(t or ""))
    sizes, longest = collections.Counter(), 0
    for r in docs.collect():
        sizes[r["source"]] += size(r["text"])
        longest = max(longest, size(r["text"]))
    got = collections.Counter()
    times = collections.Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, sf).collect():
        got[r["source"]] += size(r["text"])
        times[r["doc_id"], r["text"]] += 1
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - t) <= longest + 4 * 128
    assert max(times.values()) <= 6  # three times, of rows that may repeat once


def test_whole_run_packs_every_piece(spark, sf):
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert len(got) and got.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) + 1
