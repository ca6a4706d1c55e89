"""Columns named as the operators name their own, very long texts, repeated rows and rows without an id."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from grainline.llm import best_fit, exact_dedup, ngram_join, queries, tokens, toxicity, warc

CLASH = {"_row": "int", "_group": "int", "piece": "int", "band": "int", "comp": "string", "block": "long", "class_id": "int", "start": "string", "sequence_id": "int", "keep_id": "int", "score": "string"}


def texts():
    base = " ".join(f"w{i}" for i in range(40))
    return [(1, base), (2, base.upper()), (3, base + " more"), (4, None), (5, ""), (6, "other words of a text of its own"), (6, "other words of a text of its own"), (None, base), (7, " ".join(f"z{i}" for i in range(30_000)))]


@pytest.fixture(scope="module")
def clashing(spark):
    data = [(*r, *(("x" if t == "string" else i) for t in CLASH.values())) for i, r in enumerate(texts())]
    return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"{n} {t}" for n, t in CLASH.items())).repartition(3)


def test_own_names_as_columns_of_the_input_change_nothing(spark, clashing):
    plain, path = clashing.select("doc_id", "text"), queries.tokenizer_path()
    rows = lambda df: collections.Counter(map(str, df.collect()))
    assert rows(exact_dedup.dedup(clashing)) == rows(exact_dedup.dedup(plain))
    assert rows(ngram_join.join(clashing)) == rows(ngram_join.join(plain))
    place = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (best_fit.pack_documents(d, path).select(*place) for d in (clashing, plain))
    assert rows(a) == rows(b) and a.count() == b.count() > len(texts())


def test_toxicity_of_long_and_repeated_texts_beside_other_columns(spark, clashing):
    chunk = next(tokens.chunks(tokens.text_array(pa.array(["w0 z29999"]))))
    slots = np.unique(toxicity.text_slots(chunk)[0]).astype(np.int64)
    machine = toxicity.Machine(-1.5, slots, np.resize([2.0, -1.0], len(slots)), np.zeros((len(slots), 4)))
    got = sorted((r["doc_id"] or 0, round(r["score"], 9)) for r in toxicity.score(clashing, machine).collect())
    plain = sorted((r["doc_id"] or 0, round(r["score"], 9)) for r in toxicity.score(clashing.select("doc_id", "text"), machine).collect())
    assert got == plain and len(got) == len(texts())
    by_id = dict(got)
    bias = round(1 / (1 + math.exp(1.5)), 9)
    assert by_id[4] == by_id[5] == by_id[6] == bias != by_id[1] == by_id[2]  # null, empty, none of the terms; capitals count as small letters
    assert by_id[7] != bias  # its last word is one of the terms
    kept = toxicity.reject(clashing, machine, threshold=0.3)
    assert kept.columns == clashing.columns
    assert collections.Counter(r["doc_id"] or 0 for r in kept.collect()) == collections.Counter(d for d, p in got if p < 0.3)


def test_pages_without_an_id_are_responses_each_where_no_page_has_one(spark):
    pages = spark.createDataFrame([(None, "a", "x"), (None, "b", "x"), (None, "a", "x"), (None, "c", "y"), (2, "d", "y")], "page_id long, url string, html string")
    back = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive(spark, pages).collect())
    assert back == {(None, "response", None): 3, (None, "revisit", 2): 1, (2, "response", None): 1}


def test_packing_stage_places_every_row_of_nulls_and_repeats(spark, clashing):
    got = corpus_pipeline.pack(spark, clashing, "").toPandas()
    size = collections.Counter(-1 if np.isnan(d) else int(d) for d in got.doc_id.astype(float))
    assert set(size) == {-1, 1, 2, 3, 4, 5, 6, 7} and size[6] == 2 and size[7] > 1
    assert got[got.doc_id.isin([4, 5])].length.tolist() == [1, 1]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    whole = got[got.doc_id == 7].sort_values("piece")
    assert whole.piece.tolist() == list(range(len(whole))) and (whole.length[:-1] == 4096).all()
