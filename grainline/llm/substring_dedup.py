"""Substring deduplication by FM-indexes per shard (operator 1).

A window is `window` consecutive words of one text; a word covered by a window that occurs anywhere else is removed.

1. Anchors. Each window has one anchor, the anchor-gram of least hash in it (leftmost on ties), so equal windows have equal
   anchors. Runs of windows with one anchor form a segment: the words that those windows cover. About one word in 14 is
   an anchor. Anchor hashes are counted over the whole corpus; a segment whose anchor occurs once holds no repeat.
2. Shards. Segments of repeated anchors are dealt to shards by the anchor's hash, equal contents once with their
   count. A very frequent anchor (over hot_anchor occurrences) has its windows dealt one by one by their own hash
   instead, so no anchor makes a hot shard. Each shard holds a bounded number of words.
3. Search. A shard builds an FM-index of its segments (separators between them, a wavelet matrix of packed bits
   over the transform) and streams its segments against it: backward search gives the matching statistics up to
   window; places where they reach it with two occurrences are repeats. Each window of the corpus lies in one
   segment only, so occurrences in the shard are occurrences in the corpus.
4. Intervals go back to the documents, and the kept words are joined.

Defined results: null and empty texts have no words, kept_sha256 is that of the empty string; a text shorter than the
window loses nothing; repeated rows repeat each other's windows; a null doc_id is a document like others; other
columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .store import cut
from .tokens import Chunk, chunks, grams, text_array

WINDOW, ANCHOR, HOT_ANCHOR, SHARD_WORDS = 35, 8, 20_000, 1 << 19
_POS_BITS = np.uint64(28)
_KEY = ["_doc", "_text"]


def window_anchors(c: Chunk, h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, window starts that lie in one document, anchor place of each of these windows)."""
    g = grams(h, anchor)
    span = window - anchor + 1
    m = len(h) - window + 1
    if m <= 0:
        return g, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = g >> _POS_BITS << _POS_BITS | np.arange(len(g), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[:len(low) - (span - reach)], low[span - reach:])
    size = np.diff(c.word_bounds)
    end = np.repeat(c.word_bounds[1:], size)
    at = np.flatnonzero(end[:m] - np.arange(m) >= window)
    return g, at, (low[at] & np.uint64((1 << 28) - 1)).astype(np.int64)


def segments(c: Chunk, h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, one past the last window, document) of each run of windows with one anchor; places count within the chunk."""
    g, at, place = window_anchors(c, h, window, anchor)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[first[1:], len(at)] - 1
    lo = at[first]
    return g[place[first]], lo, at[last] + 1, np.searchsorted(c.word_bounds, lo, "right") - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two longs that tell rows apart unless they are the same."""
    return docs.select("doc_id", "text", F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """_doc, _text, lo, hi (window starts lo .. hi - 1 within the text), h: every segment of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = text_array(batch.column("text"))
            for c in chunks(text):
                h, lo, hi, doc = segments(c, c.hashes(), window, anchor)
                row = pa.array(doc + c.first)
                base = c.word_bounds[doc]
                yield pa.RecordBatch.from_arrays([batch.column("_doc").take(row), batch.column("_text").take(row), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), pa.array(h.view(np.int64))], [*_KEY, "lo", "hi", "h"])

    return docs.select(*_KEY, "text").mapInArrow(run, "_doc long, _text long, lo int, hi int, h long")


def contents(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """_doc, _text, lo, hi, route, digest_a, digest_b, words: the wanted segments with their words as bytes. A hot segment
    gives one row for each of its windows."""
    rows = docs.join(wanted, _KEY).select(*_KEY, "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = text_array(batch.column("text"))
            offsets = batch.column("runs").offsets.to_numpy()
            flat = batch.column("runs").flatten()
            lo_of, hi_of, h_of, hot_of = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            for c in chunks(text):
                words = c.hashes()
                w35 = grams(words, window)
                at, lo, hi, route = [], [], [], []
                for i in range(len(c)):
                    a, b = offsets[c.first + i], offsets[c.first + i + 1]
                    base = int(c.word_bounds[i])
                    for x, y, h, hot in zip(lo_of[a:b].tolist(), hi_of[a:b].tolist(), h_of[a:b].tolist(), hot_of[a:b].tolist()):
                        if hot:
                            lo += range(x, y)
                            hi += range(x + 1, y + 1)
                            at += [i] * (y - x)
                            route += w35[base + x:base + y].view(np.int64).tolist()
                        else:
                            lo.append(x)
                            hi.append(y)
                            at.append(i)
                            route.append(h)
                if not at:
                    continue
                row, x, y = np.array(at), np.array(lo), np.array(hi)
                base = c.word_bounds[row]
                start, end = base + x, base + y + window - 1
                # each segment's words as bytes, joined by one space
                raw = c.raw.tobytes()
                s, e = c.starts[start].tolist(), c.ends[end - 1].tolist()
                body = [b" ".join(raw[p:q].split()) for p, q in zip(s, e)]
                digests = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in body), np.int64).reshape(-1, 2)
                take = pa.array(row + c.first)
                yield pa.RecordBatch.from_arrays([batch.column("_doc").take(take), batch.column("_text").take(take), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(route, pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(body, pa.binary())], [*_KEY, "lo", "hi", "route", "digest_a", "digest_b", "words"])

    return rows.mapInArrow(run, "_doc long, _text long, lo int, hi int, route long, digest_a long, digest_b long, words binary")


def search_shard(bodies: list[bytes], copies: np.ndarray, window: int) -> list[tuple[int, np.ndarray]]:
    """(index of the segment, repeated window starts in it) of one shard's distinct segments."""
    text = b"\n".join(bodies)
    raw = np.frombuffer(text, np.uint8)
    bounds = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    bounds[-1] = max(bounds[-1] - 1, 0)
    c = Chunk(raw, bounds, 0)
    symbol = c.distinct()[1]  # compared byte by byte: words that differ are symbols that differ
    n = len(bodies)
    first = c.word_bounds + np.arange(n + 1)  # a separator after each segment
    s = np.zeros(len(symbol) + n, np.int64)
    inner = np.ones(len(s), bool)
    inner[first[1:] - 1] = False
    s[inner] = symbol + 1
    out: list[tuple[int, np.ndarray]] = []
    single = np.flatnonzero(copies < 2)
    for i in np.flatnonzero(copies >= 2).tolist():
        out.append((i, np.arange(int(c.word_bounds[i + 1] - c.word_bounds[i]) - window + 1)))
    if len(single):
        index = FMIndex(s, 64 if window <= 64 else 1 << (window - 1).bit_length())
        counts = (first[1:] - 1 - first[:-1])[single] - window + 1  # windows of each
        owner = np.repeat(single, counts)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        end = first[owner] + start + window - 1
        reached = np.zeros(len(owner), bool)
        for b in range(0, len(owner), 1 << 17):
            part = slice(b, b + (1 << 17))
            reached[part] = index.matching(s, end[part], first[owner[part]], window) >= window
        for i in np.unique(owner[reached]).tolist():
            a, b = np.searchsorted(owner, [i, i + 1])
            out.append((i, start[a:b][reached[a:b]]))
    return out


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of consecutive numbers."""
    cutting = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.r_[0, cutting + 1]].tolist(), (places[np.r_[cutting, len(places) - 1]] + 1).tolist()))


def repeats(distinct: DataFrame, shards: int, window: int) -> DataFrame:
    """route, digest_a, digest_b, a, b: each run of repeated windows of each distinct segment."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, a, b = [], [], []
        for i, w in search_shard(pdf["words"].tolist(), pdf["copies"].to_numpy(), window):
            for x, y in _runs(np.sort(w)):
                at.append(i)
                a.append(x)
                b.append(y)
        out = pdf[["route", "digest_a", "digest_b"]].iloc[at].copy()
        out["a"], out["b"] = np.array(a, np.int32), np.array(b, np.int32)
        return out

    dealt = distinct.withColumn("_shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(run, "route long, digest_a long, digest_b long, a int, b int")


def repeated_intervals(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_anchor: int = HOT_ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """_doc, _text, spans: runs of repeated windows of each text that has any. docs comes from _keyed."""
    placed = cut(anchors(docs, window, anchor), "anchors")
    # a table of its own, so that the join below is of two plain tables and a frequent anchor's rows can be split
    often = cut(placed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    wanted = placed.join(often, "h").withColumn("hot", F.col("n") > hot_anchor).groupBy(*_KEY).agg(F.sort_array(F.collect_set(F.struct("lo", "hi", "h", "hot"))).alias("runs"))
    held = cut(contents(docs, wanted, window), "segments")
    keys = ["route", "digest_a", "digest_b"]
    distinct = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"))
    words = held.agg(F.sum(F.col("hi") - F.col("lo") + window)).first()[0] or 0
    found = repeats(distinct, max(1, -(-words // shard_words)), window)
    back = held.select(*_KEY, "lo", *keys).join(found, keys).select(*_KEY, F.struct((F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b")).alias("span"))
    return back.groupBy(*_KEY).agg(F.sort_array(F.collect_set("span")).alias("spans"))


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the joined words, if asked for) of every row."""
    rows = _keyed(docs)
    key = docs.schema["doc_id"].dataType.simpleString()
    full = rows.join(repeated_intervals(rows, window, **options), _KEY, "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, sha, kept = [], [], [], []
            spans = batch.column(2).to_pylist()
            for c in chunks(text_array(batch.column(1))):
                raw = c.raw.tobytes()
                for i in range(len(c)):
                    a, b = int(c.bounds[i]), int(c.bounds[i + 1])
                    words = raw[a:b].split()
                    own = spans[c.first + i]
                    n_words.append(len(words))
                    if own:
                        keep, to = [], 0
                        for s in own:
                            keep += words[to:s["a"]] if s["a"] > to else []
                            to = max(to, s["b"] + window - 1)
                        keep += words[to:]
                    else:
                        keep = words
                    removed.append(len(words) - len(keep))
                    body = b" ".join(keep)
                    sha.append(hashlib.sha256(body).hexdigest())
                    if with_text:
                        kept.append(body.decode())
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return full.mapInArrow(run, f"doc_id {key}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
