"""Divergence of sources from their language by terms that an iceberg refinement of byte prefixes keeps (operator 13).

Terms are runs of letters A-Z (lower-cased) and characters above U+007F. Level by level, with 4, 8, 16, .. bytes, the prefixes
of terms are extended; a prefix that fewer than min_docs documents of its language hold is discarded, and no term below it is looked at
again. A prefix that ends its term is complete and is not extended. Each level is one pass over the texts: a task counts the documents of each prefix among its own
documents, and sums of those counts are exact, as no document is in two tasks. Prefixes are 64-bit hashes with their language and level;
those that stay are marked in a map of 2^26 bits, whose size does not depend on the data. Hashes and bits that are shared can only keep a
prefix too many, never discard one; the terms that are left at the end are grouped by their bytes and their documents are counted once more,
so that the kept terms are exact whatever the map let through. Only they and their counts by source are shuffled.

Divergences are integers: p = 1 + floor(SCALE (count + 1) / (N + V)) and f = floor((p - q)^2 / q). Sums over all pairs of sources are
taken term by term as matrices of a block of terms and a column of q at a time; pairs of rows are never made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut
from .tokens import U64, Chunk, mix, text_array

#: Bytes outside terms become spaces, A-Z are lower-cased.
TERM_BYTES = np.full(256, 32, np.uint8)
TERM_BYTES[97:123] = TERM_BYTES[65:91] = np.arange(97, 123)
TERM_BYTES[128:] = np.arange(128, 256)
#: The first level's length in bytes; each level doubles it.
FIRST = 4
BITS, BITMAP = 26, 32768
SCALE, TOP = 10**9, 200
#: Rows that a task holds before it adds them up or passes them on; terms of a block.
HELD, BLOCK_TERMS = 1 << 20, 2048


def term_chunks(text: pa.Array, size: int = 1 << 20) -> Iterator[Chunk]:
    """The texts in pieces of whole documents of about size bytes, whose words are their terms."""
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset:] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2] if len(text) else None
    raw, i = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), 0
    while i < len(text):
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1), len(text))
        yield Chunk(TERM_BYTES[raw[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i], i)
        i = j


def lang_hashes(langs: pa.Array) -> np.ndarray:
    own = langs.dictionary_encode()
    each = np.array([int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little") for s in own.dictionary.to_pylist()], U64)
    return each[own.indices.to_numpy()] if len(langs) else np.zeros(0, U64)


def level_of(size: np.ndarray, first: int) -> np.ndarray:
    """The level at which a term of so many bytes is complete."""
    return np.ceil(np.log2(np.maximum(size, first) / first)).astype(np.int64)


def prefix_keys(c: Chunk, at: np.ndarray, lang: np.ndarray, level: int | np.ndarray, first: int) -> np.ndarray:
    """Hashes of (language, level, prefix, whether it is complete) of the chunk's terms at the places `at`."""
    size = c.ends[at] - c.starts[at]
    length = np.int64(first) << np.asarray(level, np.int64)
    h = c.hashes(starts=c.starts[at], ends=c.starts[at] + np.minimum(size, length))
    tag = (np.asarray(level).astype(U64) << U64(1)) + (size <= length).astype(U64)
    return mix(mix(h ^ lang) + tag)


def alive(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = (keys >> U64(64 - BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


class Tally:
    """Sums by a 64-bit key, added up when there are many."""

    def __init__(self, width: int):
        self.keys, self.sums, self.rows, self.width = [], [], 0, width

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.rows += len(keys)

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros(0, U64), np.zeros((0, self.width), np.int64)
        keys, sums = np.concatenate(self.keys), np.concatenate(self.sums)
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.sums = [keys[start]], [np.add.reduceat(sums, start, axis=0)]
        self.rows = len(start)
        return self.keys[0], self.sums[0]

    def clear(self) -> None:
        self.keys, self.sums, self.rows = [], [], 0


def prefix_counts(docs: DataFrame, level: int, bits, first: int) -> DataFrame:
    """key, docs, more of the level's prefixes, a row a task and prefix: of terms whose prefix of the level before stayed. more: the prefix can be extended."""

    def out(tally: Tally) -> pa.RecordBatch:
        keys, sums = tally.reduce()
        tally.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1] > 0)], ["key", "docs", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, most = Tally(2), HELD
        for batch in batches:
            langs = lang_hashes(batch.column(0))
            for c in term_chunks(text_array(batch.column(1))):
                doc = np.repeat(np.arange(len(c)), np.diff(c.word_bounds))
                at = np.arange(len(doc))
                if level:
                    at = np.flatnonzero(c.ends - c.starts > first << level - 1)
                    at = at[alive(prefix_keys(c, at, langs[c.first + doc[at]], level - 1, first), bits.value)]
                if not len(at):
                    continue
                doc = doc[at]
                keys = prefix_keys(c, at, langs[c.first + doc], level, first)
                more = c.ends[at] - c.starts[at] > first << level
                order = np.argsort(keys, kind="stable")  # documents stay in order
                keys, doc, more = keys[order], doc[order], more[order]
                new = np.concatenate([[True], keys[1:] != keys[:-1]])
                start = np.flatnonzero(new)
                held = np.add.reduceat(new | np.concatenate([[True], doc[1:] != doc[:-1]]), start, dtype=np.int64)
                tally.add(keys[start], np.stack([held, more[start]], 1).astype(np.int64))
                if tally.rows > most:
                    tally.reduce()
                    most = max(HELD, 2 * tally.rows)
                    if tally.rows > 4 * HELD:
                        yield out(tally)
                        most = HELD
        yield out(tally)

    return docs.select("lang", "text").mapInArrow(run, "key long, docs long, more boolean")


def refine(docs: DataFrame, min_docs: int = 3, first: int = FIRST):
    """The broadcast map of the prefixes that stay at any level, and the number of levels."""
    spark, level, bits = docs.sparkSession, 0, None
    whole = np.zeros((1 << BITS) // 8, np.uint8)
    while True:
        left = prefix_counts(docs, level, bits, first).groupBy("key").agg(F.sum("docs").alias("docs"), F.max("more").alias("more")).where(F.col("docs") >= min_docs)
        slot = F.shiftrightunsigned("key", 64 - BITS) + 1
        rows = left.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"), F.max("more").alias("more")).collect()
        for r in rows:
            at = (r["bucket"] - 1) * (BITMAP // 8)
            whole[at:at + BITMAP // 8] |= np.frombuffer(r["bits"], np.uint8)[:len(whole) - at]
        if bits is not None:
            bits.unpersist()
        bits, level = spark.sparkContext.broadcast(whole), level + 1
        if not any(r["more"] for r in rows):
            return bits, level


def term_counts(docs: DataFrame, bits, first: int) -> DataFrame:
    """lang, source, term, n, docs of the terms that the map lets through, a row a task, source and term."""

    def out(tally: Tally, groups: dict, terms: dict) -> pa.RecordBatch:
        keys, sums = tally.reduce()
        group, term = pa.array((keys >> U64(32)).astype(np.int64)), pa.array((keys & U64(0xFFFFFFFF)).astype(np.int64))
        names = [pa.array([g[i] for g in groups], pa.string()) for i in (0, 1)]
        columns = [names[0].take(group), names[1].take(group), pa.array([t.decode() for t in terms], pa.string()).take(term), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
        tally.clear(), groups.clear(), terms.clear()
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, groups, terms, most = Tally(2), {}, {}, HELD
        for batch in batches:
            langs, pairs = lang_hashes(batch.column(0)), list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for c in term_chunks(text_array(batch.column(2))):
                doc = np.repeat(np.arange(len(c)), np.diff(c.word_bounds))
                at = np.arange(len(doc))
                at = at[alive(prefix_keys(c, at, langs[c.first + doc], level_of(c.ends - c.starts, first), first), bits.value)]
                if not len(at):
                    continue
                doc = doc[at]
                one, kind = c.distinct()
                used, kind = np.unique(kind[at], return_inverse=True)
                text = lambda i: c.raw[c.starts[i]:c.ends[i]].tobytes()
                ids = np.array([terms.setdefault(text(i), len(terms)) for i in one[used].tolist()], np.int64)
                group = np.array([groups.setdefault(p, len(groups)) for p in pairs[c.first:c.first + len(c)]], np.int64)
                # sorted by document, so that repeats within one are neighbours
                both = doc * len(used) + kind
                both, times = np.unique(both, return_counts=True)
                d, k = both // len(used), both % len(used)
                tally.add((group[d] << 32 | ids[k]).astype(U64), np.stack([times, np.ones(len(times), np.int64)], 1))
                if tally.rows > most:
                    tally.reduce()
                    most = max(HELD, 2 * tally.rows)
                if tally.rows > 2 * HELD or len(terms) > HELD:
                    yield out(tally, groups, terms)
                    most = HELD
        yield out(tally, groups, terms)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = 3, first: int = FIRST) -> DataFrame:
    """lang, term, n, docs, by (its sources and their counts) of every term that min_docs documents of the language hold."""
    bits, _ = refine(docs, min_docs, first)
    by = term_counts(docs, bits, first).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by")).where(F.col("docs") >= min_docs)


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    if len(n) and int(n.max()) >= 9 * 10**9:
        n, total = n.astype(object), total.astype(object)
    return (1 + SCALE * (n + 1) // total).astype(np.int64)


def pair_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, item, value: sums of f over a block of terms, or several, for each pair of the language's sources."""
    sums, cells = {}, 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, o), (names, value) in sums.items():
            others = [i for i in range(len(names)) if i != o]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(others), pa.string()), pa.array([names[i] for i in others], pa.string()), pa.array([names[o]] * len(others), pa.string()), pa.array(value[others])], ["lang", "source", "item", "value"])

    for batch in batches:
        for lang, kept, own, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            source, size = own.values.flatten()
            names, total = source.to_pylist(), size.to_numpy(zero_copy_only=False) + kept
            step = max(1, (1 << 20) // len(names))
            for b in range(0, len(terms.values), step):
                part = terms.values.slice(b, step)
                of, count = part.flatten().flatten()
                n = np.zeros((len(part), len(names)), np.int64)
                n[np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False)), pc.index_in(of, value_set=source).to_numpy(zero_copy_only=False)] = count.to_numpy(zero_copy_only=False)
                p = _share(n, total[None, :])
                for o in range(len(names)):
                    q = p[:, o:o + 1]
                    value = ((p - q) ** 2 // q).sum(0)
                    if (lang, o) in sums:
                        sums[lang, o][1][:] += value
                    else:
                        sums[lang, o] = (names, value)
                        cells += len(names)
                    if cells > 1 << 21:
                        yield from out()
                        sums, cells = {}, 0
    yield from out()


def exact_share(n: str, total: str):
    """p as a column, in decimals where counts need it."""
    exact = f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0))) div CAST({total} AS DECIMAL(20,0))"
    return F.expr(f"1L + CASE WHEN {n} < 9000000000 THEN ({SCALE}L * ({n} + 1)) div {total} ELSE {exact} END")


def audit(docs: DataFrame, min_docs: int = 3, top: int = TOP, first: int = FIRST) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each source from each other one of its language ('pair'), and the
    terms by which it stands out from its language ('term', the first `top`).

    Null texts, languages and sources are ''. Each row is a document, repeated rows too. A group without a term has pairs; a language that
    keeps no term has pairs of value 0; a language of one source has no pairs. Ties are in order of the item's bytes. Terms of any length
    are told apart by all their bytes. Empty input gives no rows; other columns are ignored."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    kept = cut(kept_terms(docs, min_docs, first), "terms")
    by = kept.select("lang", "term", F.col("n").alias("all"), F.explode("by").alias("s")).select("lang", "term", "all", F.col("s.source").alias("source"), F.col("s.n").alias("n"))
    totals = by.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    per = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    groups = cut(groups.join(per, "lang", "left").fillna(0, ["kept", "lang_total"]), "groups")

    blocks = max(1, -(-kept.count() // BLOCK_TERMS))
    terms = kept.groupBy("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block")).agg(F.collect_list("by").alias("terms"))
    own = groups.groupBy("lang", "kept").agg(F.array_sort(F.collect_list(F.struct("source", F.col("total").alias("n")))).alias("sources"))
    found = terms.join(own, "lang").select("lang", "kept", "sources", "terms").mapInArrow(pair_values, "lang string, source string, item string, value long")
    found = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(found, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    shares = by.join(groups, ["lang", "source"]).withColumn("p", exact_share("n", "(total + kept)")).withColumn("q", exact_share("all", "(lang_total + kept)"))
    stand = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(stand).where(F.col("rank") <= top))
