"""Language-model scoring by a probabilistic suffix tree over words (operator 2).

Tokens are words (A-Z lower-cased) and one end per text. The root is the add-half unigram distribution. A context
of up to depth words is a candidate if it occurs often enough among the N training tokens; it is retained if
its next-symbol distribution diverges from its longest suffix's by at least min_divergence (Kullback-Leibler, over
the symbols with a count of their own). A retained context s gives
P(x | s) = max(n(s x) - d, 0) / n(s) + b(s) P(x | longest retained suffix of s), with b(s) the mass that the discounts leave,
so all distributions sum to one; a token is scored in the longest retained suffix of the words before it.

What is gathered grows with the input: every word's count (a table of its own, by a shuffle), and a tree whose contexts and next
symbols need min(share * N, N^(2/3) / rate) occurrences, so that it has room for some rate * N^(1/3) of either: 5.8 times as many
at 200 times the text. The tree is a broadcast, so it can't grow in proportion to the corpus; its size is checked against that
bound when it is read. Texts are cut into words once: hot words (with min(hot_share * N, N^(2/3) / next_rate) occurrences, hence all that
the tree could have as next symbols or in contexts) become numbers in a table that every level and the scoring read; the rest, which no context predicts on its own, are joined by a
shuffle to the whole table of counts, so every token is scored on its exact count.

Words are known by 64-bit hashes. Defined results: null and empty texts are one end token; a null doc_id counts as
the text ''; repeated rows are learned and scored each; with nothing to learn from N = V = 0 and every token has
probability 0.5 / 0.5; other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .tokens import Chunk, chunks, text_array
from .toxicity import remainder

END = np.uint64(0x51ED270B8D2A7E31)
#: Rows of partial counts that a task gathers before it hands them on.
FLUSH = 1 << 20


def lookup(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Position of each x in the sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token of the chunk with ends put in, and the bounds of the documents."""
    h = c.hashes(lower=True)
    n = len(c)
    bounds = c.word_bounds + np.arange(n + 1)
    out = np.full(len(h) + n, END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[bounds[1:] - 1] = False
    out[inner] = h
    return out, bounds


@dataclass
class Level:
    """Contexts of one length. A candidate's key is the place of the rest of it (all but its first word) among the candidates of the
    level below, and its first word's id, packed; keys are sorted. place: among the retained ones, -1 for the others. A retained
    context has its occurrences, its back-off mass, and counted next symbols: keys of its place and the symbol's id."""

    keys: np.ndarray
    place: np.ndarray
    total: np.ndarray
    back: np.ndarray
    next_keys: np.ndarray
    next_n: np.ndarray


@dataclass
class Tree:
    n: int = 0
    v: int = 0
    discount: float = 0.5
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of the hot words
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    levels: list[Level] = field(default_factory=list)

    def root(self, c):
        return (c + 0.5) / (self.n + 0.5 * (self.v + 1))


#: Ids are packed in 26 bits; hot words and the contexts of a level are fewer than 2^26 and 2^37: enough for 5 * 10^13 tokens at the default rates.
BITS = 26
MASK = (1 << BITS) - 1


def places(levels: list[np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each level's sorted keys the place of the words before each token, -1 where they are no candidate or reach beyond the text."""
    start = np.repeat(bounds[:-1], np.diff(bounds))
    at = np.arange(len(ids))
    out, place = [], np.zeros(len(ids), np.int64)
    for k, keys in enumerate(levels, 1):
        before = np.full(len(ids), -1, np.int64)
        before[k:] = ids[:-k] if k < len(ids) else ids[:0]
        ok = np.flatnonzero((at - k >= start) & (before >= 0) & (place >= 0))
        new = np.full(len(ids), -1, np.int64)
        new[ok] = lookup(keys, place[ok] << BITS | before[ok])
        out.append(new)
        place = new
    return out


def _merged(held: list[np.ndarray], held_n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(held), np.concatenate(held_n)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(n, first)


def _counts(rows: DataFrame, keys_of) -> DataFrame:
    """a, n: how often each key that the arrays of keys_of(batch) hold occurs. Partial counts leave the task by FLUSH rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda k, n: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(k.view(np.int64))), pa.array(n)], ["a", "n"])
        held: list[np.ndarray] = []
        held_n: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for found in keys_of(batch):
                k, n = np.unique(found, return_counts=True)
                if not len(k):
                    continue
                held.append(k)
                held_n.append(n)
                size += len(k)
                if size > FLUSH:
                    k, n = _merged(held, held_n)
                    held, held_n, size = [k], [n], len(k)
                    if size > FLUSH // 2:
                        yield batch_of(k, n)
                        held, held_n, size = [], [], 0
        if size:
            yield batch_of(*_merged(held, held_n))

    return rows.mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def _bounded(df: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """a and n of a table that has at most `most` rows by its own condition."""
    got = df.limit(most + 1).toArrow()
    if got.num_rows > most:
        raise ValueError("more rows than the counts allow")
    return got["a"].to_numpy(), got["n"].to_numpy()


def enough(n: int, share: float, rate: float, min_count: int) -> int:
    """How often what the tree holds must occur among n tokens."""
    return max(min_count, int(np.ceil(min(share * n, n ** (2 / 3) / rate))))


def vocabulary(docs: DataFrame, hot_share: float, next_rate: float, min_count: int, discount: float) -> tuple[Tree, DataFrame]:
    """The root of the tree with the hot words, and the table (a, n) of all words' counts."""
    words = lambda batch: (tokens(c)[0] for c in chunks(text_array(batch.column(0)), 1 << 20))
    unigrams = cut(_counts(docs.select("text"), words), "unigrams")
    total = unigrams.agg(F.sum("n"), F.count(F.lit(1))).first()
    tree = Tree(total[0] or 0, total[1], discount)
    if tree.n:
        least = enough(tree.n, hot_share, next_rate, min_count)
        a, n = _bounded(unigrams.where(F.col("n") >= least), tree.n // least)
        if len(a) >= MASK:
            raise ValueError("too many hot words for packed ids")
        order = np.argsort(a.view(np.uint64))
        tree.words, tree.count = a.view(np.uint64)[order], n[order]
    return tree, unigrams


def tokenised(docs: DataFrame, tree: Tree) -> DataFrame:
    """The texts as numbers, written once: _row, doc_id, learn, tokens, ids (int32 each; -1: a rare word), and the rare words' hashes
    and counts. docs: doc_id, text, learn."""
    words = docs.sparkSession.sparkContext.broadcast(tree.words)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ids, rare, count = [], [], [], []
            for c in chunks(text_array(batch.column(2)), 1 << 20):
                h, bounds = tokens(c)
                own = lookup(words.value, h).astype(np.int32)
                for i in range(len(c)):
                    part = slice(bounds[i], bounds[i + 1])
                    size.append(int(bounds[i + 1] - bounds[i]))
                    ids.append(own[part].tobytes())
                    r, n = np.unique(h[part][own[part] < 0], return_counts=True)
                    rare.append(r.view(np.int64))
                    count.append(n)
            at = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (rare, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), *lists], ["_row", "doc_id", "learn", "tokens", "ids", "rare", "count"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text", "learn")
    return cut(rows.mapInArrow(run, f"_row long, doc_id {key}, learn boolean, tokens long, ids binary, rare array<long>, count array<long>"), "tokens")


def _id_arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, bounds of texts) of the column, some texts at a time."""
    held, size = [], 0
    for x in column:
        held.append(np.frombuffer(x.as_buffer(), np.int32))
        size += len(held[-1])
        if size > 1 << 18:
            yield np.concatenate(held).astype(np.int64), np.cumsum([0, *map(len, held)])
            held, size = [], 0
    if held:
        yield np.concatenate(held).astype(np.int64), np.cumsum([0, *map(len, held)])


def grow(tree: Tree, table: DataFrame, depth: int, context_share: float, next_share: float, context_rate: float, next_rate: float, min_count: int, min_divergence: float) -> None:
    """Add the tree's levels, counted on the tokenised table."""
    spark = table.sparkSession
    least, least_next = enough(tree.n, context_share, context_rate, min_count), enough(tree.n, next_share, next_rate, min_count)
    least = max(least, least_next)
    end_id = int(lookup(tree.words, np.array([END]))[0])
    often = tree.count >= least_next
    keys = np.flatnonzero((tree.count >= least) & (np.arange(len(tree.count)) != end_id)).astype(np.int64)
    occurs, longer = tree.count[keys], (keys, np.arange(len(keys)))  # longer: (place below << BITS | symbol) -> place here
    candidates: list[np.ndarray] = []
    for _ in range(depth):
        if not len(keys):
            break
        candidates.append(keys)
        shared = spark.sparkContext.broadcast((candidates, often))

        def pairs(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            levels, frequent = shared.value
            for ids, bounds in _id_arrays(batch.column(0)):
                at = places(levels, ids, bounds)[-1]
                use = np.flatnonzero((at >= 0) & (ids >= 0))
                use = use[frequent[ids[use]]]
                yield at[use] << BITS | ids[use]

        a, n = _bounded(_counts(table.select("ids"), pairs).where(F.col("n") >= least_next), tree.n // least_next + 1)
        order = np.argsort(a)
        key, n = a[order], n[order]
        ctx, sym = key >> BITS, key & MASK
        rest = [ctx]  # the context's suffixes, from the longest on
        for level in candidates[::-1]:
            rest.append(level[rest[-1]] >> BITS)
        lower = probability(tree, rest[1:-1][::-1], sym)
        own = np.bincount(ctx, np.maximum(n - tree.discount, 0) / occurs[ctx], len(keys))
        whole = n / occurs[ctx]
        gain = np.bincount(ctx, whole * np.log(whole / lower), len(keys))
        left = np.clip(1 - np.bincount(ctx, whole, len(keys)), 0, 1)
        left_lower = np.clip(1 - np.bincount(ctx, lower, len(keys)), 1e-12, 1)
        kept = gain + np.where(left > 0, left * np.log(np.maximum(left, 1e-12) / left_lower), 0) >= min_divergence
        place = np.where(kept, np.cumsum(kept) - 1, -1)
        use = kept[ctx]
        tree.levels.append(Level(keys, place, occurs[kept], 1 - own[kept], place[ctx[use]] << BITS | sym[use], n[use]))
        # the next level's candidates: contexts with one word more at the end; their suffix ends in it too
        more = np.flatnonzero((n >= least) & (sym != end_id))
        suffix = longer[1][lookup(longer[0], (keys[ctx[more]] >> BITS) << BITS | sym[more])]
        new = suffix << BITS | keys[ctx[more]] & MASK
        order = np.argsort(new)
        placed = np.empty(len(new), np.int64)
        placed[order] = np.arange(len(new))
        longer = (key[more], placed)
        keys, occurs = new[order], n[more][order]


def probability(tree: Tree, at: list[np.ndarray], symbol: np.ndarray) -> np.ndarray:
    """P(symbol | context), where at has the place of the context's suffix in each level from the first on (-1: none)."""
    p = tree.root(tree.count[symbol])
    for level, place in zip(tree.levels, at):
        p = _step(level, np.where(place >= 0, level.place[place], -1) if len(level.place) else place, symbol, p, tree.discount)
    return p


def _step(level: Level, at: np.ndarray, symbol: np.ndarray, p: np.ndarray, discount: float) -> np.ndarray:
    use = np.flatnonzero(at >= 0)
    a = at[use]
    seen = lookup(level.next_keys, a << BITS | symbol[use])
    n = np.where(seen >= 0, level.next_n[np.maximum(seen, 0)] if len(level.next_n) else 0, 0)
    out = p.copy()
    out[use] = np.maximum(n - discount, 0) / level.total[a] + level.back[a] * p[use]
    return out


def score_ids(tree: Tree, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text (hot tokens, base, score) without the rare words' own root probabilities."""
    hot = ids >= 0
    p = np.ones(len(ids))
    p[hot] = tree.root(tree.count[ids[hot]])
    base = np.log10(p)
    symbol = np.where(hot, ids, MASK)  # a rare word: no context has it
    for level, place in zip(tree.levels, places([x.keys for x in tree.levels], ids, bounds)):
        p = _step(level, np.where(place >= 0, level.place[place], -1), symbol, p, tree.discount)
    return np.add.reduceat(np.stack([hot, base, np.log10(p)], 1), bounds[:-1], 0)


def score(table: DataFrame, tree: Tree, unigrams: DataFrame) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score of every row of the tokenised table."""
    shared = table.sparkSession.sparkContext.broadcast(tree)
    key = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [score_ids(shared.value, ids, bounds) for ids, bounds in _id_arrays(batch.column(4))]
            s = np.concatenate(stats) if stats else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(s[:, 0].astype(np.int64)), pa.array(s[:, 1]), pa.array(s[:, 2])], ["_row", "doc_id", "learn", "tokens", "hot", "base", "score"])

    scored = table.select("_row", "doc_id", "learn", "tokens", "ids").mapInArrow(run, f"_row long, doc_id {key}, learn boolean, tokens long, hot long, base double, score double")
    words = table.select("_row", F.explode(F.arrays_zip("rare", "count")).alias("w")).select("_row", F.col("w.rare").alias("a"), F.col("w.count").alias("m"))
    p = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(tree.n + 0.5 * (tree.v + 1)))
    rare = words.join(unigrams, "a", "left").groupBy("_row").agg(F.sum(F.col("m") * p).alias("rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("m"))).alias("known"))
    out = scored.join(rare, "_row", "left")
    extra = F.coalesce("rare", F.lit(0.0))
    return out.select("doc_id", "learn", F.col("tokens").alias("n_tokens"), (F.col("hot") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(tree.n).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))


def learn(docs: DataFrame, depth: int = 4, hot_share: float = 5e-7, context_share: float = 2e-5, next_share: float = 2e-6, context_rate: float = 180.0, next_rate: float = 1800.0, min_count: int = 2, min_divergence: float = 0.02, discount: float = 0.5) -> tuple[Tree, DataFrame, DataFrame]:
    """The tree, the table of all words' counts, both of the rows of docs (doc_id, text, learn) with learn, and docs tokenised.
    depth: the longest context."""
    tree, unigrams = vocabulary(docs.where("learn"), hot_share, next_rate, min_count, discount)
    table = tokenised(docs, tree)
    if tree.n:
        grow(tree, table.where("learn"), depth, context_share, next_share, context_rate, next_rate, min_count, min_divergence)
    return tree, unigrams, table


def score_held_out(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows whose crc32(doc_id as text) mod 5 is not 1, and score all rows."""
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 5) != 1).alias("learn"))
    tree, unigrams, table = learn(rows, **options)
    return score(table, tree, unigrams).select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
