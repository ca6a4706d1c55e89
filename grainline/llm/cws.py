"""Document fingerprints by consistent weighted sampling (operator 10).

A text's terms are its words (A-Z lower-cased), weighted by their counts and known by 64-bit hashes; each term's
r and c from Gamma(2, 1) and uniform b come from a counter-based generator keyed by its hash. For every sample k and term of weight w,
t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the sample is the (term, t) with the least a. Two texts agree in a
sample with probability equal to the generalised Jaccard similarity of their weighted terms, so the share of equal samples estimates it.

The next document comes from one shuffle of the texts by ranges of (doc_id, hash of the text), which begin at keys that occur; the rows
with the first key of each range are dealt to the range before too, and every task streams its range in order. Defined results: doc_id may be of any ordered
type; null text is empty; a text without words has the empty fingerprint, whose likeness is 1 to another empty one and 0 else; rows with the same doc_id follow each
other by a hash of the text and equal ones by turns, in ranges as well where they are many; rows without one come last, in 64 classes by that hash; a single row is its
own next document; texts are whole whatever their length; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .tokens import Chunk, mix

SAMPLES, CACHE_ROWS, SEED = 64, 1 << 16, 20260101
#: Classes by hash in which rows without a doc_id follow each other, and sampled keys a range.
NULL_RANGES, RANGE_SAMPLE = 64, 64
#: Terms drawn or compared at once.
SLICE = 1 << 9
_CACHES: dict[tuple[int, int], Cache] = {}
_EMPTY = np.full(1, -1, np.int64)


def _sample(lw, r, c, b):
    t = np.floor(lw / r + b)
    return c - r * (t - b + 1), t


class Cache:
    """The draws of terms that recur, a row each. Draws are a function of the term's whole hash, so what the cache
    holds changes no result; a term enters when it is the last one that missed its row and misses it again."""

    def __init__(self, samples: int, rows: int):
        self.key = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, (2, samples), np.uint64) * np.uint64(2) + np.uint64(1)
        self.term, self.missed = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
        self.r, self.c, self.b, self.once = (np.zeros((rows, samples), np.float32) for _ in range(4))

    def draws(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """r and ln c of Gamma(2, 1), uniform b, and the sample of weight 1 of each (term, sample), from 21-bit uniforms."""
        u = []
        for key, n in zip(self.key, (3, 2)):
            bits = mix(term[:, None] ^ key)
            u += [(((bits >> np.uint64(43 - 21 * i)) & np.uint64(0x1FFFFF)).astype(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2**-21) for i in range(n)]
        r, c = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3]))
        return r, c, u[4], c - r * (1 - u[4])

    def rows(self, term: np.ndarray) -> np.ndarray:
        """The row of each term, -1 where the cache does not hold it (a hash of 0 is never held)."""
        row = (term % np.uint64(len(self.term))).astype(np.int64)
        return np.where((self.term[row] == term) & (term != 0), row, -1)

    def offer(self, term: np.ndarray, drawn: tuple) -> None:
        row = (term % np.uint64(len(self.term))).astype(np.int64)
        row, first = np.unique(row, return_index=True)
        again = self.missed[row] == term[first]
        self.missed[row] = term[first]
        row, first = row[again], first[again]
        if len(row):
            for table, x in zip((self.r, self.c, self.b, self.once), drawn):
                table[row] = x[first]
            self.term[row] = term[first]


def cache(samples: int, rows: int) -> Cache:
    if (samples, rows) not in _CACHES:
        _CACHES[samples, rows] = Cache(samples, rows)
    return _CACHES[samples, rows]


def signature(term: np.ndarray, weight: np.ndarray, samples: int = SAMPLES, rows: int = CACHE_ROWS) -> np.ndarray:
    """samples values that name the sampled (term, t); term: distinct 64-bit hashes."""
    if not len(term):
        return _EMPTY
    held = cache(samples, rows)
    best = np.full(samples, np.inf, np.float32)
    best_term, best_t = np.zeros(samples, np.uint64), np.zeros(samples, np.int64)
    cols = np.arange(samples)

    def compare(names: np.ndarray, a: np.ndarray, t: np.ndarray | None) -> None:
        k = a.argmin(0)
        low, name = a[k, cols], names[k]
        won = (low < best) | ((low == best) & (name < best_term))  # ties by term, in whatever order the cache served them
        best[won], best_term[won] = low[won], name[won]
        best_t[won] = 0 if t is None else t[k, cols][won]

    row = held.rows(term)
    one = weight == 1
    for known, once in ((True, True), (True, False), (False, True), (False, False)):
        of = np.flatnonzero(((row >= 0) == known) & (one == once))
        for i in range(0, len(of), SLICE):
            part = of[i:i + SLICE]
            names, at = term[part], row[part]
            if known and once:
                compare(names, held.once[at], None)
                continue
            r, c, b, a = (held.r[at], held.c[at], held.b[at], held.once[at]) if known else held.draws(names)
            if once:
                compare(names, a, None)
            else:
                compare(names, *_sample(np.log(weight[part]).astype(np.float32)[:, None], r, c, b))
            if not known:
                held.offer(names, (r, c, b, a))
    return mix(best_term ^ mix(best_t.astype(np.uint64))).view(np.int64)


def fingerprint(data: bytes, samples: int = SAMPLES, rows: int = CACHE_ROWS) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    words = Chunk(raw, np.array([0, len(raw)]), 0).hashes(lower=True)
    term, weight = np.unique(words, return_counts=True)
    return digits(signature(term, weight, samples, rows))


def digits(sig: np.ndarray) -> np.ndarray:
    """The fingerprint: 16 bits a sample; empty for a text without words."""
    if sig is _EMPTY:
        return np.zeros(0, ">u2")
    return (mix(sig.view(np.uint64)) >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples of two fingerprints."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of the next document."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def _key(doc_id, h: int) -> tuple:
    """The place of a row in the order of all: by doc_id and the text's hash; rows without a doc_id last, in NULL_RANGES classes of the hash."""
    return (1, h % NULL_RANGES, h) if doc_id is None else (0, doc_id, h)


def bounds(keys: DataFrame, n: int) -> list[tuple]:
    """The first keys of at most n ranges of about equal size, the least of all keys first. keys: doc_id, _h of every row. They come from a
    sample by hash of about RANGE_SAMPLE distinct keys a range, a bounded list on the driver; it only decides where ranges begin."""
    total = keys.count()
    if not total:
        return []
    null_class = F.when(F.col("doc_id").isNull(), F.pmod("_h", F.lit(NULL_RANGES)))
    least = keys.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", null_class.alias("class"), "_h")).alias("k")).select("k.doc_id", "k._h")
    if RANGE_SAMPLE * n < total:
        keys = keys.where(F.shiftrightunsigned(F.xxhash64("doc_id", "_h"), 1) < F.lit(RANGE_SAMPLE * n * (1 << 63) // total))
    sample = sorted(_key(*r.values()) for r in keys.distinct().toArrow().to_pylist())
    first = _key(*least.toArrow().to_pylist()[0].values())
    return sorted({first, *(sample[i * len(sample) // n] for i in range(1, n) if sample)})


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES, cache_rows: int = CACHE_ROWS, partitions: int | None = None) -> DataFrame:
    """doc_id (of any ordered type), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    starts = spark.sparkContext.broadcast(bounds(cut(rows.select("doc_id", "_h"), "keys"), 4 * n))

    @F.arrow_udf("array<int>")
    def dealt(doc_id: pa.Array, h: pa.Array) -> pa.Array:
        """The range of each row and, where the row is the first of its range, the range before (the last one, for the first)."""
        first, out = starts.value, []
        for key in map(_key, doc_id.to_pylist(), h.to_pylist()):
            r = bisect_right(first, key) - 1
            out.append([r, (r or len(first)) - 1] if first[r] == key else [r])
        return pa.array(out, pa.list_(pa.int32()))

    streams = (
        rows.withColumn("_to", dealt("doc_id", "_h"))
        .select("doc_id", "text", "_h", F.posexplode("_to").alias("after", "part"))
        .select("doc_id", "text", "part", (F.col("after") == 1).alias("after"), "_h")
        .repartition(n, "part")
        .sortWithinPartitions("part", "after", F.asc_nulls_last("doc_id"), F.when(F.col("doc_id").isNull(), F.pmod("_h", F.lit(NULL_RANGES))), "_h", "text")
    )
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one
        for batch in batches:
            out: list[tuple] = []
            for doc, text, part, after in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own = held[3] if held and held[1] == text else fingerprint(text.encode(), samples, cache_rows)
                if held and held[2] == part:
                    new = edited(held[1], text).encode()
                    sig = fingerprint(new, samples, cache_rows)
                    out.append((held[0], len(held[1]), hashlib.sha256(new).hexdigest(), held[3].tobytes().hex(), sig.tobytes().hex(), likeness(held[3], sig), likeness(held[3], own)))
                held = None if after else (doc, text, part, own)
            if out:
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return streams.mapInArrow(run, f"doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
