"""Toxicity by a factorization machine over hashed terms (operator 6).

Terms are the words (A-Z lower-cased) and their leading 4 to 7 bytes, hashed to 2^22 slots and counted as
present or not. The machine's logit is w0 + sum w_i + sum_{i<j} <v_i, v_j>; it is fitted by AdaGrad on a bounded sample
of labelled rows (sample_rows, those of the least hash of doc_id and text). A slot is learned if at least min_docs of the sample's
texts hold it and its own share of toxic texts stands out (min_z), or if it is one of a pair whose texts are toxic more or less
often than the two shares together say (pair_z), whatever the two do alone: an insult and a group mention, each harmless. Pairs are
tested among the pair_terms slots that most of the sample's texts hold. Every whole text is scored where it is read; the model
(a slot table and at most the sample's terms) is a broadcast of bounded size.

Defined results: null and empty texts get the machine's bias; a doc_id with several labels counts as toxic if
one says so; null labels and null doc_ids are not learned; with no labelled rows every score is 0; repeated
rows are scored each and texts of any length whole; other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .tokens import Chunk, chunks, text_array

SLOT_BITS, PREFIXES, FACTORS = 22, (4, 5, 6, 7), 4
SAMPLE_ROWS, MIN_DOCS, MIN_Z, SEED = 16_384, 3, 4.0, 11
PAIR_TERMS, PAIR_Z, PAIR_DOCS = 2048, 6.0, 10


def text_slots(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all terms of the chunk, and the document (in the chunk) of each; not distinct."""
    size = c.ends - c.starts
    doc = np.repeat(np.arange(len(c)), np.diff(c.word_bounds))
    out, of = [c.hashes(lower=True)], [doc]
    for n in PREFIXES:
        long = size > n
        out.append(c.hashes(lower=True, starts=c.starts[long], ends=c.starts[long] + n))
        of.append(doc[long])
    return (np.concatenate(out) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.concatenate(of)


def presence(c: Chunk) -> list[np.ndarray]:
    slot, doc = text_slots(c)
    both = np.unique(doc << SLOT_BITS | slot)
    bounds = np.searchsorted(both, np.arange(len(c) + 1) << SLOT_BITS)
    slot = both & ((1 << SLOT_BITS) - 1)
    return [slot[bounds[i]:bounds[i + 1]] for i in range(len(c))]


@dataclass
class Machine:
    bias: float
    slots: np.ndarray  # sorted
    weight: np.ndarray
    factor: np.ndarray

    def table(self) -> np.ndarray:
        out = np.full(1 << SLOT_BITS, -1, np.int32)
        out[self.slots] = np.arange(len(self.slots), dtype=np.int32)
        return out

    def logit(self, ids: np.ndarray) -> float:
        """ids: distinct positions in slots."""
        v = self.factor[ids]
        s = v.sum(0)
        return float(self.bias + self.weight[ids].sum() + 0.5 * (s @ s - np.square(v).sum()))


def screened(count: np.ndarray, in_toxic: np.ndarray, p: float, min_docs: int, min_z: float) -> np.ndarray:
    """Which terms are kept: in min_docs texts at least, with a share of toxic texts that differs from the sample's
    share p by min_z standard errors."""
    z = (in_toxic - count * p) / np.sqrt(count * p * (1 - p))
    return (count >= min_docs) & (np.abs(z) >= min_z)


def in_pairs(present: np.ndarray, label: np.ndarray, pair_z: float, pair_docs: int = PAIR_DOCS) -> np.ndarray:
    """Which columns of present (texts x terms, 0 or 1) are in a pair that pair_docs texts hold and whose toxic texts differ by pair_z
    standard errors from what the odds of the two terms give together."""
    k = present.shape[1]
    both, toxic = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for b in range(0, len(present), 2048):
        x = present[b:b + 2048].astype(np.float32)
        both += x.T @ x
        toxic += x.T @ (x * label[b:b + 2048, None].astype(np.float32))
    n = np.maximum(np.diag(both), 1)
    p = share(label)
    own = np.clip((np.diag(toxic) + 0.5) / (n + 1), 1e-3, 1 - 1e-3)
    lift = np.log(own / (1 - own)) - np.log(p / (1 - p))
    found = np.zeros(k, bool)
    for i in range(k):
        q = 1 / (1 + np.exp(-(lift[i] + lift + np.log(p / (1 - p)))))
        z = (toxic[i] - both[i] * q) / np.sqrt(np.maximum(both[i] * q * (1 - q), 1e-9))
        hit = (both[i] >= pair_docs) & (np.abs(z) >= pair_z)
        hit[i] = False
        if hit.any():
            found[i] = True
            found |= hit
    return found


def most_held(slots: np.ndarray, count: np.ndarray, pair_terms: int) -> np.ndarray:
    """Places of the pair_terms slots of the largest counts, ties by slot."""
    return np.sort(np.lexsort((slots, -count))[:pair_terms])


def share(label: np.ndarray) -> float:
    return float(np.clip(label.mean(), 1e-3, 1 - 1e-3))


def fit(sets: list[np.ndarray], label: np.ndarray, slots: np.ndarray | None = None, factors: int = FACTORS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, pair_z: float = PAIR_Z, pair_terms: int = PAIR_TERMS, epochs: int = 12, rate: float = 0.1, l2: float = 2e-4, batch: int = 128) -> Machine:
    """AdaGrad on the logistic loss, in mini-batches. slots: the terms to learn, sorted; by default they are screened here."""
    if not len(sets):
        return Machine(-50.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    p = share(label)
    if slots is None:
        slots, at = np.unique(np.concatenate(sets), return_inverse=True)
        in_toxic = np.bincount(at, np.repeat(label, [len(s) for s in sets]), len(slots))
        count = np.bincount(at, minlength=len(slots))
        keep = screened(count, in_toxic, p, min_docs, min_z)
        top = most_held(slots, count, pair_terms)
        present = np.zeros((len(sets), len(top)), bool)
        for i, s in enumerate(sets):
            present[i, np.searchsorted(slots[top], s[np.isin(s, slots[top], assume_unique=True)])] = True
        keep[top[in_pairs(present, np.asarray(label, float), pair_z)]] = True
        slots = slots[keep]
    g = np.random.Generator(np.random.PCG64(SEED))
    n = len(slots)
    w, v = np.zeros(n), g.normal(0, 0.01, (n, factors))
    bias, gw, gv, gb = float(np.log(p / (1 - p))), np.full(n, 1e-2), np.full((n, factors), 1e-1), 1.0
    ids = [np.searchsorted(slots, s[np.isin(s, slots, assume_unique=True)]) for s in sets]
    for _ in range(epochs):
        order = g.permutation(len(ids))
        for b in range(0, len(order), batch):
            own = order[b:b + batch]
            size = np.array([len(ids[i]) for i in own])
            doc = np.repeat(np.arange(len(own)), size)
            col = np.concatenate([ids[i] for i in own])
            vv = v[col]
            s = np.stack([np.bincount(doc, vv[:, f], len(own)) for f in range(factors)], 1)
            q = np.bincount(doc, np.square(vv).sum(1), len(own))
            z = bias + np.bincount(doc, w[col], len(own)) + 0.5 * (np.square(s).sum(1) - q)
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[own])
            used, at = np.unique(col, return_inverse=True)
            dw = np.bincount(at, d[doc], len(used)) / len(own) + l2 * w[used]
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            dv = d[doc, None] * (s[doc] - vv)
            dv = np.stack([np.bincount(at, dv[:, f], len(used)) for f in range(factors)], 1) / len(own) + l2 * v[used]
            gv[used] += dv * dv
            v[used] -= 0.5 * rate * dv / np.sqrt(gv[used])
            db = d.mean()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
    return Machine(float(bias), slots, w, v)


def remainder(doc_id, n: int):
    """crc32 of doc_id as text (null: empty) modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, pair_z: float = PAIR_Z, pair_terms: int = PAIR_TERMS, **options) -> Machine:
    """Fit on at most sample_rows labelled rows that are not held out. Terms are counted and screened on the executors;
    the driver gets the screened terms and the presence of the pair_terms most frequent ones, of the sample only."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(remainder(F.col("doc_id"), 4) != 2)
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.astype(np.int32).tobytes() for c in chunks(text_array(batch.column(0))) for s in presence(c)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], ["toxic", "slots"])

    # rows of the sampled ids; more than twice as many only where rows repeat, and then those of the least hash
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("doc_id", "text").alias("place"))
    least = rows.select("place").orderBy("place").limit(2 * sample_rows).agg(F.max("place")).first()[0]
    rows = rows.where(F.col("place") <= F.lit(least)) if least is not None else rows
    held = cut(rows.mapInArrow(sets_of, "toxic int, slots binary"), "sample")
    total = held.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not total[0]:
        return fit([], np.zeros(0))
    p = share(np.array([total[1] / total[0]]))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(s.as_py(), np.int32) for s in batch.column(1)]
            slot, at = np.unique(np.concatenate([*sets, np.zeros(0, np.int32)]), return_inverse=True)
            toxic = np.bincount(at, np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets]), len(slot))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.bincount(at, minlength=len(slot))), pa.array(toxic.astype(np.int64))], ["slot", "n", "toxic"])

    z = (F.col("toxic") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    terms = held.mapInArrow(counts, "slot int, n long, toxic long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    terms = cut(terms, "terms")
    slots = terms.where((F.col("n") >= min_docs) & (F.abs(z) >= min_z)).select("slot").toArrow()["slot"].to_numpy().astype(np.int64)
    top = np.sort(terms.orderBy(F.desc("n"), "slot").limit(pair_terms).select("slot").toArrow()["slot"].to_numpy().astype(np.int64))
    frequent = docs.sparkSession.sparkContext.broadcast(top)

    def presence_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.isin(frequent.value, np.frombuffer(s.as_py(), np.int32))).tobytes() for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["toxic", "bits"])

    held_bits = held.mapInArrow(presence_of, "toxic int, bits binary").toArrow()
    present = np.unpackbits(np.frombuffer(b"".join(held_bits["bits"].to_pylist()), np.uint8).reshape(len(held_bits), -1), axis=1)[:, :len(top)]
    slots = np.union1d(slots, top[in_pairs(present, held_bits["toxic"].to_numpy().astype(float), pair_z)])
    kept = docs.sparkSession.sparkContext.broadcast(slots)

    def known_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(s.as_py(), np.int32) for s in batch.column(1)]
            own = [s[np.isin(s, kept.value, assume_unique=True)].tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["toxic", "slots"])

    rows = held.mapInArrow(known_terms, "toxic int, slots binary").toArrow()
    pairs = sorted(zip(rows["slots"].to_pylist(), rows["toxic"].to_pylist()))  # an order of their own, whatever the partitions
    return fit([np.frombuffer(s, np.int32).astype(np.int64) for s, _ in pairs], np.array([float(y) for _, y in pairs]), slots, **options)


def logits(machine: Machine, table: np.ndarray, text: pa.Array) -> np.ndarray:
    out = []
    for c in chunks(text):
        slot, doc = text_slots(c)
        at = table[slot]
        known = at >= 0
        both = np.unique(doc[known] << 32 | at[known])
        bounds = np.searchsorted(both, np.arange(len(c) + 1) << 32)
        ids = both & 0xFFFFFFFF
        out += [machine.logit(ids[bounds[i]:bounds[i + 1]]) for i in range(len(c))]
    return np.array(out, float)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every row."""
    model = docs.sparkSession.sparkContext.broadcast((machine, machine.table()))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probability(logits(*model.value, text_array(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, score double")


def reject(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast((machine, machine.table()))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probability(logits(*model.value, text_array(batch.column(at))))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, learn(docs, labels, **options))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
