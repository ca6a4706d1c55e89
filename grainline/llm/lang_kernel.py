"""Language identification by a blended-spectrum string kernel (operator 4).

A text's features are the byte n-grams of lengths 1 to 3 (A-Z lower-cased, ASCII non-letters as one blank), hashed
to 2^13 slots and present or not; K(x, z) = |x and z| / sqrt(|x| |z|). Landmarks z from a bounded training sample
give the Nystrom map K(x, Z) K(Z, Z)^(-1/2), on which one-versus-rest kernel ridge regression is fitted.
Texts are scored where they are read, a block of presence rows times the landmark matrix at a time; the model's
size is fixed by its parameters.

The sample is bounded: about sample_rows rows in all, or PER_LANG a language if that is more, spread evenly over the languages, by the hash of
doc_id and text, with the least one of each language, and never more than twice as many. Landmarks are taken in turn from each language: 128, or
four a language above 32 languages, 2,048 above 512 and one a language above 2,048, up to MOST_LANGS languages (an error above). Of equal scores the
language that is first in code-point order is predicted. Texts of any length are read whole. Defined results: a null text or one without a letter is 'und' with score 0; with no row to learn from
all are 'und'; repeated rows are predicted each; other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import remainder

SLOT_BITS, ORDERS = 13, (1, 2, 3)
SAMPLE_ROWS, LANDMARKS, RIDGE, BLOCK = 4096, 128, 1e-2, 64
#: Sampled rows of a language at least, and a bound of the languages: 4,096 landmarks are a model of 134 MB and minutes of fitting.
PER_LANG, MOST_LANGS = 16, 4096
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123, dtype=np.uint8)
_LETTERS[128:] = np.arange(128, 256, dtype=np.uint8)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def grams_present(text: str) -> np.ndarray:
    """Presence of the hashed n-grams, one uint8 a slot."""
    raw = _LETTERS[np.frombuffer(text.encode(), np.uint8)]
    blank = raw == 32
    raw = raw[~(blank & np.roll(blank, 1))] if len(raw) > 1 else raw
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    code = np.zeros(len(raw), np.uint32)
    wide = raw.astype(np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(raw) < n:
            break
        code = code[:len(raw) - n + 1] * np.uint32(257) + wide[n - 1:] + np.uint32(1)
        if n in ORDERS:
            out[(code * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)] = 1
    return out


@dataclass
class Kernel:
    langs: list[str]
    landmarks: np.ndarray  # slots x landmarks, each column divided by the root of its size
    weights: np.ndarray  # landmarks x languages

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """rows: texts x slots of presence."""
        k = (rows @ self.landmarks) / np.sqrt(np.maximum(1, rows.sum(1)))[:, None]
        return k @ self.weights


def landmarks_for(langs: int) -> int:
    return max(LANDMARKS, min(4 * langs, 2048), langs)


def fit(rows: np.ndarray, langs: list[str], landmarks: int | None = None, ridge: float = RIDGE) -> Kernel | None:
    """rows: texts x slots. Landmarks are taken in turn from each language."""
    names = sorted(set(langs))
    if not names:
        return None
    landmarks = landmarks or landmarks_for(len(names))
    label = np.array([names.index(x) for x in langs])
    x = rows.astype(np.float32)
    norm = x / np.sqrt(np.maximum(1, x.sum(1)))[:, None]
    turn = np.empty(len(label), np.int64)
    for k in range(len(names)):
        at = np.flatnonzero(label == k)
        turn[at] = np.arange(len(at))
    chosen = np.lexsort((label, turn))[:landmarks]
    z = norm[chosen]
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = (norm @ z.T) @ root
    share = np.bincount(label, minlength=len(names)) / len(label)
    weight = 1 / share[label]  # each language counts alike
    y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = (phi * weight[:, None]).T @ phi + ridge * weight.sum() * np.eye(phi.shape[1]) / phi.shape[1]
    return Kernel(names, np.ascontiguousarray(z.T, np.float32), (root @ np.linalg.solve(gram, (phi * weight[:, None]).T @ y)).astype(np.float32))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int | None = None, ridge: float = RIDGE) -> Kernel | None:
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").where(remainder(F.col("doc_id"), 3) != 1)
    order = F.xxhash64("doc_id", "text")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("least"))
    langs = max(1, counts.count())
    if langs > MOST_LANGS:
        raise ValueError(f"{langs} languages; the shares of at most {MOST_LANGS} are broadcast")
    sample_rows = max(sample_rows, PER_LANG * langs)
    share = counts.select("lang", "least", F.least(F.lit(1.0), F.lit(sample_rows / langs) / F.col("n")).alias("share"))
    dice = F.pmod(order, F.lit(1 << 30)) / (1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(grams_present(t)).tobytes() if has_letter(t) else None for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(bits, pa.binary())], ["lang", "place", "bits"])

    drawn = known.join(F.broadcast(share), "lang").where((dice < F.col("share")) | (order == F.col("least"))).select("text", "lang", order.alias("place"))
    # about sample_rows rows; more only where rows repeat, and then those of the least hash
    rows = drawn.mapInArrow(run, "lang string, place long, bits binary").where("bits IS NOT NULL").orderBy("place", "lang", "bits").limit(2 * sample_rows).toArrow()
    pairs = sorted(zip(rows["lang"].to_pylist(), rows["bits"].to_pylist()))
    if not pairs:
        return None
    x = np.unpackbits(np.frombuffer(b"".join(b for _, b in pairs), np.uint8).reshape(len(pairs), -1), axis=1)
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(pairs))
    return fit(x[order], [pairs[i][0] for i in order], landmarks, ridge)


def predict(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, **options))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if kernel is not None and has_letter(t)]
            for b in range(0, len(at), BLOCK):
                own = at[b:b + BLOCK]
                s = kernel.scores(np.stack([grams_present(texts[i]) for i in own]).astype(np.float32)).astype(float)
                e = np.exp(4 * (s - s.max(1, keepdims=True)))
                p = e / e.sum(1, keepdims=True)
                for i, k, x in zip(own, s.argmax(1).tolist(), p.max(1).tolist()):
                    lang[i], score[i] = kernel.langs[k], x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, lang_pred string, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
