"""Exact deduplication by composable polynomial fingerprints (operator 7).

A text is normalised (A-Z lower-cased), cut into chunks of chunk_bytes, and every chunk is hashed on its own:
H(c) = sum (c[i] + 1) * B^(n-1-i) modulo a prime, for two primes below 2^31. Chunk hashes combine by
length-shifted arithmetic, H(a + b) = H(a) * B^len(b) + H(b): texts above huge_bytes are dealt out chunk by chunk
and hashed by many tasks, the others are hashed where they are read. Fingerprints that occur more than once mark bits of a
map of fixed size; rows that meet a marked bit are suspects. Suspects of one fingerprint and length are compared chunk by
chunk: first within the batch they are read in, so that a batch sends one text of each kind however many copies it holds, then
within salted parts of the group, then across the parts. Huge texts are compared by their chunks, each by a task of its own.
A row that differs from all (a collision) opens a class of its own, so that classes hold equal texts only.

No text of an unmarked fingerprint is shuffled, and no task gathers a group: copies within a batch are rows without text, and the
group's rows meet its size by a join that adaptive execution can split. Defined results: null text is empty; repeated rows
(same doc_id, same text) all count, and just one of them is kept; a null doc_id ranks below every other; other
columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .tokens import LOWER, mix

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 69_069_069)
_BLOCK = 1 << 12
_TABLE = bytes(LOWER)
#: Bits of the map of repeated fingerprints: 2 MB, whatever the corpus.
MAP_BITS = 1 << 24
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _powers(base: int, prime: int) -> np.ndarray:
    out = [1]
    for _ in range(_BLOCK - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], np.uint64)


_POWERS = [_powers(b, p) for b, p in zip(BASES, PRIMES)]


def combine(a: int, b: int, b_len: int, k: int) -> int:
    """Hash of a + b from the hashes of both and the length of b."""
    return (a * pow(BASES[k], b_len, PRIMES[k]) + b) % PRIMES[k]


def chunk_hash(data: bytes, k: int) -> int:
    """H of the bytes, by blocks of a vectorised dot product."""
    raw = np.frombuffer(data, np.uint8)
    head = len(raw) % _BLOCK
    h = int(np.dot(raw[:head] + np.uint64(1), _POWERS[k][_BLOCK - head:])) % PRIMES[k] if head else 0
    if len(raw) > head:
        sums = ((raw[head:].reshape(-1, _BLOCK) + np.uint64(1)) @ _POWERS[k]) % np.uint64(PRIMES[k])
        step = pow(BASES[k], _BLOCK, PRIMES[k])
        for s in sums.tolist():
            h = (h * step + s) % PRIMES[k]
    return h


def text_hash(data: bytes, chunk_bytes: int, bits: int = 31) -> int:
    """Both residues of the whole text, chunk by chunk, in one integer."""
    h = [0, 0]
    for i in range(0, len(data), chunk_bytes):
        part = data[i:i + chunk_bytes]
        h = [combine(h[k], chunk_hash(part, k), len(part), k) for k in (0, 1)]
    return joined(h, bits)


def joined(h: list[int], bits: int) -> int:
    keep = (1 << bits) - 1
    return (h[0] & keep) << 31 | h[1] & keep


def _key(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _lowered(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode().translate(_TABLE)


def huge_chunks(docs: DataFrame, chunk_bytes: int, huge_bytes: int) -> DataFrame:
    """_row, doc_id, sha256, at, part: the chunks of the texts above huge_bytes."""
    rows = docs.where(F.octet_length("text") > huge_bytes).select("doc_id", F.monotonically_increasing_id().alias("_row"), F.encode(F.translate("text", UPPER_LETTERS, LOWER_LETTERS), "UTF-8").alias("_data"))
    rows = rows.select("_row", "doc_id", F.sha2("_data", 256).alias("sha256"), "_data", F.explode(F.expr(f"sequence(0L, (octet_length(_data) - 1) div {chunk_bytes})")).alias("at"))
    return rows.select("_row", "doc_id", "sha256", "at", F.expr(f"substring(_data, cast(at * {chunk_bytes} + 1 as int), {chunk_bytes})").alias("part"))


def huge_fingerprints(chunks: DataFrame, bits: int = 31) -> DataFrame:
    """_row, len, fp of each text of huge_chunks, combined from the hashes of its chunks."""

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [p.as_py() for p in batch.column(2)]
            own = [pa.array([len(p) for p in parts], pa.int64()), *(pa.array([chunk_hash(p, k) for p in parts], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *own], ["_row", "at", "size", "h0", "h1"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        h = [0, 0]
        for size, *own in zip(pdf["size"].tolist(), pdf["h0"].tolist(), pdf["h1"].tolist()):
            h = [combine(h[k], own[k], size, k) for k in (0, 1)]
        return pd.DataFrame({"_row": pdf["_row"].iloc[:1], "len": [int(pdf["size"].sum())], "fp": [joined(h, bits)]})

    hashed = chunks.select("_row", "at", "part").repartition("_row", "at").mapInArrow(of_chunks, "_row long, at long, size long, h0 long, h1 long")
    return hashed.groupBy("_row").applyInPandas(fold, "_row long, len long, fp long")


def fingerprints(docs: DataFrame, chunk_bytes: int = 1 << 16, bits: int = 31) -> DataFrame:
    """len, fp of every row. bits below 31 make collisions, for tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [_lowered(t) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([len(d) for d in data], pa.int64()), pa.array([text_hash(d, chunk_bytes, bits) for d in data], pa.int64())], ["len", "fp"])

    return docs.select("text").mapInArrow(run, "len long, fp long")


def _slots(fp: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (mix(fp.astype(np.uint64) + mix(size.astype(np.uint64))) % np.uint64(MAP_BITS)).astype(np.int64)


def repeated_map(prints: DataFrame) -> np.ndarray:
    """Packed bits, one set for each fingerprint and length that occurs more than once (MAP_BITS in all)."""
    twice = prints.groupBy("fp", "len").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], ["slot"])

    marked = twice.select("fp", "len").mapInArrow(run, "slot long")
    parts = marked.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 8 + 4096, np.uint8)
    for part, bits in zip(parts["part"].to_pylist(), parts["bits"].to_pylist()):  # 2^15 bits each, part 1 the first; slot 0 is in part 0
        at = (part - 1) * 4096 if part else MAP_BITS // 8
        out[at:at + len(bits)] |= np.frombuffer(bits, np.uint8)
    return out


def _marked(bits: np.ndarray, fp: np.ndarray, size: np.ndarray) -> np.ndarray:
    slot = _slots(fp, size)
    at = np.where(slot > 0, slot - 1, MAP_BITS)
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def same(a, b, chunk_bytes: int) -> bool:
    """Streaming comparison, chunk by chunk."""
    return len(a) == len(b) and all(a[k:k + chunk_bytes] == b[k:k + chunk_bytes] for k in range(0, len(a), chunk_bytes))


def suspects(docs: DataFrame, bits: np.ndarray, chunk_bytes: int, hash_bits: int) -> DataFrame:
    """doc_id, len, fp, sha256, lead, data of every row. lead: null where the fingerprint is not marked, else the place in its
    batch of the first row with an equal text; that row alone carries the text (data)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [_lowered(t) for t in batch.column(1)]
            size, fp = [len(d) for d in data], [text_hash(d, chunk_bytes, hash_bits) for d in data]
            marked = _marked(shared.value, np.array(fp, np.int64), np.array(size, np.int64)).tolist()
            leads: dict[tuple[int, int], list[int]] = {}
            lead: list[int | None] = [None] * len(data)
            for i in range(len(data)):
                if marked[i]:
                    known = leads.setdefault((fp[i], size[i]), [])
                    lead[i] = next((k for k in known if same(data[k], data[i], chunk_bytes)), i)
                    if lead[i] == i:
                        known.append(i)
            sha = [hashlib.sha256(d).hexdigest() for d in data]
            cols = [pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(sha, pa.string()), pa.array(lead, pa.int64()), pa.array(range(len(data)), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([d if k == i else None for i, (d, k) in enumerate(zip(data, lead))], pa.binary())], ["doc_id", "len", "fp", "sha256", "lead", "place", "data"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_key(docs)}, len long, fp long, sha256 string, lead long, place long, data binary")


def lead_classes(leads: DataFrame, chunk_bytes: int, keys: list[str]) -> DataFrame:
    """row, first, and data where they are equal: first is the least row among those of equal keys that hold the same text.
    leads: row, data and the keys."""
    rows = leads.select(*keys, "row", "data").repartition(*keys).sortWithinPartitions(*keys, "row")
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, []
        for batch in batches:
            first = []
            for i, (*own, row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(k + 1)))):
                if own != at:
                    at, known = own, []
                data = memoryview(batch.column(k + 1)[i].as_buffer()).cast("B")
                found = next((r for r, d in known if same(d, data, chunk_bytes)), None)
                if found is None:
                    found = row
                    known.append((row, memoryview(bytes(data))))
                first.append(found)
            lone = pa.array([f == r for f, r in zip(first, batch.column(k).to_pylist())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:k + 1], pa.array(first, pa.int64()), pc.if_else(lone, batch.column(k + 1), pa.scalar(None, pa.binary()))], [*keys, "row", "first", "data"])

    schema = ", ".join(f"{c} {leads.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, f"{schema}, row long, first long, data binary")


def huge_classes(chunks: DataFrame, prints: DataFrame, chunk_bytes: int) -> DataFrame:
    """doc_id, sha256, class of each huge text: texts are equal where all their chunks are."""
    own = chunks.select(F.col("_row").alias("row"), "at", F.col("part").alias("data")).join(prints.withColumnRenamed("_row", "row"), "row")
    found = lead_classes(own, chunk_bytes, ["fp", "len", "at"])
    alike = found.groupBy("row", "fp", "len").agg(F.array_sort(F.collect_list(F.struct("at", "first"))).alias("alike"))
    least = alike.groupBy("fp", "len", "alike").agg(F.min("row").alias("class"))
    heads = chunks.where("at = 0").select(F.col("_row").alias("row"), "doc_id", "sha256")
    return heads.join(alike.join(least, ["fp", "len", "alike"]).select("row", "class"), "row").select("doc_id", "sha256", (-1 - F.col("class")).alias("class"))


def dedup(docs: DataFrame, chunk_bytes: int = 1 << 16, huge_bytes: int = 1 << 24, bits: int = 31, salts: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; of equal texts the largest doc_id stays."""
    docs = docs.select("doc_id", "text")
    small = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= huge_bytes)
    marked = repeated_map(fingerprints(small, chunk_bytes, bits))
    place = F.monotonically_increasing_id()
    table = cut(suspects(small, marked, chunk_bytes, bits).withColumn("row", place).withColumn("lead", F.col("row") - F.col("place") + F.col("lead")).drop("place"), "suspects")
    leads = table.where("data IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    parts = cut(lead_classes(leads, chunk_bytes, ["fp", "len", "salt"]), "parts")
    whole = lead_classes(parts.where("data IS NOT NULL"), chunk_bytes, ["fp", "len"]).select(F.col("row").alias("first"), F.col("first").alias("class"))
    classes = parts.select(F.col("row").alias("lead"), "first").join(whole, "first").select("lead", "class")
    seen = table.where("lead IS NOT NULL").select("doc_id", "sha256", "lead").join(classes, "lead").select("doc_id", "sha256", "class")
    chunks = cut(huge_chunks(docs, chunk_bytes, huge_bytes), "chunks")
    seen = cut(seen.unionByName(huge_classes(chunks, huge_fingerprints(chunks, bits), chunk_bytes)).withColumn("own", place), "classes")
    sizes = cut(seen.groupBy("class").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "own")).alias("keep")), "groups")
    grouped = seen.join(sizes, "class").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("own") == F.col("keep.own")).alias("kept"), F.col("sha256").alias("text_sha256"))
    alone = table.where("lead IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha256").alias("text_sha256"))
    return grouped.unionByName(alone)
