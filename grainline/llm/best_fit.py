"""Best-fit packing of tokenised documents into sequences (operator 3).

Documents are tokenised in mapInArrow (each distinct word once per Python worker), cut into pieces of at most
max_len ids, and the pieces are dealt at random into groups of bounded size. Each group is packed on its own by
vector best-fit decreasing: a sequence has residual tokens, document slots and attention cost (the sum of
length^2), and a piece goes to the sequence that fits under every constraint and scores best. A group of
group_rows pieces leaves about one part-filled sequence, so the number of sequences is near the lower bound at
any size, and no task ever holds more than one group.

Defined results: null text is empty (one piece, id eos only); repeated rows and null doc_ids are packed row by
row; ties between sequences go to the one opened first; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .tokens import Chunk, chunks, equal_spans, text_array

#: Words remembered by one Python worker (about 70 bytes each); beyond it the memory starts anew.
CACHE_WORDS = 1_500_000


class WordTokenizer:
    """Ids of whole texts from the ids of their words. The vocabulary's normaliser and splitter never join
    across white space, so a text's ids are its words' ids in order; each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of the words known
        self.raw = np.zeros(8, np.uint8)  # their bytes, and 8 more
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a word in raw
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of its ids
        self.ids = np.zeros(0, np.uint32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each word."""
        out = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words])
        of = np.searchsorted(ends, [s for s, _ in out.offsets], "right")
        return np.array(out.ids, np.uint32), np.bincount(of, minlength=len(words))

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each word."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 2000):
            a, b = self.encode_words([w.decode() for w in words[i:i + 2000]])
            ids.append(a)
            counts.append(b)
        return np.concatenate(ids), np.concatenate(counts)

    def find(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, known) of each word: known where a word of its hash is there and has the same bytes."""
        place = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        if not len(self.keys):
            return place, np.zeros(len(hashes), bool)
        known = (self.keys[place] == hashes) & (self.size[place] == size)
        hit = np.flatnonzero(known)
        known[hit] = equal_spans(raw, start[hit], self.raw, self.start[place[hit]], size[hit])
        return place, known

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Remember words that are not known; of words of one hash the first is."""
        ids, count = self.ids_of(words)
        size = np.array([len(w) for w in words], np.int64)
        start = len(self.raw) - 8 + np.cumsum(size) - size
        self.raw = np.concatenate([self.raw[:-8], np.frombuffer(b"".join(words), np.uint8), np.zeros(8, np.uint8)])
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        order = order[np.r_[True, keys[order][1:] != keys[order][:-1]]]
        both = lambda a, b: np.concatenate([a, b])[order]
        self.keys, self.start, self.size, self.at, self.count = keys[order], both(self.start, start), both(self.size, size), both(self.at, at), both(self.count, count)

    def encode(self, chunk: Chunk) -> list[np.ndarray]:
        """Ids of each document of the chunk."""
        first, kind = chunk.distinct()
        hashes, raw = chunk.hashes()[first], chunk.bytes(False)
        start, size = chunk.starts[first], chunk.ends[first] - chunk.starts[first]
        place, known = self.find(hashes, raw, start, size)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE_WORDS:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            self.learn(hashes[new], [raw[a:a + n].tobytes() for a, n in zip(start[new].tolist(), size[new].tolist())])
            place, known = self.find(hashes, raw, start, size)
        at, count, ids = self.at[place], self.count[place], self.ids
        if not known.all():  # words that share a hash with another: their ids are not remembered
            rest = np.flatnonzero(~known)
            own, n = self.ids_of([raw[start[i]:start[i] + size[i]].tobytes() for i in rest])
            at[rest], count[rest] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, own])
        count, at = count[kind], at[kind]
        total = np.concatenate([[0], np.cumsum(count)])
        out = ids[np.repeat(at - total[:-1], count) + np.arange(total[-1])]
        b = total[chunk.word_bounds]
        return [out[b[i]:b[i + 1]] for i in range(len(chunk))]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_for(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, eos: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_for(tokenizer_path)
        for batch in batches:
            text = text_array(batch.column(1))
            for c in chunks(text, 1 << 21):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, own in enumerate(tok.encode(c)):
                    own = np.append(own, np.uint32(eos)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), max_len)):
                        part = own[s:s + max_len]
                        row.append(c.first + i)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                cols = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: np.ndarray, score: str = "residual", weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each item. sizes: items x dimensions, the first being tokens; every item fits an
    empty bin. Items go in descending order of their weighted load; score 'residual' takes the feasible bin whose
    residual vector after the item has the least norm, 'dot' the one with the largest weighted product."""
    n, dims = sizes.shape
    w = np.ones(dims) if weights is None else np.asarray(weights, float)
    load = sizes / capacity * w
    order = np.lexsort((np.arange(n), -load.sum(1)))
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((256, dims))
    bin_of, opened, used = np.zeros(256, np.int64), 0, 0  # open bins only
    for i in order:
        size = sizes[i]
        room = left[:used]
        fits = np.flatnonzero((room >= size).all(1))
        if len(fits):
            if score == "dot":
                k = fits[np.argmax((room[fits] / capacity) @ (w * size / capacity))]
            else:
                k = fits[np.argmin(np.square((room[fits] - size) / capacity * w).sum(1))]
        else:
            if used == len(left):
                left, bin_of = np.concatenate([left, np.zeros_like(left)]), np.concatenate([bin_of, np.zeros_like(bin_of)])
            k, left[used], bin_of[used] = used, capacity, opened
            used, opened = used + 1, opened + 1
        bins[i], offset[i] = bin_of[k], capacity[0] - left[k, 0]
        left[k] -= size
        if left[k].min() <= 0:  # full: out of the open list, keeping the order of opening
            left[k:used - 1], bin_of[k:used - 1] = left[k + 1:used].copy(), bin_of[k + 1:used].copy()
            used -= 1
    return bins, offset


def pack(items: DataFrame, max_len: int = 4096, max_docs: int = 4096, max_cost: int | None = None, score: str = "residual", weights: list[float] | None = None, group_rows: int = 20_000) -> DataFrame:
    """Items (any columns, with length <= max_len) plus sequence_id and offset. max_docs and max_cost bound the
    pieces and the sum of length^2 in a sequence; an item whose own cost exceeds max_cost can't be packed."""
    cost = float(max_cost if max_cost is not None else max_len * max_len)
    table = cut(items.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n = table.count()
    groups = max(1, -(-n // group_rows))
    fields = [f for f in table.schema.fields if f.name != "_row"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    names = [f.name for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        tokens = pdf["length"].to_numpy(np.float64)
        sizes = np.stack([tokens, np.ones(len(tokens)), tokens * tokens], 1)
        if len(tokens) and (sizes[:, 2].max() > cost or tokens.max() > max_len):
            raise ValueError("a piece is larger than a sequence")
        bins, offset = best_fit(sizes, np.array([max_len, max_docs, cost], float), score, weights)
        out = pdf[names].copy()
        out["sequence_id"] = int(pdf["_group"].iloc[0]) * (1 << 32) + bins
        out["offset"] = offset
        return out

    dealt = table.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, eos: int = 1, with_ids: bool = False, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document."""
    return pack(pieces(docs, tokenizer_path, max_len, eos, with_ids), max_len, **options)
