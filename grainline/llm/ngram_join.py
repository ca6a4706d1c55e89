"""N-gram Jaccard self-join by MinHash banding (operator 9).

A document's set holds the hashes of its n-grams of words (A-Z lower-cased); with fewer than n words, of all
its words together. Documents with equal sets form a class, and only its representative goes on. Band and row
counts are chosen for the target recall at the threshold, band hashes are shuffled, and documents that meet in a
band are gathered into candidate clusters; within a cluster every pair is verified on the full sets. A cluster
whose sets or members exceed a task's memory is dealt out over many tasks: by pairs of its blocks where most members share bands,
or band by band, each pair in the first band it shares, where chance meetings have chained small groups together (whichever compares
fewer pairs). Tasks return one row per member, never pairs: its number of links and a lead that it is linked to; leads are joined to
classes by connected components, whose tables stay distributed and are written between rounds.

Result, one row per document: doc_id, class_id (the smallest doc_id among all that links connect), rep_id (the
smallest doc_id with an equal set), n_links (other documents of similarity >= threshold, copies included).
Defined results: null or empty text has no n-grams and links to nothing, its class is itself; repeated rows give one
row per distinct doc_id and set (a doc_id that has several sets takes part with each); null doc_ids are dropped
from the join and returned with null class; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .tokens import chunks, grams, mix, text_array

#: Elements of sets (8 bytes each) that one verification task takes from each of its two blocks.
BLOCK_ELEMENTS = 1 << 20
#: Members that a task takes from each of its two blocks, and how many of them it compares at once.
BLOCK_MEMBERS, STRIP = 4096, 1024


def bands_for(threshold: float, recall: float, most: int = 512) -> tuple[int, int]:
    """(bands, rows) with 1 - (1 - s^rows)^bands >= recall at the threshold: the most rows whose hashes stay within 128, else the fewest hashes."""
    found = []
    for rows in range(1, 13):
        bands = 1
        while 1 - (1 - threshold**rows) ** bands < recall and bands * rows <= most:
            bands += 1
        if bands * rows <= most:
            found.append((bands, rows))
    within = [x for x in found if x[0] * x[1] <= 128]
    return max(within, key=lambda x: x[1]) if within else min(found, key=lambda x: x[0] * x[1])


def gram_sets(text: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every row of the batch."""
    for c in chunks(text):
        h = c.hashes(lower=True)
        g = grams(h, n)
        b = c.word_bounds
        for i in range(len(c)):
            lo, hi = int(b[i]), int(b[i + 1])
            if hi - lo >= n:
                yield c.first + i, np.unique(g[lo:hi - n + 1])
            else:
                yield c.first + i, grams(h[lo:hi], hi - lo) if hi > lo else h[:0]


def digests(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s + np.uint64(99)).sum(dtype=np.uint64).view(np.int64))


def signature(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the set's minimum values."""
    g = np.random.Generator(np.random.PCG64(7))
    a = g.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = g.integers(0, 1 << 63, bands * rows, np.uint64)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        low = np.minimum(low, (s[i:i + 512, None] * a + b).min(0))
    low = mix(low).reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + low[:, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, size, set_a, set_b (128 bits of the set), bands array<long>."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, a, b, sig = [], [], [], []
            for _, s in gram_sets(text_array(batch.column(1)), n):
                size.append(len(s))
                x, y = digests(s)
                a.append(x)
                b.append(y)
                sig.append(signature(s, bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "size", "set_a", "set_b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, size long, set_a long, set_b long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that edges (u, v) connect with it. Min-label rounds with pointer jumping, until no label
    falls; tables stay distributed and are written each round."""
    both = cut(edges.select("u", "v").where("u <> v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")).where("u <> v")).distinct(), "edges")
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        low = labels.join(near, "u").select("u", F.least("comp", "c").alias("low"), F.col("comp").alias("old"))
        jump = low.join(labels.select(F.col("u").alias("low"), F.col("comp").alias("far")), "low", "left")
        new = cut(jump.select("u", F.least("low", F.coalesce("far", "low")).alias("comp"), "old"), "labels")
        done = new.where("comp <> old").isEmpty()
        labels = new.select("u", "comp")
        if done:
            return labels.withColumnRenamed("u", "node")


def verified(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard >= threshold; right None: left with itself. Set intersections are counted by
    products of incidence matrices over slices of the elements."""
    sets = left + (right or [])
    if len(sets) == 2:
        x, y = sets
        both = len(np.intersect1d(x, y, assume_unique=True))
        ok = both >= threshold * (len(x) + len(y) - both)
        return np.array([[ok]]) if right is not None else np.array([[True, ok], [ok, True]])
    size = np.array([len(s) for s in sets], np.float64)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(int))
    shared = count[code] > 1  # elements of one set only meet nothing
    rank = np.cumsum(count > 1) - 1
    code, owner = rank[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    nl = len(left)
    common = np.zeros((nl, len(right) if right is not None else nl), np.float32)
    width = max(256, min(8192, (1 << 24) // max(1, len(sets))))
    top = int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, top, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        common += m[:nl] @ (m[nl:] if right is not None else m).T
    other = size[nl:] if right is not None else size
    union = size[:nl, None] + other[None, :] - common
    return common >= threshold * union - 1e-6


def merge(label: np.ndarray, rows: np.ndarray, cols: np.ndarray, ok: np.ndarray) -> None:
    """Give all that the links ok (rows x cols, places in label) connect, also through labels they share already, one label."""
    big = np.iinfo(np.int64).max
    while True:
        own = np.minimum(np.where(ok, label[cols][None, :], big).min(1, initial=big), label[rows])
        back = np.minimum(np.where(ok, own[:, None], big).min(0, initial=big), label[cols])
        to = np.arange(len(label))
        np.minimum.at(to, label[rows], own)
        np.minimum.at(to, label[cols], back)
        while (to[to] != to).any():
            to = to[to]
        new = to[label]
        if (new == label).all():
            return
        label[:] = new


def compared(left: list[np.ndarray], right: list[np.ndarray] | None, name_l: np.ndarray, name_r: np.ndarray, copies_l: np.ndarray, copies_r: np.ndarray, threshold: float, strip: int = STRIP, earlier: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Links and leads of the left, links and leads of the right; right None: left with itself. A lead is a member that the links
    found here connect with its own, one for all that they connect. Strips of rows are reduced at once, so memory is strip times the
    members of the right. earlier: hashes (members x bands) of left and right; pairs that share one are left out."""
    n = len(left)
    links_l, links_r = np.zeros(n, np.int64), np.zeros(len(name_r), np.int64)
    label = np.arange(n if right is None else n + len(right))
    cols = label.copy() if right is None else label[n:].copy()
    for lo in range(0, n, strip):
        hi = min(lo + strip, n)
        if right is not None:
            ok = verified(left[lo:hi], right, threshold)
        elif n <= strip:
            ok = verified(left, None, threshold)
        else:
            ok = verified(left[lo:hi], left, threshold)
        if right is None:
            ok[np.arange(hi - lo), np.arange(lo, hi)] = False
        if earlier is not None:
            for k in range(earlier[0].shape[1]):
                ok &= earlier[0][lo:hi, k, None] != earlier[1][None, :, k]
        links_l[lo:hi] = ok @ copies_r
        links_r += copies_l[lo:hi] @ ok
        merge(label, np.arange(lo, hi), cols, ok)
    lead = (name_l if right is None else np.concatenate([name_l, name_r]))[label]
    return links_l, lead[:n], links_r, lead[n:] if right is not None else lead


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block_elements: int = BLOCK_ELEMENTS, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """doc_id, class_id, rep_id, n_links of every document; doc_id is an integer."""
    bands, rows = bands_for(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(signatures(docs, n, bands, rows), "signatures")
    sets = signed.where("size > 0 AND doc_id IS NOT NULL")
    # classes of equal sets
    reps = cut(sets.groupBy("set_a", "set_b", "size").agg(F.min(F.struct("doc_id", "bands")).alias("m"), F.count_distinct("doc_id").alias("copies")).select("set_a", "set_b", "size", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands"), "copies"), "reps")
    # a doc_id with several sets (repeated rows with other texts) is told apart by its set
    met = reps.select(F.xxhash64("set_a", "set_b", "size").alias("node"), F.posexplode("bands").alias("band", "h"))
    heads = met.groupBy("band", "h").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    # a node's heads (one a band at most) are tied to the lowest of them: nodes of one cluster share most of these edges
    own = met.join(heads, ["band", "h"]).groupBy("node").agg(F.collect_set("head").alias("heads"))
    lowest = F.array_min("heads").alias("v")
    stars = own.select(F.explode(F.array_union("heads", F.array("node"))).alias("u"), lowest).where("u <> v").distinct()
    clusters = components(stars)
    members = cut(reps.withColumn("node", F.xxhash64("set_a", "set_b", "size")).join(clusters, "node").select("node", "comp", "rep", "copies", "size", "set_a", "set_b", "bands"), "members")
    # blocks in order of a running sum of sizes would need one task; a hash deals members out evenly
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("size") / block_elements), F.ceil(F.count(F.lit(1)) / block_members)).cast("int").alias("blocks")
    shape = cut(members.groupBy("comp").agg(blocks, F.count(F.lit(1)).alias("m")), "shape")
    large = members.join(shape.where("blocks > 1").select("comp", "m"), "comp").select("comp", "m", "node", "size", F.posexplode("bands").alias("band", "h"))
    buckets = cut(large.groupBy("comp", "band", "h").agg(blocks, F.count(F.lit(1)).alias("n"), F.first("m").alias("m")).where("n > 1"), "buckets")
    # by band where that compares fewer pairs than all pairs of the cluster
    banded = buckets.groupBy("comp").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"), F.first(F.col("m").cast("double") * F.col("m")).alias("all")).where("pairs < all").select("comp", F.lit(True).alias("banded"))
    shape = cut(shape.select("comp", "blocks").join(banded, "comp", "left"), "shape")
    whole = members.join(shape.where("banded IS NULL").select("comp", "blocks"), "comp").withColumns({"band": F.lit(-1), "h": F.lit(0).cast("long")})
    by_band = members.join(shape.where("banded").select("comp"), "comp").select("*", F.posexplode("bands").alias("band", "h")).join(buckets.select("comp", "band", "h", "blocks"), ["comp", "band", "h"])
    placed = whole.unionByName(by_band).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    mine = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(mine, lambda b: F.struct(F.least("block", b).alias("i"), F.greatest("block", b).alias("j")))
    earlier = F.when(F.col("band") > 0, F.slice("bands", 1, F.col("band")))
    tasks = placed.withColumn("pair", F.explode(pairs)).select("rep", "set_a", "set_b", "node", "comp", "band", "h", earlier.alias("earlier"), "copies", "block", "pair.i", "pair.j")
    found = _verify(docs, tasks, n, threshold)
    found = cut(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("u"), F.col("lead").alias("v")))
    named = reps.withColumn("node", F.xxhash64("set_a", "set_b", "size")).select("set_a", "set_b", "size", "rep", "copies", "node")
    named = named.join(links, "node", "left").join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = named.groupBy("comp").agg(F.min("rep").alias("class_id"))
    named = named.join(lowest, "comp").select("set_a", "set_b", "size", F.col("rep").alias("rep_id"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = sets.select("doc_id", "set_a", "set_b", "size").distinct().join(named, ["set_a", "set_b", "size"]).select("doc_id", "class_id", "rep_id", "n_links")
    rest = signed.where("size = 0 OR doc_id IS NULL").select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(rest)


def _verify(docs: DataFrame, tasks: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, links, lead for each member of each task (comp, band, h, i, j)."""
    wanted = tasks.withColumnRenamed("rep", "doc_id")
    fetch = wanted.select("doc_id").distinct()

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for _, x in gram_sets(text_array(batch.column(1)), n)]
            a, b = zip(*map(digests, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], [*key, "grams"])

    key = ["doc_id", "set_a", "set_b"]
    sets = docs.join(fetch, "doc_id").mapInArrow(shingle, "doc_id long, set_a long, set_b long, grams binary").dropDuplicates(key)
    rows = wanted.join(sets, key)

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "node"])
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        grams_of = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
        node, copies, block = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        past = None if pdf["earlier"].iloc[0] is None else np.stack(pdf["earlier"].to_list())
        if i == j:
            links, lead, _, _ = compared(grams_of, None, node, node, copies, copies, threshold, earlier=None if past is None else (past, past))
        else:
            k = int((block == i).sum())
            if k == 0 or k == len(node):
                return pd.DataFrame({"node": node[:0], "links": node[:0], "lead": node[:0]})
            found = compared(grams_of[:k], grams_of[k:], node[:k], node[k:], copies[:k], copies[k:], threshold, earlier=None if past is None else (past[:k], past[k:]))
            links, lead = np.concatenate(found[0::2]), np.concatenate(found[1::2])
        return pd.DataFrame({"node": node, "links": links, "lead": lead})

    return rows.groupBy("comp", "band", "h", "i", "j").applyInPandas(check, "node long, links long, lead long")
