"""The trie of conversation prefixes, with subtree leaves and savings by an Euler tour (operator 11).

Turns are put in order by one range sort, in which a conversation may lie over many partitions. A polynomial fingerprint of the
turns up to each (modulo 2^127 - 1, over SHA-256 digests of role and text) is composable: a task computes it within its
rows, and what lies before a partition is added from one carried row a partition. Equal prefixes have equal fingerprints; two different ones share one
with probability about (turns)^3 / 2^127. Grouping by fingerprint gives the nodes.

A node is named by its smallest member and its depth. The nodes with one smallest member are a path straight down to that
conversation's end, and a path goes on as the first child of each of its nodes. In the Euler tour the enter arcs of a path are therefore one run, and
its exit arcs are runs that only nodes with further children (branchings) divide. The list of runs, at most two a path, is ranked by random
contraction: of a run that stays and is followed by one that goes, by coins of a hash, the first takes in the second; rounds take a quarter
away each until `limit` runs are left, which one task walks through; then the rounds are taken back. A run's rank is its first arc's place in
the tour and the leaves and savings before it. The arcs of a run follow by counting, with prefix sums along the path in buckets of
bounded length, and a node's subtree is the difference of the prefix sums at its exit and its enter arc.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, new_dir

PRIME = (1 << 127) - 1
#: The first 31 decimals of pi's fraction, a base like any other.
BASE = 1415926535897932384626433832795
#: A rebuilt conversation takes less than HEADS first turns from the one that its number, cut to a multiple of BLOCK, names.
HEADS, BLOCK = 4, 20
#: Bounds of what a window orders in one task: depths of a path, and siblings at least (else about the root of the number of paths).
DEPTHS, SIBLINGS = 1 << 12, 64
#: Runs that one task walks through, and conversation numbers whose ends are joined in one row.
LIMIT, IDS = 1 << 15, 1 << 16
ROOT = bytes(16)
WEIGHTS = ("arcs", "leaves", "saved")


def _number(raw: bytes | None) -> int:
    return int.from_bytes(raw, "big") % PRIME if raw else 0


def _bytes(n: int) -> bytes:
    return n.to_bytes(16, "big")


class _Powers(dict):
    def __missing__(self, k: int) -> int:
        p = pow(BASE, k, PRIME)
        if k < 1 << 12:
            self[k] = p
        return p


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def turns(conversations: DataFrame) -> DataFrame:
    """conv, digest, words of every turn, in order of conversation and turn over the partitions. Rows of one turn number follow each other by
    role and then by digest."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words")).where("conv IS NOT NULL")
    keys = ["conv", "turn", "role", "digest", "tie"]
    return rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "digest", "words")


def _number_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, conv, open (it may have begun before the partition), at (1, 2, .. within the partition), mark (fingerprint of these)."""
    part, last, first, at, mark, power = TaskContext.get().partitionId(), None, None, 0, 0, 1
    for batch in batches:
        out = []
        for conv, digest, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if conv != last:
                first = conv if first is None else first
                last, at, mark, power = conv, 0, 0, 1
            at, power = at + 1, power * BASE % PRIME
            mark = (mark + _number(digest) * power) % PRIME
            out.append((part, conv, conv == first, at, _bytes(mark), digest, words))
        yield _table(out, ["part", "conv", "open", "at", "mark", "digest", "words"], [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64()])


def carries(numbered: DataFrame) -> DataFrame:
    """part, at0, mark0: turns and fingerprint of the partition's first conversation in the partitions before. A row a partition."""
    ends = numbered.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), F.max_by(F.struct("at", "mark"), F.struct("conv", "at")).alias("end")).orderBy("part").collect()
    out, conv, at, mark = [], None, 0, 0
    for r in ends:
        before = (at, mark) if r["first"] == conv else (0, 0)
        if before[0]:
            out.append((r["part"], before[0], _bytes(before[1])))
        at0, mark0 = before if r["first"] == r["last"] else (0, 0)
        conv, at, mark = r["last"], at0 + r["end"]["at"], (mark0 + pow(BASE, at0, PRIME) * _number(r["end"]["mark"])) % PRIME
    return numbered.sparkSession.createDataFrame(out, "part int, at0 long, mark0 binary")


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: how its own fingerprints become those of the rebuilt one (shift, plus), its last node and its borrowed turns."""
    power = _Powers()
    head = pa.struct([("depth", pa.int64()), ("mark", pa.binary()), ("parent", pa.binary()), ("words", pa.int64())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            h, own = r["h"], [t["digest"] for t in (r["t1"], r["t2"], r["t3"]) if t]
            taken = [t for t in (r["b1"], r["b2"], r["b3"]) if t][:h]
            marks = [0]
            for i, t in enumerate(taken):
                marks.append((marks[-1] + _number(t["digest"]) * power[i + 1]) % PRIME)
            shift = h - len(taken)
            down = pow(power[shift], -1, PRIME)
            skipped = sum(_number(d) * power[i + 1] for i, d in enumerate(own[:h])) % PRIME
            plus = (marks[-1] - skipped * down) % PRIME
            end, depth = marks[-1], len(taken)
            if r["n"] > h:
                whole = (_number(r["mark0"]) + power[r["at0"]] * _number(r["mark"])) % PRIME
                end, depth = (whole * down + plus) % PRIME, r["n"] - shift
            heads = [{"depth": i + 1, "mark": _bytes(marks[i + 1]), "parent": _bytes(marks[i]), "words": t["words"]} for i, t in enumerate(taken)]
            out.append((r["conv"], shift, _bytes(plus), _bytes(end), depth, heads))
        yield _table(out, ["conv", "shift", "plus", "end", "depth", "heads"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(head)])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, depth, mark, parent, words of a conversation's own turns where they stand in the rebuilt one."""
    power = _Powers()
    downs = [pow(BASE, -s, PRIME) for s in range(HEADS)]
    for batch in batches:
        out = []
        for conv, at, mark, digest, words, at0, mark0, shift, plus in zip(*(c.to_pylist() for c in batch.columns)):
            whole = _number(mark) * power[at0] + _number(mark0) if at0 else _number(mark)
            add, down = _number(plus), downs[shift]
            before = (whole - _number(digest) * power[at0 + at]) % PRIME
            out.append((conv, at0 + at - shift, _bytes((whole * down + add) % PRIME), _bytes((before * down + add) % PRIME), words))
        yield _table(out, ["conv", "depth", "mark", "parent", "words"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()])


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """end, ends: the SHA-256 of each node's ids, whose parts come in order; one part at a time is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for end, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if end != node:
                if state is not None:
                    out.append((node, state.digest()))
                node, state = end, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _table(out, ["end", "ends"], [pa.binary(), pa.binary()])
    if state is not None:
        yield _table([(node, state.digest())], ["end", "ends"], [pa.binary(), pa.binary()])


def nodes(conversations: DataFrame) -> DataFrame:
    """mark, parent, conv, depth, n_convs, saved (the node's own), ends (SHA-256, null where no conversation ends) of every node."""
    numbered = cut(turns(conversations).mapInArrow(_number_turns, "part int, conv long, open boolean, at long, mark binary, digest binary, words long"), "turns")
    before = carries(numbered).withColumn("_open", F.lit(True))
    placed = numbered.join(F.broadcast(before), (numbered["part"] == before["part"]) & (numbered["open"] == before["_open"]), "left").select("conv", "at", "mark", "digest", "words", F.coalesce("at0", F.lit(0)).cast("long").alias("at0"), "mark0")
    at, turn = F.col("at0") + F.col("at"), F.struct("digest", "words")
    own = placed.groupBy("conv").agg(F.max(at).alias("n"), F.max_by(F.struct("mark", "at0", "mark0"), at).alias("end"), *(F.max(F.when(at == i, turn)).alias(f"t{i}") for i in (1, 2, 3)))
    own = cut(own.select("conv", "n", "end.*", "t1", "t2", "t3"), "conversations")
    heads = own.select(F.col("conv").alias("base"), *(F.col(f"t{i}").alias(f"b{i}") for i in (1, 2, 3)))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS))
    starts = own.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % BLOCK).join(heads, "base", "left").drop("base")
    starts = cut(starts.mapInArrow(_starts, "conv long, shift long, plus binary, end binary, depth long, heads array<struct<depth: long, mark: binary, parent: binary, words: long>>"), "starts")

    rest = placed.where(at > h).join(starts.select("conv", "shift", "plus"), "conv").select("conv", "at", "mark", "digest", "words", "at0", "mark0", "shift", "plus")
    rows = rest.mapInArrow(_rebuilt, "conv long, depth long, mark binary, parent binary, words long")
    rows = rows.unionByName(starts.select("conv", F.explode("heads").alias("t")).select("conv", "t.*"))
    found = rows.groupBy("mark").agg(F.max("parent").alias("parent"), F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    root = starts.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(F.lit(ROOT).alias("mark"), F.lit(None).cast("binary").alias("parent"), "conv", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    # ids of a range are sorted as a list of bounded length, ranges are streamed in order
    part = F.expr(f"conv div {IDS}")
    ids = starts.groupBy("end", part.alias("range")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    ends = ids.repartition("end").sortWithinPartitions("end", "range").select("end", "ids").mapInArrow(_end_hashes, "end binary, ends binary")
    out = found.unionByName(root).join(ends.withColumnRenamed("end", "mark"), "mark", "left")
    return cut(out.select("mark", "parent", "conv", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "ends"), "nodes")


def paths(found: DataFrame) -> DataFrame:
    """conv, top and deep (depths of the path's first and last node), saved (all its nodes'), up (the path that it hangs on; null: the root's)."""
    own = found.groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("deep"), F.sum("saved").alias("saved"), F.min_by("parent", "depth").alias("parent"))
    above = found.where("n_convs > 1").select(F.col("mark").alias("parent"), F.col("conv").alias("up"))
    return cut(own.join(above, "parent", "left").select("conv", "top", "deep", "saved", F.when(F.col("top") > 0, F.col("up")).alias("up"), (F.col("top") - 1).alias("at")), "paths")


def runs(line: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs of the tour: conv, depth (-1: a path's enter arcs and the exits below its deepest branching; else a branching's exits), next and next_depth,
    and their weights. And the branchings: up, at, children (besides the path's own), in a table."""
    count = line.count()
    hung = line.where("up IS NOT NULL").select("conv", "up", "at", F.pmod(F.xxhash64("conv"), F.lit(-(-count // max(SIBLINGS, math.isqrt(count))))).alias("bucket"))
    hung = hung.withColumn("sibling", F.lead("conv").over(Window.partitionBy("up", "at", "bucket").orderBy("conv")))
    groups = hung.groupBy("up", "at", "bucket").agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("children"))
    groups = groups.withColumn("then", F.lead("first").over(Window.partitionBy("up", "at").orderBy("bucket")))  # a row a bucket
    last = hung.where("sibling IS NULL").drop("sibling").join(groups.select("up", "at", "bucket", F.col("then").alias("sibling")), ["up", "at", "bucket"])
    sibling = hung.where("sibling IS NOT NULL").unionByName(last).select("conv", "sibling")
    forks = cut(groups.groupBy("up", "at").agg(F.min_by("first", "bucket").alias("first"), F.sum("children").alias("children")), "branchings")

    after = line.join(sibling, "conv", "left").withColumn("then", F.coalesce("sibling", "up")).withColumn("then_depth", F.when(F.col("sibling").isNotNull(), -1).otherwise(F.col("at")))
    lowest = forks.groupBy(F.col("up").alias("conv")).agg(F.max("at").alias("low"), F.max_by("first", "at").alias("first"))
    top = F.col("top") - 1
    down = after.join(lowest, "conv", "left").select(
        "conv", F.lit(-1).cast("long").alias("depth"), F.coalesce("first", "then").alias("next"), F.when(F.col("first").isNotNull(), -1).otherwise(F.col("then_depth")).cast("long").alias("next_depth"),
        (2 * F.col("deep") - top - F.coalesce("low", top)).alias("arcs"), F.when(F.col("low") == F.col("deep"), 0).otherwise(1).cast("long").alias("leaves"), "saved")
    # branchings of a path with k of them need about k^2 / 2 turns, so a path's are few beside the table
    higher = Window.partitionBy("up").orderBy("at")
    back = forks.withColumn("higher", F.lag("at").over(higher)).withColumn("first", F.lag("first").over(higher)).select(F.col("up").alias("conv"), F.col("at").alias("depth"), "higher", "first")
    back = back.join(after.select("conv", "top", "then", "then_depth"), "conv").select(
        "conv", "depth", F.coalesce("first", "then").alias("next"), F.when(F.col("first").isNotNull(), -1).otherwise(F.col("then_depth")).cast("long").alias("next_depth"),
        (F.col("depth") - F.coalesce("higher", top)).alias("arcs"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    return cut(down.unionByName(back), "runs"), forks


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of the runs of one list, from the only one that none leads to."""
    rows = {}
    for batch in batches:
        for conv, depth, nxt, next_depth, *w in zip(*(c.to_pylist() for c in batch.columns)):
            rows[conv, depth] = ((nxt, next_depth) if nxt is not None else None, w)
    led = {nxt for nxt, _ in rows.values()}
    here, total, out = next((k for k in rows if k not in led), None), [0, 0, 0], []
    while here is not None:
        out.append((*here, *total))
        here, w = rows[here]
        total = [a + b for a, b in zip(total, w)]
    yield _table(out, ["conv", "depth", *WEIGHTS], [pa.int64()] * 5)


def rank(live: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv, depth, arcs, leaves, saved: the sums of the weights before each run of the list."""
    spark, gone = live.sparkSession, []
    head = live.join(live.select(F.col("next").alias("conv"), F.col("next_depth").alias("depth")), ["conv", "depth"], "left_anti").select("conv", "depth").first()
    key = lambda c, d, k: (F.xxhash64(c, d, F.lit(k)).bitwiseAND(F.lit(1)) == 1) & ~((F.col(c) == head[0]) & (F.col(d) == head[1]))
    while live.count() > limit:
        goes, next_goes = key("conv", "depth", len(gone)), F.coalesce(key("next", "next_depth", len(gone)), F.lit(False))
        takers = live.where(~goes & next_goes).select(*(F.col(c).alias(f"t_{c}") for c in live.columns))
        met = live.where(goes).join(takers, (F.col("conv") == F.col("t_next")) & (F.col("depth") == F.col("t_next_depth")), "left")
        row = lambda out, c, d, n, m, w: F.struct(F.lit(out).alias("gone"), F.col(c).alias("conv"), F.col(d).alias("depth"), F.col(n).alias("next"), F.col(m).alias("next_depth"), *(x.alias(a) for x, a in zip(w, WEIGHTS)))
        stays = row(False, "conv", "depth", "next", "next_depth", [F.col(a) for a in WEIGHTS])
        joined = row(False, "t_conv", "t_depth", "next", "next_depth", [F.col(a) + F.col(f"t_{a}") for a in WEIGHTS])
        taken = row(True, "conv", "depth", "t_conv", "t_depth", [F.col(f"t_{a}") for a in WEIGHTS])
        out = met.select(F.explode(F.when(F.col("t_conv").isNull(), F.array(stays)).otherwise(F.array(joined, taken))).alias("r")).select("r.*")
        out = out.unionByName(live.where(~goes & ~next_goes).withColumn("gone", F.lit(False)))
        path = new_dir(spark, "contracted")
        out.write.partitionBy("gone").option("compression", "zstd").parquet(path)
        both = spark.read.schema(out.schema).parquet(path)
        gone.append(both.where("gone"))
        live = both.where("NOT gone").drop("gone")
    ranked = cut(live.repartition(1).mapInArrow(_walk, "conv long, depth long, arcs long, leaves long, saved long"), "ranked")
    for taken in reversed(gone):
        known = ranked.select(F.col("conv").alias("next"), F.col("depth").alias("next_depth"), *(F.col(a).alias(f"k_{a}") for a in WEIGHTS))
        ranked = ranked.unionByName(cut(taken.join(known, ["next", "next_depth"]).select("conv", "depth", *((F.col(a) + F.col(f"k_{a}")).alias(a) for a in WEIGHTS)), "ranked"))
    return ranked


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per node of the rebuilt conversations' trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    enter and exit, the places of its arcs in the tour (from 0).

    Null roles and texts are empty, a null turn comes first, rows of one turn number follow by role and text digest, repeated rows are turns
    of their own. Rows without a conv_id belong to no conversation and are left out. Empty input gives no rows (there is no member that could name a root). Other
    columns are ignored. Texts of any length are digested where they are read."""
    found = nodes(conversations)
    line = paths(found)
    tour, forks = runs(line)
    if tour.isEmpty():
        empty = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, enter long, exit long"
        return found.sparkSession.createDataFrame([], empty)
    places = cut(rank(tour, limit), "places")
    bucket = lambda c: F.expr(f"{c} div {DEPTHS}").alias("bucket")
    fork = forks.join(places, (F.col("up") == F.col("conv")) & (F.col("at") == F.col("depth"))).select("conv", "depth", bucket("depth"), F.struct("depth", "arcs", "leaves", "saved", "children").alias("fork"))
    # what a path's bucket of depths has before it and, in deeper buckets, below it
    sums = found.groupBy("conv", bucket("depth")).agg(F.sum("saved").alias("own"))
    sums = sums.join(fork.groupBy("conv", "bucket").agg(F.min_by("fork", "depth").alias("fork")), ["conv", "bucket"], "left")
    along = Window.partitionBy("conv").orderBy("bucket")  # a row a bucket
    sums = sums.withColumn("before", F.sum("own").over(along) - F.col("own")).withColumn("below", F.first("fork", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)))
    path = line.join(places.where("depth = -1").select("conv", F.struct("arcs", "leaves", "saved").alias("start")), "conv").withColumnRenamed("saved", "whole")
    sums = sums.select("conv", "bucket", "before", "below").join(path, "conv")

    both = found.select("conv", "depth", bucket("depth"), "n_convs", "saved", "ends", F.lit(True).alias("node")).unionByName(fork.withColumn("node", F.lit(False)), allowMissingColumns=True)
    both = both.join(sums, ["conv", "bucket"])
    within = Window.partitionBy("conv", "bucket")
    upward = within.orderBy(F.desc("depth"), "node")
    both = both.withColumn("_before", F.col("before") + F.coalesce(F.sum("saved").over(within.orderBy("depth", "node")), F.lit(0)) - F.coalesce("saved", F.lit(0)))
    both = both.withColumn("_fork", F.coalesce(F.last("fork", ignorenulls=True).over(upward.rowsBetween(Window.unboundedPreceding, 0)), "below")).where("node")
    top, deep, depth = F.col("top"), F.col("deep"), F.col("depth")
    exit_ = F.coalesce(F.col("_fork.arcs") + F.col("_fork.depth") - depth, F.col("start.arcs") + 2 * deep - top + 1 - depth)
    more = F.when(F.col("_fork.depth") == depth, F.col("_fork.children")).otherwise(0)
    return both.select(
        F.col("conv").alias("conv_id"), "depth", F.when(depth > top, F.col("conv")).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs",
        ((depth < deep).cast("long") + more).alias("n_children"), (F.coalesce(F.col("_fork.leaves"), F.col("start.leaves") + 1) - F.col("start.leaves")).alias("n_leaves"),
        (F.coalesce(F.col("_fork.saved"), F.col("start.saved") + F.col("whole")) - F.col("start.saved") - F.col("_before")).alias("saved_tokens"),
        F.lower(F.hex(F.coalesce("ends", F.lit(hashlib.sha256().digest())))).alias("ends_sha256"), (F.col("start.arcs") + depth - top).alias("enter"), exit_.alias("exit"))
