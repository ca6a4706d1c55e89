"""Mixing sources to target weights by a low-discrepancy schedule (operator 8).

Sizes are word counts. Sources, by code point with null last, weigh 5, 2, 1 and so on; targets share all words by weight, none
above cap times its source's size (the excess goes to the others by weight, by a water level over the sorted
sources). Slot i of the schedule takes block_tokens words from the source that the golden-ratio point
frac(i * phi) meets on the line of cumulative targets; slots are ranked per source. Each source's documents are
shuffled by a hash and laid end to end in a ring, which is cut into blocks of block_tokens words, over the seam too: rank k takes
block k, so the slots are the order of the mix, in which every prefix has the sources' shares but for a few blocks. A document gets
the words that the taken blocks have of it, and the slots at which its passes begin. The points of a source miss its target by a few
slots at most: its last blocks are cut at the target's words or not taken, and blocks next in line follow after the last slot. As no target is
above cap times the size, no block of the ring is taken more than cap times.

Ranks and positions need no ordered pass over a whole source: sums per (bucket, source) are added up in two levels, and rows are
ranked within a bucket of bounded size, so a source with most of the rows is no hot task. Defined results: null text is
size 0; a null source is a source of its own, last; rows of one doc_id are laid down by a hash of all their columns, so that only
rows that are the same can change places; with no words at all targets and taken are 0; empty input gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, free

WEIGHTS = (5, 2, 1)
#: floor(2^31 / golden ratio), made odd: multiples modulo 2^31 are the golden-ratio sequence in integers.
GOLDEN, PERIOD = 1_327_217_885, 1 << 31
BLOCK_TOKENS, SLOTS_PER_BUCKET, ROWS_PER_BUCKET = 128, 4096, 512
CELL = PERIOD >> 12
#: Buckets whose sums are added up in one task.
BUCKETS_PER_GROUP = 4096


def sizes(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return docs.withColumn("size", words.cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """source, source_size -> plus weight and target. One row per source, so a plain window suffices."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("_at", F.row_number().over(by_name) - 1).withColumn("weight", w.cast("double")).withColumn("_cap", cap * F.col("source_size").cast("double"))
    # in order of cap / weight: the first sources are capped, the level of the rest is (all - caps before) / weights from here on
    up = Window.orderBy(F.col("_cap") / F.col("weight"), F.asc_nulls_last("source"))
    rows = (
        rows.withColumn("_all", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_caps")) / F.col("_weights"))
        .withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap"))
    )
    level = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("weight"), "_level"))).over(Window.partitionBy())
    return (
        rows.withColumn("_best", level["_level"])
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_best") * F.col("weight"), F.col("_cap"))))
        .select("source", "source_size", "weight", "target")
    )


def before(sums: DataFrame, value: str) -> DataFrame:
    """_bucket, _source, before: the sum of value over the source's earlier buckets. sums: bucket, source, value. Sums of groups
    of buckets come first, so that no task sees all buckets of a source."""
    rows = sums.withColumn("_group", F.expr(f"bucket div {BUCKETS_PER_GROUP}"))
    groups = rows.groupBy("_group", "source").agg(F.sum(value).alias("n"))
    groups = groups.select(F.col("_group").alias("_g"), F.col("source").alias("_s"), (F.sum("n").over(Window.partitionBy("source").orderBy("_group")) - F.col("n")).alias("_first"))
    own = F.sum(value).over(Window.partitionBy("_group", "source").orderBy("bucket")) - F.col(value)
    rows = rows.withColumn("_own", own).join(groups, (F.col("_group") == F.col("_g")) & F.col("source").eqNullSafe(F.col("_s")))
    return rows.select(F.col("bucket").alias("_bucket"), F.col("source").alias("_source"), (F.col("_first") + F.col("_own")).alias("before"))


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """slot, source, rank of the slots 0 .. slots - 1. shares: source, low, high (bounds on 0 .. PERIOD)."""
    spark = shares.sparkSession
    parts = max(1, -(-slots // (SLOTS_PER_BUCKET * 16)))
    point = (F.col("slot") % PERIOD * GOLDEN) % PERIOD
    line = spark.range(0, slots, 1, parts).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("bucket", F.expr(f"slot div {SLOTS_PER_BUCKET}"))
    # the line of points is cut into cells, so that points meet sources by an equi-join of bounded fan-out
    cells = shares.select("source", "low", "high", F.explode(F.expr(f"sequence(low div {CELL}, (high - 1) div {CELL})")).alias("cell")).where("high > low")
    met = line.withColumn("cell", F.expr(f"point div {CELL}")).join(cells, "cell").where("point >= low AND point < high").drop("cell")
    first = before(met.groupBy("bucket", "source").agg(F.count(F.lit(1)).alias("n")), "n")
    ranked = met.withColumn("_own", F.row_number().over(Window.partitionBy("bucket", "source").orderBy("slot")) - 1)
    return ranked.join(first, (F.col("bucket") == F.col("_bucket")) & F.col("source").eqNullSafe(F.col("_source"))).select("slot", "source", (F.col("before") + F.col("_own")).alias("rank"))


def line_up(rows: DataFrame, count: int) -> DataFrame:
    """rows (_row, source, size, _hash, doc_id, _tie) plus start: the words before the row in its source's shuffled line."""
    buckets = max(1, -(-count // ROWS_PER_BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.col("_hash"), F.lit(buckets)))
    first = before(rows.groupBy("bucket", "source").agg(F.sum("size").alias("n")), "n")
    order = Window.partitionBy("bucket", "source").orderBy("_hash", "doc_id", "_tie", "_row").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum("size").over(order) - F.col("size")
    return rows.withColumn("_own", own).join(first, (F.col("bucket") == F.col("_bucket")) & F.col("source").eqNullSafe(F.col("_source"))).withColumn("start", F.col("before") + F.col("_own")).drop("_own", "before", "_bucket", "_source", "bucket")


def taken_blocks(shares: DataFrame, slots: int, block_tokens: int) -> DataFrame:
    """_source, rank, upto, slot: the blocks that the schedule takes of each source's ring, the word before which the block ends, and its slot.
    shares also has wanted, the target in whole words; blocks next in line make up for the slots that a source lacks, after the last one."""
    ranked = cut(schedule(shares, slots), "slots")
    met = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("met")).withColumnRenamed("source", "_source")
    goal = shares.join(met, F.col("source").eqNullSafe(F.col("_source")), "left").select(F.col("source").alias("_source"), "wanted", F.coalesce("met", F.lit(0)).alias("met"))
    whole = F.expr(f"(wanted + {block_tokens - 1}) div {block_tokens}")
    kept = ranked.join(goal.where("wanted > 0"), F.col("source").eqNullSafe(F.col("_source"))).where(F.col("rank") < whole).select("_source", "rank", "wanted", "slot")
    added = goal.where(F.col("met") < whole).select("_source", F.explode(F.sequence("met", whole - 1)).alias("rank"), "wanted", "met").withColumn("slot", slots + F.col("rank") - F.col("met")).drop("met")
    return kept.unionByName(added).select("_source", "rank", F.least((F.col("rank") + 1) * block_tokens, "wanted").alias("upto"), "slot")


def apply(docs: DataFrame, ordered: bool = False, **options) -> DataFrame:
    """The mix itself: every row of docs as often as its taken words hold it, to the nearest whole number; all columns, whatever
    their names. Only the last document of a source's last pass is taken in part, so whole documents keep the targets.
    A row without words is never taken. ordered: the result's partitions, one after the other, are in the order of the schedule, each copy
    at the slot at which its pass begins; it costs one more shuffle of the texts, which a stage that packs them does not need."""
    row, copy = free(docs, "_row"), free(docs, "_copy")
    held = cut(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    share = mix(held, row=row, **options).where("size > 0").select(F.col("_row").alias(row), F.slice("slots", F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int")).alias(copy))
    out = held.join(share.where(F.size(copy) > 0), row).withColumn(copy, F.explode(copy))
    if ordered:
        out = out.repartitionByRange(copy, row).sortWithinPartitions(copy, row)
    return out.select(*docs.columns)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, block_tokens: int = BLOCK_TOKENS, row: str | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, slots (at which its passes begin, in order) and first_slot of every row, and _row, taken
    from the column `row` if named. A row of which nothing is taken has no slot."""
    numbered = F.monotonically_increasing_id() if row is None else F.col(row)
    shuffled = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != row and f.dataType.typeName() not in ("map", "variant")])
    rows = sizes(docs.select("doc_id", "source", "text", numbered.alias("_row"), tie.alias("_tie"))).drop("text").withColumn("_hash", shuffled)
    table = cut(rows, "sizes")
    totals = table.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(totals, weights, cap).coalesce(1), "targets")  # one row a source
    summed = table.agg(F.count(F.lit(1)), F.sum("size")).first()
    count, words = summed[0], summed[1] or 0
    slots = -(-words // block_tokens)
    line = Window.orderBy(F.asc_nulls_last("source"))
    share = F.sum("target").over(line) / F.sum("target").over(Window.partitionBy())
    wanted = F.round("target").cast("long")
    shares = goal.where("target > 0").withColumn("high", F.round(share * PERIOD).cast("long")).withColumn("low", F.lag("high", 1, 0).over(line)).withColumn("wanted", wanted)
    blocks = taken_blocks(shares.select("source", "low", "high", "wanted"), slots, block_tokens)
    # each pass lays a document down once more on the ring
    rings = shares.where("wanted > 0").select(F.col("source").alias("_source"), F.col("source_size").alias("_words"), "wanted")
    laid = line_up(table, count).where("size > 0").join(rings, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = laid.select("_row", "source", "size", "wanted", F.explode(F.expr("transform(sequence(0L, (wanted - 1) div _words), p -> struct(p AS pass, p * _words + start AS start))")).alias("p")).select("_row", "source", "size", "wanted", "p.*").where("start < wanted")
    last = F.expr(f"(least(start + size, wanted) - 1) div {block_tokens}")
    spans = laid.select("_row", "source", "pass", "start", "size", F.explode(F.sequence(F.expr(f"start div {block_tokens}"), last)).alias("block"))
    inside = F.least(F.col("start") + F.col("size"), "upto") - F.greatest(F.col("start"), F.col("block") * block_tokens)
    got = spans.join(blocks, (F.col("block") == F.col("rank")) & F.col("source").eqNullSafe(F.col("_source"))).groupBy("_row").agg(F.sum(inside).alias("taken"), F.array_sort(F.array_compact(F.array(*(F.min(F.when(F.col("pass") == p, F.col("slot"))) for p in range(cap))))).alias("slots"))
    out = table.join(got, "_row", "left").withColumnRenamed("source", "_own")
    out = out.join(goal, F.col("_own").eqNullSafe(F.col("source")))
    return out.select("_row", "doc_id", "size", F.col("_own").alias("source"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<long>")).alias("slots"), F.try_element_at("slots", F.lit(1)).alias("first_slot"))
