"""Intervals by endpoint sweeps: cover counts, overlap counts and violations without pairs of intervals (families C, I, J).

An interval [start, end] holds both its ends. A sweep adds one where intervals start and takes one where they end, in order
of the points; what it knows at a point is a running sum. Running sums of a key are taken within ranges of (key, point), and the sums of the
ranges before are added, so that a key with most of the rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def running(df: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """df plus <c>_upto: the sum of c over the key's rows up to and with this row's `order` (rows of equal order count together)."""
    parts = cut(df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = parts.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_ahead_{c}") for c in sums))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range of the key
    totals = totals.select(*keys, "_range", *(F.coalesce(F.sum(f"_ahead_{c}").over(ahead), F.lit(0)).alias(f"_ahead_{c}") for c in sums))
    within = Window.partitionBy(*keys, "_range").orderBy(order)
    out = parts.select("*", *(F.sum(c).over(within).alias(f"{c}_upto") for c in sums)).join(totals, [*keys, "_range"])
    return out.select(*df.columns, *((F.col(f"{c}_upto") + F.col(f"_ahead_{c}")).alias(f"{c}_upto") for c in sums))


def endpoints(df: DataFrame, keys: list[str], start: str, end: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """keys, point, and for each measure (a number an interval; without: n = 1) starts_<m> and ends_<m>: its sums over the intervals
    that start and that end there. A row a key and point, added up before the shuffle."""
    measures = measures or {"n": F.lit(1)}
    own = df.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"), *(m.cast("long").alias(f"_{c}") for c, m in measures.items())).where("_start <= _end")
    both = F.explode(F.array(F.struct(F.col("_start").alias("point"), F.lit(True).alias("first")), F.struct(F.col("_end").alias("point"), F.lit(False).alias("first"))))
    rows = own.select(*keys, *(f"_{c}" for c in measures), both.alias("_p")).select(*keys, *(f"_{c}" for c in measures), "_p.*")
    sums = [F.sum(F.when(F.col("first") == side, F.col(f"_{c}")).otherwise(0)).alias(f"{name}_{c}") for c in measures for name, side in (("starts", True), ("ends", False))]
    return rows.groupBy(*keys, "point").agg(*sums)


def cover(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, low, high, k: the stretches of points that the same number k > 0 of the key's intervals hold. Points are whole numbers."""
    ends = endpoints(df, keys, start, end)
    # an interval stops counting at the point after its end
    change = ends.select(*keys, "point", F.col("starts_n").alias("d")).unionByName(ends.select(*keys, (F.col("point") + 1).alias("point"), (-F.col("ends_n")).alias("d"))).groupBy(*keys, "point").agg(F.sum("d").alias("d"))
    line = Window.partitionBy(*keys).orderBy("point")  # a row a point at which something changes
    swept = change.where("d <> 0").select(*keys, F.col("point").alias("low"), F.sum("d").over(line).alias("k"), (F.lead("point").over(line) - 1).alias("high"))
    return swept.where("k > 0").select(*keys, "low", "high", "k")


def cover_points(df: DataFrame, keys: list[str], start: str, end: str, point: str) -> DataFrame:
    """keys, point, k: the number of the key's intervals at each point that one holds."""
    return cover(df, keys, start, end).select(*keys, F.explode(F.sequence("low", "high")).alias(point), "k")


def dealt(df: DataFrame, on: list[str]) -> DataFrame:
    """df in all of the session's shuffle partitions by `on`: how many partitions adaptive execution would keep follows from the bytes that go in, which say
    nothing of the rows that a join makes of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose rows are many more than its inputs'. Both sides are dealt by `on`."""
    return dealt(left, on).join(dealt(right, on), on, how)


def point_join(facts: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Facts with the intervals of the same keys that hold their point, for short intervals of whole numbers: each is laid out point by
    point, so that the join is on keys and point, and every row that meets another is a row of the result."""
    out = intervals.where(F.col(start) <= F.col(end)).withColumn(point, F.explode(F.sequence(start, end)))  # a sequence to an end before its start runs down
    return dealt_join(facts, out, [*on, point], how)


def overlap_counts(df: DataFrame, keys: list[str], start: str, end: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """df plus over_<m> for each measure: its sum over the key's intervals that overlap the row's, its own included: those that start at its
    end or before, less those that end before its start."""
    measures = measures or {"n": F.lit(1)}
    ends = endpoints(df, keys, start, end, measures)
    swept = cut(running(ends, keys, "point", [c for m in measures for c in (f"starts_{m}", f"ends_{m}")]), "sweep")
    upto = swept.select(*keys, F.col("point").alias(end), *(F.col(f"starts_{m}_upto").alias(f"_s_{m}") for m in measures))
    before = swept.select(*keys, F.col("point").alias(start), *((F.col(f"ends_{m}_upto") - F.col(f"ends_{m}")).alias(f"_e_{m}") for m in measures))
    out = df.join(upto, [*keys, end]).join(before, [*keys, start])
    return out.select(*df.columns, *((F.col(f"_s_{m}") - F.col(f"_e_{m}")).alias(f"over_{m}") for m in measures))


def conflicts(df: DataFrame, keys: list[str], start: str, end: str, shared: Column | None = None) -> DataFrame:
    """The rows of df that overlap another of their key, unless both are shared: others of a row that isn't shared, others that aren't of a
    row that is."""
    free = F.lit(False) if shared is None else shared
    found = overlap_counts(df.withColumn("_shared", free), keys, start, end, {"n": F.lit(1), "own": (~F.col("_shared")).cast("long")})
    return found.where(F.when(F.col("_shared"), F.col("over_own") > 0).otherwise(F.col("over_n") > 1)).drop("_shared", "over_n", "over_own")


def conflict_pairs(df: DataFrame, keys: list[str], key: str, start: str, end: str, keep: list[str], shared: str | None = None, width: int = 4) -> DataFrame:
    """The pairs a < b of rows of one key that overlap, unless both are shared, with overlap_start and overlap_end. Rows without a conflict
    are left out by a sweep first; the others meet within stretches of `width` points (days or numbers), each pair in the stretch in which its overlap begins. So
    a key whose intervals follow each other costs a sort, and one with many conflicts is dealt by time."""
    some = conflicts(df, keys, start, end, F.col(shared) if shared else None)
    dates = df.schema[start].dataType.typeName() == "date"
    cell = lambda c: F.floor((F.unix_date(c) if dates else (F.col(c) if isinstance(c, str) else c).cast("long")) / width)
    wanted = list(dict.fromkeys([key, start, end, *keep, *([shared] if shared else [])]))
    # a stretch holds what starts in it, and what goes on from a stretch before; the later start of a pair is where its overlap begins
    begun = some.select(*keys, cell(start).alias("_cell"), *(F.col(c).alias(f"x_{c}") for c in wanted))
    latest = some.groupBy(*keys).agg(F.max(start).alias("_latest"))  # no overlap begins later, so open ends are laid out up to there
    held = some.join(latest, keys).select(*keys, F.explode(F.sequence(cell(start), cell(F.least(end, "_latest")))).alias("_cell"), *(F.col(c).alias(f"y_{c}") for c in wanted))
    met = begun.join(held, [*keys, "_cell"]).where((F.col(f"x_{key}") != F.col(f"y_{key}")) & (F.col(f"y_{start}") <= F.col(f"x_{start}")) & (F.col(f"x_{start}") <= F.col(f"y_{end}")) & ((F.col(f"y_{start}") < F.col(f"x_{start}")) | (F.col(f"y_{key}") < F.col(f"x_{key}"))))
    if shared:
        met = met.where(~(F.col(f"x_{shared}") & F.col(f"y_{shared}")))
    first = F.col(f"x_{key}") < F.col(f"y_{key}")
    side = lambda p, c: F.when(first == (p == "a"), F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"{p}_{c}")
    return met.select(*keys, *(side(p, c) for p in "ab" for c in wanted), F.col(f"x_{start}").alias("overlap_start"), F.least(f"x_{end}", f"y_{end}").alias("overlap_end"))


def covered(facts: DataFrame, weeks: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """facts plus the columns of weeks (a row a key and point); NULL for facts that nothing covers, and an error with strict."""
    out = facts.join(weeks, on, "left")
    if strict:
        missing = facts.join(weeks, on, "left_anti").count()
        if missing:
            raise ValueError(f"{missing} rows are covered by no interval")
    return out


def overlap_links(df: DataFrame, keys: list[str], owner: str, start: str, end: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """keys, a, b and a number for each measure (a condition; without: n, all): how many pairs of an interval of owner a and one of owner b > a of
    the key overlap, both meeting the condition. Counted from each owner's starts and ends by point: the intervals of b that began by the ends of
    a's, less those that had ended before a's starts. Rows are a point and two owners, never two intervals."""
    measures = {m: c.cast("long") for m, c in (measures or {"n": F.lit(True)}).items()}
    own = cut(endpoints(df, [*keys, owner], start, end, measures), "endpoints")
    names = [c for m in measures for c in (f"starts_{m}", f"ends_{m}")]
    # what each owner of a key has begun and ended by each of the key's points
    grid = own.select(*keys, owner).distinct().join(own.select(*keys, "point").distinct(), keys)
    swept = running(grid.join(own, [*keys, owner, "point"], "left").fillna(0, names), [*keys, owner], "point", names)
    right = swept.select(*keys, "point", F.col(owner).alias("b"), *(F.col(f"starts_{m}_upto").alias(f"_s_{m}") for m in measures), *((F.col(f"ends_{m}_upto") - F.col(f"ends_{m}")).alias(f"_e_{m}") for m in measures))
    met = own.withColumnRenamed(owner, "a").join(right, [*keys, "point"]).where("a < b")
    out = met.groupBy(*keys, "a", "b").agg(*(F.sum(F.col(f"ends_{m}") * F.col(f"_s_{m}") - F.col(f"starts_{m}") * F.col(f"_e_{m}")).alias(m) for m in measures))
    return out.where(F.col(next(iter(measures))) > 0)


def lines(cells: DataFrame, keys: list[str], actor: str, point: str, sums: list[str]) -> DataFrame:
    """keys, actor, _line: the actor's running sums by point, in order, from a first entry of zeros. cells: a row a key, actor and point."""
    own = cells.groupBy(*keys, actor).agg(F.array_sort(F.collect_list(F.struct(F.col(point).alias("p"), *(F.col(c).cast("double").alias(c) for c in sums)))).alias("_line"))
    zero = F.struct(F.lit(None).cast(cells.schema[point].dataType).alias("p"), F.lit(0).alias("points"), *(F.lit(0.0).alias(c) for c in sums))
    total = F.aggregate("_line", F.array(zero), lambda acc, x: F.concat(acc, F.array(F.struct(x["p"].alias("p"), (F.element_at(acc, -1)["points"] + 1).alias("points"), *((F.element_at(acc, -1)[c] + x[c]).alias(c) for c in sums)))))
    return own.withColumn("_line", total)


def span_sums(lines: DataFrame, intervals: DataFrame, keys: list[str], start: str, end: str, sums: list[str]) -> DataFrame:
    """The columns of lines (less _line), start, end, points and sums: what an actor's cells within each span add up to. A span is a start and
    end that an interval of the keys has; intervals of one span share its sums, the difference of two running sums. points: the number of cells, above 0."""
    spans = intervals.select(*keys, start, end).distinct()
    # a line is in order of its points, so the last sums up to a point are those of as many points as are not above it
    upto = lambda bound: F.element_at("_line", F.size(F.filter("_line", lambda x: x["p"].isNull() | bound(x["p"]))))
    met = dealt_join(lines, spans, keys).withColumn("_high", upto(lambda p: p <= F.col(end))).withColumn("_low", upto(lambda p: p < F.col(start)))
    kept = [c for c in lines.columns if c != "_line"]
    out = met.select(*kept, start, end, (F.col("_high.points") - F.col("_low.points")).alias("points"), *((F.col(f"_high.{c}") - F.col(f"_low.{c}")).alias(c) for c in sums))
    return out.where("points > 0")


def of_spans(rows: DataFrame, intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows of spans for each interval of the span, with the columns of both: the last step, as what is a row an actor and span is one an actor and interval after it."""
    return dealt_join(rows, intervals, [*keys, start, end])


def exposures(cells: DataFrame, intervals: DataFrame, keys: list[str], actor: str, point: str, start: str, end: str, sums: list[str], keep: list[str]) -> DataFrame:
    """keep (columns of the intervals), actor, points and sums: for each interval and actor of its keys what the actor's cells within it add up
    to. cells: a row a key, actor and point. points: the number of cells, above 0."""
    met = span_sums(lines(cells, keys, actor, point, sums), intervals, keys, start, end, sums)
    own = intervals.select(*keys, start, end, *[c for c in keep if c not in [*keys, start, end]])
    return of_spans(met, own, keys, start, end).select(*keep, actor, "points", *sums)
