"""Likeness of texts by edit distance, exact and without comparing all pairs (family M).

Two texts are alike if 1 - distance / longer length is at least 1 - loss. A text of length n that has a partner can be edited in at most
loss / (1 - loss) n places, so of one piece more than that, at least one is the same in the partner and moved by no more than the number of edits. Pieces of
the known texts meet the partner's substrings at those places by an equi-join on (length, piece number, piece); what meets is verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pieces(known: DataFrame, key: str, text: str, loss: tuple[int, int] = (1, 5)) -> DataFrame:
    """key, text, and a row a piece: size (the text's length), part, piece."""
    a, b = loss
    rows = known.select(key, F.col(text).alias("_known"), F.length(text).alias("_size")).where("_size > 0")
    count = f"({a} * _size div {b - a} + 1)"
    start = lambda i: f"int(({i}) * _size div {count})"
    cut = f"transform(sequence(0, int({count}) - 1), i -> struct(_size AS size, i AS part, substring(_known, 1 + {start('i')}, {start('i + 1')} - {start('i')}) AS piece))"
    return rows.select(key, "_known", F.explode(F.expr(cut)).alias("_p")).select(key, "_known", "_p.*")


def probes(said: DataFrame, key: str, text: str, loss: tuple[int, int] = (1, 5)) -> DataFrame:
    """key, text, and the (size, part, piece) that a known text alike would share: for each length a partner can have, each of its pieces' places and as
    many to the left and right as there can be edits."""
    a, b = loss
    rows = said.select(key, F.col(text).alias("_said"), F.length(text).alias("_n")).where("_n > 0")
    sizes = f"sequence(greatest(1, int(({b - a} * _n + {b - 1}) div {b})), int({b} * _n div {b - a}))"
    rows = rows.withColumn("size", F.explode(F.expr(sizes))).withColumn("_parts", F.expr(f"int({a} * size div {b - a}) + 1")).withColumn("_edits", F.expr(f"int({a} * greatest(_n, size) div {b})"))
    rows = rows.withColumn("part", F.explode(F.expr("sequence(0, _parts - 1)"))).withColumn("_from", F.expr("int(part * size div _parts)")).withColumn("_len", F.expr("int((part + 1) * size div _parts) - _from"))
    rows = rows.withColumn("_low", F.greatest(F.lit(0), F.col("_from") - F.col("_edits"))).withColumn("_high", F.least(F.col("_n") - F.col("_len"), F.col("_from") + F.col("_edits"))).where("_low <= _high")
    return rows.select(key, "_said", "size", "part", F.explode(F.expr("array_distinct(transform(sequence(_low, _high), p -> substring(_said, p + 1, _len)))")).alias("piece"))


def alike(said: DataFrame, known: DataFrame, said_key: str, known_key: str, said_text: str, known_text: str, loss: tuple[int, int] = (1, 5)) -> DataFrame:
    """said_key, known_key, score of all pairs whose score is at least 1 - loss (a fraction, as two whole numbers). Equal texts are compared once:
    the pairs are of distinct texts, and keys are joined to what is alike. NULL and empty texts are like nothing."""
    a, b = loss
    left, right = said.select(F.col(said_text).alias("x")).distinct(), known.select(F.col(known_text).alias("y")).distinct()
    met = probes(left, "x", "x", loss).select("x", "size", "part", "piece").join(pieces(right, "y", "y", loss).select("y", "size", "part", "piece"), ["size", "part", "piece"]).select("x", "y").distinct()
    longer = F.greatest(F.length("x"), F.length("y"))
    pairs = met.withColumn("_d", F.levenshtein("x", "y")).where(b * F.col("_d") <= a * longer).select("x", "y", (1 - F.col("_d") / longer).alias("score"))
    out = said.select(said_key, F.col(said_text).alias("x")).join(pairs, "x").join(known.select(known_key, F.col(known_text).alias("y")), "y")
    return out.select(said_key, known_key, "score")
